"""License scan, SimHash, MinHash, BPE, packing: brute force, exact round trips, odd tables."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelith.llm import bpe, common, licenses, minhash, packing, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Lorem ipsum dolor sit amet " * 20_000
#: Null in any column, empty, very long, ties and repeated rows.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (4, "same text here", "en", "s", 14), (4, "same text here", "en", "s", 14), (5, "same text here", None, "s", 14), (None, "no id", "en", "s", 5), (6, "\n \t\x00ﬀ😀é", "en", "s", 7)]


@pytest.fixture
def odd(spark):
    """With columns whose names clash with those that the operators make."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("fp", "bucket", "labels", "score", "k", "guest", "salt", "rank", "spans", "n", "root", "cell")})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(r, n, words=None):
    words = words or [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ta", "vo", "zi") for b in ("n", "rt", "s", "mple", "den")]
    return " ".join(r.choice(words) for _ in range(n))


# Licenses


def test_licenses_base_and_templates(spark):
    texts = [
        "GNU General Public License and gnu-general.public license; MIT License", "x CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "released under\nthe mit license", "This work is licensed under the GNU General Public License, version 3.",
        "gnu general public licenses", "cc by cc by", "Übcc by", "The ſoftware: apache license", "apache licenſe",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x.doc_id: x for x in licenses.scan(df).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (3, 0, 9, "gpl,mit")
    assert (r[1].base_labels, r[1].labels) == ("cc-by", "cc-by") and r[2].labels == "cc-by,cc-by-nc-notice"
    assert r[3].labels == "mit" and r[4].labels == "gpl,gpl-notice" and r[5].n_base == 0
    assert (r[6].n_base, r[6].last_word) == (2, 2) and r[7].n_base == 0 and r[8].n_base == 1 and r[9].n_base == 0
    assert r[2].score == 1 and r[5].score == 0


def test_license_join_finds_every_block_that_meets(spark):
    r = random.Random(1)
    words = [w.decode() for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)]
    lines = []
    for _ in range(400):
        t = r.choice(list(licenses.TEMPLATES.values())).split()
        r.shuffle(t)
        lines.append(" ".join(t[: r.randint(len(t) - 3, len(t))] + [r.choice(words) for _ in range(r.randint(0, 5))]))
    df = spark.createDataFrame([(i, lines[i] + "\n" + lines[-i]) for i in range(400)], "doc_id long, text string")
    for threshold in (0.5, 0.8, 0.9, 1.0):
        for x, (_, text) in zip(licenses.scan(df, threshold=threshold, phrases={"zz zz": "z"}).orderBy("doc_id").collect(), [(i, lines[i] + "\n" + lines[-i]) for i in range(400)], strict=True):
            want = set()
            for line in text.split("\n"):
                b = set(licenses.words_of(line))
                want |= {k for k, t in licenses.TEMPLATES.items() if len(b & (s := set(licenses.words_of(t)))) >= math.ceil(round(threshold * len(s), 9))}
            assert x.labels == ",".join(sorted(want))


def test_licenses_odd(odd, none):
    r = licenses.scan(odd).collect()
    assert len(r) == len(ODD) and licenses.scan(none).count() == 0
    by = {x.doc_id: x for x in r}
    assert by[1].n_words == by[2].n_words == 0 and by[3].n_words == 100_000 and by[1].first_word is None and by[1].labels == ""


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""


def test_wrapped_notices(spark):
    texts = [
        MIT, BSD, "released under\nthe mit license", "a\n\nreleased\nunder\n\nthe mit\nlicense", "Released under the MIT License.\nReleased under the MIT License.",
        "it was released under\n" + "many other words " * 9 + "the mit license", "be nd at on or he he\nLicensed under CC BY-NC 4.0.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = [(x.labels, x.n_blocks, x.score) for x in licenses.scan(df, wrapped=True).orderBy("doc_id").collect()]
    assert r[:2] == [("mit-text", 1, 1.0), ("bsd-text", 1, 1.0)] and r[2] == r[3] == ("mit,mit-notice", 1, 1.0)
    assert r[4] == ("mit,mit-notice", 2, 1.0) and r[5][:2] == ("mit", 0) and r[6] == ("cc-by,cc-by-nc-notice", 1, 1.0)
    assert [x.labels for x in licenses.scan(df).orderBy("doc_id").collect()][:3] == ["", "", "mit"]


def test_query_finds_wrapped_notices(spark, tmp_path):
    spark.createDataFrame([(1, MIT)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op1_licenses(spark, str(tmp_path)).first().labels == "mit-text"


def test_wrapped_against_brute_force():
    r = random.Random(2)
    ix = licenses.Prefixes(licenses.TEMPLATES, {}, 0.9)
    for _ in range(300):
        words = " ".join(" ".join(r.sample(t.split(), len(t.split()) - r.randint(0, 1))) for t in r.sample(sorted(licenses.TEMPLATES.values()), 2)).split()
        for _ in range(r.randint(0, 4)):
            words.insert(r.randrange(len(words)), "x")
        lines = [[]]
        for w in words:
            lines[-1].append(w.encode())
            if r.random() < 0.2:
                lines.append([])
        flat = [(w, i) for i, line in enumerate(lines) for w in line]
        want = {}
        for label, (tokens, need, span) in ix.sets.items():
            for a in range(len(flat)):
                part = flat[a : a + span]
                n = len(tokens & {w for w, _ in part})
                if flat[a][0] in tokens and n >= need and max(i for w, i in part if w in tokens) > flat[a][1]:
                    want[label] = max(want.get(label, 0), n / len(tokens))
        found, _ = ix.wrapped(lines, [x for x, _ in ix.meets([w for w, _ in flat])])
        assert dict(found) == want


def test_many_places_in_one_text(spark):
    n = 200_000
    at = time.perf_counter()
    r = licenses.scan(spark.createDataFrame([(1, "x mit license " * n)], "doc_id long, text string"), wrapped=True).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (3 * n, n, 1, 3 * n - 2) and time.perf_counter() - at < 60


def test_templates_are_bounded(none):
    with pytest.raises(ValueError):
        licenses.scan(none, templates={"x": "y " * licenses.MAX_TEMPLATE_BYTES})


# SimHash


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps, ids):
    """Brute force: all pairs, union-find; the least id of each row's component."""
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, odd):
    r = random.Random(2)
    base = [prose(r, 150) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:12]:
        for _ in range(8):
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, ""), (1001, None), (1002, "ab"), (1003, "AB")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    want = classes(fps, [d for d, _ in rows])
    assert got == {d: (f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want, strict=True)}
    assert len(set(want)) < len(rows) - 10
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == len(ODD) and {x.component_id for x in r if x.doc_id in (4, 5)} == {4} and {x.component_id for x in r if x.doc_id in (1, 2)} == {1}


def test_simhash_links_in_dense_groups(spark):
    """Chains and clusters of fingerprints."""
    r = random.Random(3)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            f ^= 1 << r.randrange(64)
            if r.random() < 0.4:
                f ^= 1 << r.randrange(64)
            if r.random() < 0.1:
                f ^= r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    own = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {x.fp: x.root for x in simhash.by_fingerprint(own).collect()}
    want = dict(zip(signed, classes(fps, signed), strict=True))
    assert got == want and len(set(want.values())) < len(fps) / 2


def test_one_of_each(spark, odd, none):
    kept = simhash.one_of_each(odd).collect()
    # null, empty and white space alone: one; the long text; the three equal ones; no id; the last has a word
    assert sorted(x.doc_id or 0 for x in kept) == [0, 1, 3, 4, 6] and kept[0].asDict().keys() == odd.first().asDict().keys()
    assert simhash.one_of_each(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    r = random.Random(4)
    ids = r.sample(range(10_000), 300)
    edges = [(a, b) for a, b in zip(ids, ids[1:]) if ids.index(a) not in (99, 199)]
    r.shuffle(edges)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(part) for part in (ids[:100], ids[100:200], ids[200:]) for x in part}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("light", [1, 100])
def test_components_of_stars(spark, monkeypatch, light):
    """Hubs whose edges are dealt to several tasks."""
    monkeypatch.setattr(common, "LIGHT", light)
    monkeypatch.setattr(common, "SHARE", 20)
    edges = [(h, h + i) for h in (1000, 2000, 3000) for i in range(1, 300)] + [(5, 1299), (2299, 3299), (7, 7)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {h + i: r for h, r in ((1000, 5), (2000, 2000), (3000, 2000)) for i in range(300)} | {5: 5}
    assert got == want


def test_dealt_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 3)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 99, i) for i in range(400)] + [(None, -1)], "k long, i long")
    right = spark.createDataFrame([(k, f"r{k}", n) for k, n in ((99, 200), (0, 28), (1, 29), (2, 28))], "k long, r string, n long")
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_dealt(rows, right, ["k"], 401, how).collect())) == sorted(map(str, rows.join(right.drop("n"), ["k"], how).collect()))


# MinHash


def shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_minhash_estimates_jaccard():
    h, r = minhash.Hasher(), random.Random(5)
    for share in (0.0, 0.3, 0.6, 0.9):
        a = prose(r, 600)
        b = " ".join(a.split()[: int(600 * share)]) + " " + prose(r, 600 - int(600 * share))
        x, y = shingles(a), shingles(b)
        assert len(np.unique(h.shingles(a))) == len(x)
        assert abs(minhash.likeness(h.signature(a), h.signature(b)) - len(x & y) / len(x | y)) < 0.16
    assert minhash.likeness(h.signature(""), h.signature(None)) == 1 and minhash.likeness(h.signature(""), h.signature("a")) < 0.05
    assert (h.signature("A b") == h.signature("a\tB\n")).all() and minhash.fingerprint_of(h.signature("a b c")) != minhash.fingerprint_of(h.signature("a b d"))


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_edited_texts(spark, odd, none, buckets):
    r = random.Random(6)
    rows = [(i * 3, prose(r, r.randint(0, 30)) + "é😀" * (i % 3)) for i in range(60)]
    got = {x.doc_id: x for x in minhash.edited(spark.createDataFrame(rows, "doc_id long, text string"), buckets).collect()}
    h = minhash.Hasher()
    order = sorted(rows, reverse=True)
    for (d, t), (_, o) in zip(order, order[1:] + order[:1], strict=True):
        new = t[: len(t) - len(t) // 2] + o[: len(t) // 2]
        x = got[d]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), minhash.fingerprint_of(h.signature(t)), minhash.fingerprint_of(h.signature(new)))
        assert x.near_edited == minhash.likeness(h.signature(t), h.signature(new)) and x.near_next == minhash.likeness(h.signature(t), h.signature(o))
    assert len(got) == 60 and minhash.edited(odd, buckets).count() == len(ODD) and minhash.edited(none, buckets).count() == 0
    one = minhash.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string"), buckets).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def grouped(sets, similarity=0.8):
    """Brute force: links between different sets, and the least id of each document's component."""
    ids = sorted(sets)
    links = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] and sets[b]}
    links = {k: v for k, v in links.items() if v >= similarity}
    root = {d: d for d in ids}
    empty = [d for d in ids if not sets[d]]
    for a, b in [*sorted(links), *zip(empty, empty[1:])]:
        x, y = sorted((root[a], root[b]))
        root = {d: x if r == y else r for d, r in root.items()}
    return links, root


@pytest.mark.parametrize("split", [False, True])
def test_minhash_classes_and_components(spark, odd, none, monkeypatch, split):
    if split:  # many parts, cells, heavy buckets
        for k, v in {"PART": 300, "PART_SETS": 3, "LIGHT": 4, "SHARE": 10**6}.items():
            monkeypatch.setattr(minhash, k, v)
    r = random.Random(7)
    base = [prose(r, 300) for _ in range(12)]
    near = [" ".join(t.split()[:290]) + " new words stand here now and then" for t in base]
    chain = [prose(r, 200)]
    for _ in range(6):  # each like the next, the ends unlike
        chain.append(" ".join([*chain[-1].split()[14:], *prose(r, 14).split()]))
    passage = prose(r, 80)
    common = [f"{passage} {prose(r, 60)}" for _ in range(40)]  # meet by chance in many buckets, unlike
    twins = [t[:-3] + " end of it" for t in common[:10]]
    texts = [*base, *near, *base[:3], *chain, *common, *twins, "", None, "two words", "Two\twords"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t or "") for d, t in rows}
    links, root = grouped(sets)
    found, members = minhash.near_duplicates(docs)
    m = {x.doc_id: x for x in members.collect()}
    assert {d: x.component_id for d, x in m.items()} == root and len(m) == len(rows) and len(set(root.values())) < len(rows) - 30
    assert all(x.class_id == min(e for e in sets if sets[e] == sets[d]) for d, x in m.items())
    of_class = {x.set_id: x.class_id for x in m.values()}
    got = {tuple(sorted((of_class[x.a], of_class[x.b]))): x.jaccard for x in found.collect()}
    assert got and all(links[k] == v for k, v in got.items())
    noted = {x.doc_id: x for x in minhash.fingerprinted(docs).collect()}
    plain = {x.doc_id: x for x in minhash.edited(docs).collect()}
    for d, x in noted.items():
        assert tuple(x)[:7] == tuple(plain[d]) and (x.class_id, x.component_id, x.n_links, x.jaccard) == (m[d].class_id, root[d], m[d].n_links, m[d].jaccard)
    assert minhash.fingerprinted(odd).count() == len(ODD) and minhash.fingerprinted(none).count() == 0
    same = {x.doc_id: x.component_id for x in minhash.fingerprinted(odd).collect()}
    assert same[1] == same[2] == 1 and same[4] == same[5] == 4 and same[None] is None


def test_minhash_near_copies_cost_no_pairs(spark):
    r = random.Random(8)
    words = prose(r, 400).split()
    rows = []
    for i in range(300):
        w = list(words)
        w[r.randrange(400)] = f"own{i}"
        rows.append((i, " ".join(w)))
    links, members = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.component_id for x in members.collect()} == {0} and links.count() < 300 * 12


def test_minhash_unlike_near_copies_go_to_few_cells(spark, monkeypatch):
    r = random.Random(12)
    words = prose(r, 150).split()
    rows = []
    for i in range(400):  # most are too far from each other for a link, though they meet in many buckets
        w = list(words)
        for _ in range(r.randint(1, 8)):
            w[r.randrange(150)] = prose(r, 1)
        rows.append((i, " ".join(w)))
    moved, write = [], minhash.written

    def counted(df, name):
        out = write(df, name)
        if name == "needed":
            moved.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    members = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()
    root = grouped({d: shingles(t) for d, t in rows})[1]
    assert {x.doc_id: x.component_id for x in members} == root and len(set(root.values())) > 40
    assert sum(moved) < 3 * len(rows)


# BPE


def library(path):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("ab ' \n\t1é\x1c\x85²½s😀", max_size=60) | st.text("aeiouth ", max_size=60))
def test_bpe_is_the_librarys(text):
    c = bpe.codec(MULTI, public_tokenizers.PATTERN)
    ids = c.encode(text)
    assert ids == library_of().encode_ordinary(text) and c.decode(ids) == text.encode()


_KEPT = []


def library_of():
    if not _KEPT:
        _KEPT.append(library(MULTI))
    return _KEPT[0]


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 15_000, " " * 5_000, "é" * 8_000, "th" * 9_999 + "e", LONG[:100_000]])
def test_bpe_of_long_pieces(text):
    assert bpe.codec(MULTI, public_tokenizers.PATTERN).encode(text) == library_of().encode_ordinary(text)


def test_narrow_split_is_the_wide_one():
    c, r = bpe.codec(MULTI, public_tokenizers.PATTERN), random.Random(11)
    for i in range(256):
        for text in (chr(i), f"a{chr(i)}b", f" {chr(i)}{chr(i)} 1{chr(i)}-"):
            assert c.narrow(text) == c.wide(text)
    for _ in range(3000):
        text = "".join(chr(r.choice([32, 39, 45, 115, r.randrange(256)])) for _ in range(r.randint(0, 30)))
        assert c.split(text) == c.narrow(text) == c.wide(text)
    assert c.split("a\u2003-b") == c.wide("a\u2003-b")


@pytest.mark.parametrize("window", [1, 3, 16])
def test_bpe_over_windows(monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    c, r = bpe.codec(MULTI, public_tokenizers.PATTERN), random.Random(10)
    for _ in range(300):
        b = "".join(r.choice(["a", "th", "e", "ing", "é", "ab", "x", "tion"]) for _ in range(r.randint(1, 60)))
        assert list(c.search(b.encode())) == library_of()._encode_single_piece(b)


def test_bpe_of_a_piece_of_megabytes():
    c = bpe.codec(MULTI, public_tokenizers.PATTERN)
    text = "abth" * 750_000
    tracemalloc.start()
    ids = c.search(text.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.decode(ids) == text.encode() and peak < 60e6


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    c = bpe.Bpe(bpe.load_ranks(MULTI), public_tokenizers.PATTERN)
    text = prose(random.Random(8), 500, [f"w{i}x{i * 7}" for i in range(300)])
    assert c.encode(text) == library_of().encode_ordinary(text) and len(c.pieces) <= 50 and len(c.pairs) <= 50


def test_bpe_frames(odd, none):
    r = bpe.round_trip(odd, MULTI, public_tokenizers.PATTERN).collect()
    want = sorted((d or -1, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ODD)
    assert sorted((x.doc_id or -1, x.decoded_sha256) for x in r) == want
    assert {x.doc_id: x.n_tokens for x in r}[1] == 0 and bpe.round_trip(none, MULTI, public_tokenizers.PATTERN).count() == 0
    e = bpe.encode(odd, MULTI, public_tokenizers.PATTERN)
    back = bpe.decode(e, MULTI, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(x.bytes) for x in back) == sorted((t or "").encode() for _, t, *_ in ODD)


# Packing

WORDS = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_ids_are_the_librarys():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    f = packing.encoder(WORDS, public_tokenizers.PATTERN)
    for text in ["", "Hello  world\n\n 's", "<|endoftext|> é😀", "a" * 5000, " " * 3000, LONG[:50_000], "\x00\x1c\x85 ½²"]:
        assert f(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(5) == [(0, 5)] and packing.cuts(1024) == [(0, 1024)] and packing.cuts(1025) == [(0, 1), (1, 1024)] and packing.cuts(2048) == [(0, 1024), (1024, 1024)]


def held(rows):
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = {}
    for r in rows:
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(v <= packing.SEQUENCE for v in at.values())
    return len(at)


def test_packing(spark, odd, none):
    r = random.Random(9)
    rows = [(i, prose(r, int(r.lognormvariate(5, 1)))) for i in range(300)] + [(1000 + i, "the same text again and again") for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, public_tokenizers.PATTERN).collect()
    n, total = held(got), sum(x.length for x in got)
    same = packing.pack(spark.createDataFrame([(None, "the same text")] * 3000, "doc_id long, text string"), WORDS, public_tokenizers.PATTERN).collect()
    assert held(same) <= math.ceil(sum(x.length for x in same) / packing.SEQUENCE) + 1 and len(same) == 3000
    assert n <= math.ceil(total / packing.SEQUENCE) + 3
    f = packing.encoder(WORDS, public_tokenizers.PATTERN)
    by = {(x.doc_id, x.piece): x for x in got}
    assert len(by) == len(got)
    for d, t in rows:
        ids = np.append(f(t), 2).astype("<u4")
        for k, (at, size) in enumerate(packing.cuts(len(ids))):
            x = by.pop((d, k))
            assert (x.start, x.length, x.ids_crc32) == (at, size, zlib.crc32(ids[at : at + size].tobytes()))
    assert not by
    found = packing.pack(odd, WORDS, public_tokenizers.PATTERN).collect()
    held(found)
    assert {x.doc_id for x in found} == {None, 1, 2, 3, 4, 5, 6} and sum(x.doc_id == 4 for x in found) == 2 and packing.pack(none, WORDS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_uses_every_piece_once(histogram):
    groups = packing.plan(histogram, 64)
    used = {}
    for kind, n in groups:
        assert n > 0 and sum(kind) <= 64
        for v in kind:
            used[v] = used.get(v, 0) + n
    assert used == histogram
    total = sum(k * v for k, v in histogram.items())
    # never worse than twice what any packing needs
    assert sum(n for _, n in groups) <= 2 * math.ceil(total / 64)
