"""License scan: an exact set-similarity join of text blocks with license templates, beside literal base phrases.

A block is a line of a text; with ``wrapped``, as the query has it, also any words in sequence that span line breaks, up to
``SPAN`` times as many as the template has, so that a hard-wrapped notice is found (of whole lines joined, long ones would
meet by words that stand far from the notice). A block's tokens are the distinct words (ASCII letters lower-cased, everything that is neither an
ASCII letter or digit nor beyond ASCII separates words). A block meets a template if it holds at least ``ceil(threshold *
size)`` of the template's distinct tokens. Candidates come from prefixes in a global order, rarest token of the corpus
first: of a template of n tokens of which k are needed, any block that meets it holds one of the first n - k + 1. Length
(the block has k distinct words at least) and position (what is left of the template can still reach k) filter before
the exact count. All blocks that meet a template are found; the filters lose none. ``n_blocks`` counts the lines that
meet a template, and the least runs of lines that hold such words in sequence and no line that meets the template alone.

Null texts count as empty; empty texts give zero words and no labels; rows are kept one for one, also repeated ones and
those whose doc_id is null; tables without rows give no rows. Texts are read whole, in time linear in their length and their phrases'
places. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks

#: Phrases whose words must stand consecutively, with their labels (fixed values of the contract).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Our own templates: label and the words of a notice.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nd-notice": "licensed under cc by nd 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "licensed under the gnu lesser general public license",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.9
#: Longest block across lines, in words of the template: room for words of comment marks and the like.
SPAN = 1.5
#: Templates travel to every task inside the function; beyond this size ``scan`` refuses.
MAX_TEMPLATE_BYTES = 1 << 20

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def token_counts(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of ``tokens`` (a bounded list) stands in all texts; one row for each token reaches the driver."""
    wanted = {t.encode() for t in tokens}

    def make():
        def count(x):
            n: dict[bytes, int] = {}
            for text in x["text"]:
                for w in words_of(text):
                    if w in wanted:
                        n[w] = n.get(w, 0) + 1
            return {"token": [k.decode() for k in n], "n": list(n.values())}

        return count

    found = map_chunks(docs.select("text"), make, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {t: 0 for t in tokens} | {r.token: r.n for r in found.collect()}


class Prefixes:
    """Prefix index over templates, tokens in ascending global frequency (ties by the token)."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float):
        sets = {label: set(words_of(text)) for label, text in sorted(templates.items())}
        ranked = sorted(set().union(*sets.values()), key=lambda w: (counts.get(w.decode(), 0), w))
        self.order = {w: i for i, w in enumerate(ranked)}
        self.rows, self.index = [], {}
        for label, tokens in sets.items():
            if not tokens:
                continue
            ordered, need = sorted(tokens, key=self.order.__getitem__), max(1, math.ceil(round(threshold * len(tokens), 9)))
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(w, []).append((len(self.rows), i))
            self.rows.append((label, ordered, need))
        self.keys = frozenset(self.index)
        self.sets = {label: (frozenset(tokens), need, math.ceil(SPAN * len(words_of(templates[label])))) for label, tokens, need in self.rows}

    def meets(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Each template that the block of these words meets, with the share of its tokens that the block holds."""
        there = {w for w in words if w in self.order}
        block, out, seen = sorted(there, key=self.order.__getitem__), [], set()
        for j, w in enumerate(block):
            for k, i in self.index.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                label, tokens, need = self.rows[k]
                # Length: the block holds enough of the templates' words. Position: w is the first word in common, so all others come later in both.
                if len(block) < need or min(len(tokens) - i, len(block) - j) < need:
                    continue
                if (n := sum(t in there for t in tokens)) >= need:
                    out.append((label, n / len(tokens)))
        return out

    def wrapped(self, lines: list[list[bytes]], labels: list[str]) -> tuple[list[tuple[str, float]], int]:
        """Which of the templates of ``labels`` words in sequence across lines meet, with the greatest share; how many least runs of lines hold such words."""
        out, runs = [], set()
        for label in labels:
            tokens, need, span = self.sets[label]
            alone = [len(tokens.intersection(x)) >= need for x in lines]
            places, at = [], 0
            for i, line in enumerate(lines):
                places += [(at + k, i, w) for k, w in enumerate(line) if w in tokens]
                at += len(line)
            own: list[tuple[int, int]] = []
            most = end = 0
            held: dict[bytes, int] = {}
            for start, i, w in places:
                while end < len(places) and places[end][0] < start + span:
                    held[places[end][2]] = held.get(places[end][2], 0) + 1
                    end += 1
                if len(held) >= need and places[end - 1][1] > i:
                    most = max(most, len(held))
                    seen: set[bytes] = set()
                    for _, j, x in places[bisect.bisect_left(places, (start,)) : end]:
                        seen.add(x)
                        if len(seen) >= need:
                            break
                    # Starts and ends ascend, so a run can only hold one that starts or ends with it.
                    if not any(alone[i : j + 1]):
                        if own and own[-1][1] == j:
                            own[-1] = (i, j)
                        elif not own or own[-1][0] < i:
                            own.append((i, j))
                held[w] -= 1
                if not held[w]:
                    del held[w]
            if most:
                out.append((label, most / len(tokens)))
            runs.update(own)
        return out, len(runs)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None, wrapped: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text); see SCHEMA. ``score``: 1 if a phrase stands there, else the best share of a met template, else 0."""
    templates, phrases = templates or TEMPLATES, phrases or BASE
    if sum(map(len, templates.values())) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_BYTES} bytes")
    tokens = sorted({w.decode() for t in templates.values() for w in words_of(t)})
    counts = token_counts(docs, tokens)

    def make():
        index = Prefixes(templates, counts, threshold)
        base = [(label, p.encode().split(), b" " + p.encode() + b" ") for p, label in phrases.items()]

        def one(text):
            flat = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP)
            words = flat.split()
            there = set(words)
            places, kinds = [], set()
            if any(all(w in there for w in ws) for _, ws, _ in base):
                joined = b" " + b" ".join(words) + b" "
                for label, ws, p in base:
                    at, last, n = joined.find(p), 0, 0
                    while at >= 0:
                        n += joined.count(b" ", last, at)  # words before, counted on from the place before
                        places.append(n)
                        kinds.add(label)
                        at, last = joined.find(p, at + 1), at
            more, best, blocks = set(), 1.0 if places else 0.0, 0
            if not index.keys.isdisjoint(there):
                lines = [line.split() for line in flat.split(b"\n")]
                for line in lines:
                    if found := index.meets(line):
                        blocks += 1
                        more.update(x for x, _ in found)
                        best = max(best, max(s for _, s in found))
                # What the whole text doesn't meet, no part of it meets.
                if wrapped and len(lines) > 1 and (all_of := index.meets(words)):
                    found, n = index.wrapped(lines, [x for x, _ in all_of])
                    blocks += n
                    more.update(x for x, _ in found)
                    best = max([best, *(s for _, s in found)])
            return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(kinds)), ",".join(sorted(kinds | more)), best, blocks

        def rows(x):
            cols = list(zip(*map(one, x["text"]))) or [()] * 8
            return dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"), cols)) | {"doc_id": x["doc_id"]}

        return rows

    return map_chunks(docs.select("doc_id", "text"), make, SCHEMA)
