"""Best-fit packing by patterns: few-document length patterns, fitted to the length histogram by non-negative least squares.

Each document is tokenised and closed by an end id; longer ones than a sequence are cut into whole sequences, the first
piece holding the rest. The histogram of piece lengths (as many rows as a sequence has tokens) is all that the driver
sees: patterns of one, two or three lengths that fill a sequence exactly are enumerated, their repeat counts fitted by
non-negative least squares, rounded and applied as far as pieces last, and what remains is packed best fit decreasing, again
by length. The plan says for each length which ranks go to which sequences; its size depends on the sequence length only.
Ranks within a length come from counts by (length, salt), so a length that most pieces share is spread over many tasks; the
number of salts grows with the documents.

Null texts count as empty (the end id alone); repeated rows are packed each; null ids are packed too and keep a null id.
Tables without rows give no rows. Texts are tokenised whole. Other columns are ignored, whatever their names.

Ids are those of the tokenizers library with the given file; they come from the same vocabulary and merges run by the
tiktoken library, which is several times faster, and from tokenizers itself where that one gives up. Strings of special
tokens inside texts are ordinary text.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import map_chunks, written

#: Salts that a length's pieces are dealt by: one for so many documents, and no fewer than SALTS.
SEQUENCE, END, SALTS, PER_SALT = 1024, 2, 256, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@functools.cache
def byte_of() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str, pattern: str):
    """text -> ids as uint32. One for each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", ())}
    ranks = {bytes(map(byte_of().__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # its matcher gives up on some very long runs of white space, by a panic
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what isn't a multiple of ``size``."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, path: str, pattern: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    def make():
        encode = encoder(path, pattern)

        def rows(x):
            out = []
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                out += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cuts(len(ids), size))]
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*out, strict=True) if out else [()] * 5, strict=True))

        return rows

    return map_chunks(docs.select("doc_id", "text"), make, PIECES)


def patterns(lengths: list[int], size: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that fill ``size`` exactly."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.arange(size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & there[a] & there[b] & there[np.maximum(c, 0)]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference between what the patterns use and ``counts``, by accelerated projected gradient.

    A length's difference weighs as much as the length: what is left of long pieces costs more sequences.
    """
    size, m = len(counts), len(rows)
    weight = np.arange(size) / size
    if not m:
        return np.zeros(0)
    use = np.ones(m)
    for _ in range(12):  # the largest eigenvalue, for the step
        hit = np.bincount(rows.ravel(), np.repeat(use, 3), size)
        use = (hit * weight)[rows].sum(1)
        top = np.linalg.norm(use)
        use /= max(top, 1e-12)
    x, y, t = np.zeros(m), np.zeros(m), 1.0
    for _ in range(steps):
        left = counts - np.bincount(rows.ravel(), np.repeat(y, 3), size)
        new = np.maximum(0, y + (left * weight)[rows].sum(1) / max(top * 1.05, 1e-12))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just these) for a histogram of piece lengths."""
    left = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    rows = patterns([n for n in histogram], size)
    x = fit(rows, left.astype(float))
    out: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        kind = [int(n) for n in rows[k] if n]
        n = min(int(round(x[k])), *(int(left[v]) // kind.count(v) for v in kind))
        if n > 0:
            out.append((tuple(kind), n))
            for v in kind:
                left[v] -= n
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # groups of like sequences by the room they have
    for n in range(size, 0, -1):
        need = int(left[n])
        for room in range(n, size + 1):
            while need and open_.get(room):
                kind, m = open_[room].pop()
                if m > need:
                    open_[room].append((kind, m - need))
                used = min(m, need)
                open_.setdefault(room - n, []).append(((*kind, n), used))
                need -= used
        each = size // n
        for count, m in ((each, need // each), (need % each, 1)):
            if count and m:
                open_.setdefault(size - count * n, []).append(((n,) * count, m))
    return out + [group for room in sorted(open_) for group in open_[room]]


def layout(groups: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), in order of length and rank."""
    out, used, sequence = [], {}, 0
    for kind, n in groups:
        offset = 0
        for v in kind:
            at = used.get(v, 0)
            out.append((v, at, n, sequence, offset))
            used[v], offset = at + n, offset + v
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, pattern: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row for each piece of each document; see PACKED."""
    salts = max(SALTS, docs.count() // PER_SALT)
    # By place, not by id, so that null and repeated ids are dealt too; written down, so that it stays.
    cut = written(pieces(docs, path, pattern, size, end).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), "pieces")
    by_salt = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by_salt.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length of a sequence
    table = layout(plan(histogram, size))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("in_salt", F.row_number().over(order) - 1).join(before, ["length", "salt"]).select(*(c.split()[0] for c in PIECES.split(", ")), (F.col("before") + F.col("in_salt")).alias("rank"))
    arrow = to_arrow_schema(_parse_datatype_string(PACKED))
    wide = int(table[:, 1].max(initial=0)) + 1

    def place(batches):
        key = table[:, 0] * wide + table[:, 1]
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, n * wide + np.minimum(r, wide - 1), "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table[k, 3] + r - table[k, 1]), pa.array(table[k, 4])], schema=arrow)

    return ranked.mapInArrow(place, PACKED)
