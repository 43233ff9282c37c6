"""SimHash near-duplicates: fingerprints within 2 bits of one another, found through a segment-popcount embedding.

Words are runs without ASCII white space (ASCII letters lower-cased), shingles 3 words. A fingerprint is cut into 16
segments of 4 bits; their bit counts are a point of a grid. Two fingerprints that differ in d bits lie at a Manhattan
distance of d at most, so the range join at distance 2 loses no link: every point goes to its own cell and to the 32
cells one step away, and two points at distance 2 or less meet in at least one cell. Within a cell they are verified
exactly by the values there that differ from them in one bit or none: two fingerprints differ in 2 bits or fewer if and
only if they share such a value. A value's members are linked to the least of them, all of which are links, so that work
is linear (65 rows for each distinct fingerprint) in a cell or a group however large, and pairs are never made.

The join runs over distinct fingerprints. Null texts count as empty; texts without words have fingerprint zero and
link like any other; repeated rows share a fingerprint and so a component; a null doc_id keeps its row, is never a
component's id unless all are null (then null). Tables without rows give no rows. Texts are read whole, in blocks of
words. ``near_duplicates`` ignores other columns; ``one_of_each`` keeps them, and names of its own begin with ``_tracelith_``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_dealt, map_chunks, written

WORDS, SEGMENTS, BITS, DISTANCE = 3, 16, 4, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that separate words; bytes.split() takes just these: space and \x09-\x0D.
_BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """Unsigned; each bit is the majority over the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    h, digest, n = xxhash.xxh64_intdigest, b" ".join, max(1, len(words) - WORDS + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):  # bounded memory for texts of any length
        part = words[at : min(at + _BLOCK, n) + WORDS - 1]
        if len(part) < WORDS:
            hashes = [h(digest(part), 42)]
        else:
            hashes = [h(b"%b %b %b" % x, 42) for x in zip(part, part[1:], part[2:])]
        votes += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(sum(1 << i for i in np.flatnonzero(votes * 2 > n).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) and any other columns of ``docs`` but the text: fp as a signed long."""

    def make():
        def rows(x):
            return x | {"fp": [f - (1 << 64) if f >> 63 else f for f in map(fingerprint, x["text"])]}

        return rows

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return map_chunks(docs, make, ", ".join([*kept, "fp long"]))


def point(fp: str) -> str:
    """SQL: the grid point of a fingerprint as a long, 3 bits for each segment's count of 0 to 4."""
    return " + ".join(f"shiftleft(cast(bit_count(shiftrightunsigned({fp}, {BITS * i}) & 15L) as bigint), {3 * i})" for i in range(SEGMENTS))


def meeting_places(fp: str = "fp") -> F.Column:
    """Where a fingerprint looks for others: (cell, value) for its own cell and the 32 one step away, each with the values there that differ from it in one bit or none."""
    return F.expr(f"transform(concat(array({fp}), transform(sequence(0, 63), i -> {fp} ^ shiftleft(1L, i))), v -> struct({point('v')} as cell, v as value))")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, whose components are those of all links at ``DISTANCE`` bits or fewer."""
    # Few bytes become many rows: dealt to all tasks first, for by size they would be in a few.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = fps.select("fp", F.explode(meeting_places()).alias("at")).select("fp", "at.cell", "at.value")
    shared = rows.groupBy("cell", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared.hint("merge"), ["cell", "value"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def by_fingerprint(own: DataFrame) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint, named by its least member."""
    fps = own.select("fp").distinct()
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    own = written(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    with_root = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(by_fingerprint(own), "fp"), "roots")
    by_root = written(with_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    n = own.count()
    by_fp = join_dealt(with_root.withColumnRenamed("n", "n_rows"), by_root, ["root"], n, by=["fp"]).select("fp", "component_id", F.col("n_rows").alias("n"))
    return join_dealt(own, written(by_fp, "components"), ["fp"], n).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group: the least doc_id (null last), then the least hash of the text; of repeated rows one."""
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = written(fingerprints(docs.select("doc_id", "text", text_key.alias("text_key"))), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    by_fp = own.groupBy("fp").agg(first.alias("first")).join(by_fingerprint(own), "fp")
    kept = by_fp.groupBy("root").agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(0)).alias("id_key"), "first.no_id", "first.text_key")
    keys = [f"_tracelith_{c}" for c in kept.columns]
    keyed = docs.withColumns(dict(zip(keys, (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), text_key), strict=True)))
    return keyed.join(kept.toDF(*keys), keys, "left_semi").dropDuplicates(keys).select(docs.columns)
