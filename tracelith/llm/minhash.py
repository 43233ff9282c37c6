"""Document fingerprints: MinHash over shingles of five words.

Words are runs without ASCII white space, ASCII letters lower-cased; a text of fewer words is one shingle, a text of none
has no shingle. A shingle's 32-bit key comes from polynomial word hashes, computed for a whole text at once in numpy; each
of ``PERMUTATIONS`` universal hash functions (multiply, add, keep the high half) then takes the least value over all
shingles. Equal texts have equal signatures. The fingerprint is 16 bits of each value in hex; the likeness of two
fingerprints is the share of equal places, an estimate of the Jaccard similarity of the shingle sets (standard error
below 0.045). Two texts without words are alike (1).

Near-duplicates: the fingerprint cut into 32 bands of 4 places is joined in Spark, and every link is verified by the exact Jaccard
similarity of the two shingle sets (64-bit hashes). A pair at similarity 0.8 shares no band in 5 of 10^8 cases.

Null texts count as empty; tables without rows give no rows; texts are hashed whole, shingles in blocks. Repeated rows keep their number. Null ids come after all others in ``edited``; equal ids are
ordered by text there. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from .common import CHUNK_ROWS, LIGHT, SHARE, components, discard, filter_chunks, join_dealt, map_chunks, written

WORDS, PERMUTATIONS, SEED, BANDS, SIMILARITY = 5, 128, 20240229, 32, 0.8
_SPACED = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_STEP = 1024
#: Shingles and sets of a part; rounds in which sets that meet agree on a home; bits of the filter for texts to be compared.
PART, PART_SETS, ROUNDS, BLOOM = 1 << 18, 1024, 2, 1 << 26


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Hasher:
    """Signatures of texts; one for each task, since it keeps tables and buffers."""

    def __init__(self, permutations: int = PERMUTATIONS, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 63, permutations, np.uint64) * 2 + 1)[:, None]
        self.b = r.integers(0, 1 << 63, permutations, np.uint64)[:, None]
        self.mix = r.integers(0, 1 << 63, WORDS, np.uint64) * 2 + 1
        self.buffer = np.empty((permutations, _STEP), np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, x in (("up", _BASE), ("down", _inverse(_BASE))):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def shingles(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the shingles in order, repeats included."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_SPACED), np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], raw != 32, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        w = (sums[end] - sums[start]) * self.down[start]
        w ^= w >> np.uint64(29)
        w *= np.uint64(0xBF58476D1CE4E5B9)
        w ^= w >> np.uint64(32)
        n, k = max(1, len(w) - WORDS + 1), min(WORDS, len(w))
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out += w[i : i + n] * self.mix[i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(30))

    def signature(self, text: str | None) -> np.ndarray:
        return self.least(self.shingles(text))

    def least(self, shingles: np.ndarray) -> np.ndarray:
        """32-bit minima; of an empty set the greatest values."""
        keys, best = shingles >> np.uint64(32), np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(keys), _STEP):
            part = keys[at : at + _STEP]
            h = self.buffer[:, : len(part)]
            np.multiply(self.a, part, out=h)
            np.add(h, self.b, out=h)
            np.minimum(best, h.min(1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def fingerprint_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a.astype(np.uint16) == b.astype(np.uint16)))


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each row: doc_id, text_key, set_id (64-bit hash of the set of shingles), size (distinct shingles), blocks (``BANDS`` longs: the
    fingerprint, cut; null if the same task gave it before, so that copies aren't sent on)."""

    def make():
        h, seen = Hasher(), set()

        def rows(x):
            sets, blocks, ids = [np.unique(h.shingles(t)) for t in x["text"]], [], []
            for s in sets:
                ids.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                blocks.append(None if ids[-1] in seen else h.least(s).astype("<u2").view("<i8"))
                seen.add(ids[-1])
            return {"doc_id": x["doc_id"], "text_key": x["text_key"], "set_id": ids, "size": list(map(len, sets)), "blocks": blocks}

        return rows

    return map_chunks(docs.select("doc_id", "text", text_key().alias("text_key")), make, "doc_id long, text_key long, set_id long, size int, blocks array<long>")


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with the column text as Zstandard frames: two thirds of what the shuffle's own compression makes of it."""
    schema = StructType([StructField("text", BinaryType()) if x.name == "text" else x for x in df.schema])

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            i = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts = pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in part.column(i).to_pylist()], pa.binary())
                yield part.set_column(i, "text", texts)

    return df.mapInArrow(run, schema)


def text_of_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, text: squeezed) of ``classes``, each from the one document that stands for it (its doc_id and text_key).

    A Bloom filter of ``BLOOM`` bits, whatever the number of classes, keeps most other texts from being moved; it's the one thing that is broadcast.
    """
    spark, name = docs.sparkSession, F.xxhash64("doc_id", "text_key")
    places = F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", "text_key", F.lit(i)), F.lit(BLOOM)) for i in range(3)])).alias("at")
    words = classes.select(places).groupBy(F.expr("at div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    filled = np.zeros(BLOOM // 32, np.uint32)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(filled)

    def make():
        bits = shared.value

        def wanted(x):
            at = np.array(x, np.int64).reshape(-1, 3)
            return (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).all(1)

        return wanted

    at = F.array(*[F.pmod(F.xxhash64("doc_id", "text_key", F.lit(i)), F.lit(BLOOM)) for i in range(3)]).alias("at")
    found = squeezed(filter_chunks(docs.select("doc_id", "text", text_key().alias("text_key")).select("text", name.alias("name"), at), make, "at").select("name", "text"))
    keys = classes.select("set_id", name.alias("name"))
    return found.join(keys.hint("merge"), "name").dropDuplicates(["set_id"]).select("set_id", "text")


def met_in_bands(own: DataFrame) -> DataFrame:
    """(key, set_id, head) of the sets that share a band with another; head (weight, set_id) is the bucket's most central set, that with most sets
    in all its buckets: near copies of one text mostly have the same head, whichever bucket they meet in. The key's last bits are the band's number.

    Band rows move once. Buckets that a sample of some 100,000 rows shows to be heavy are split by set, their sets taken together
    afterwards; the sample decides only how rows are dealt, never which are kept.
    """
    rows = own.where("blocks is not null and size > 0").select("set_id", F.posexplode("blocks").alias("band", "block")).select("set_id", F.expr(f"xxhash64(band, block) div {BANDS} * {BANDS}").bitwiseOR(F.col("band").cast("long")).alias("key"))
    n = BANDS * own.count()
    few, share = max(LIGHT, n // SHARE), min(1.0, 100 * SHARE / max(n, 1))
    heavy = written(rows.sample(share, SEED).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > few * share).select(F.col("key").alias("hot"), F.ceil(F.col("n") / (few * share)).cast("int").alias("salts")), "heavy")
    salted = rows.join(F.broadcast(heavy), F.col("key") == F.col("hot"), "left")
    dealt = salted.select("set_id", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64("hot", F.pmod(F.xxhash64("set_id"), "salts").cast("int"))).alias("key"))
    bucket = Window.partitionBy("key")
    ordered = bucket.orderBy("set_id")
    split = heavy.select("hot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("hot", F.xxhash64("hot", "salt").alias("key"))
    met = (
        dealt.withColumns({"first": F.first("set_id").over(ordered), "last": F.max("set_id").over(bucket), "prior": F.lag("set_id").over(ordered)})
        .where("prior is null or prior <> set_id").join(F.broadcast(split), "key", "left").where("hot is not null or last <> first")
    )
    met = written(met.select(F.coalesce("hot", "key").alias("key"), "set_id"), "met")
    n = met.count()
    sizes = written(met.groupBy("key").agg(F.count("*").alias("n")).select("key", F.col("n").alias("sets"), "n"), "sizes")
    weights = join_dealt(met, sizes, ["key"], n, by=["set_id"]).groupBy("set_id").agg(F.sum("sets").alias("weight"))
    weighed = written(met.join(weights, "set_id"), "weighed")
    heads = written(weighed.groupBy("key").agg(F.max(F.struct("weight", "set_id")).alias("head"), F.count("*").alias("n")), "heads")
    buckets = written(join_dealt(weighed.select("key", "set_id"), heads, ["key"], n, by=["set_id"]), "buckets")
    discard(heavy, met, sizes, weighed, heads)
    return buckets


def parts(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, part, size): sets that meet are mostly in one part, and a part holds some ``PART`` shingles of ``PART_SETS`` sets at most, or one longer set.

    A set's home is the weightiest head of its buckets. Those who meet take the weightiest home among them, ``ROUNDS`` times: else a few
    sets at a family's edge would have parts of their own, and each would call the whole family into its cell.
    """
    n, rows = met.count(), met.select("key", "set_id")
    homes = written(met.groupBy("set_id").agg(F.max("head").alias("home")), "homes")
    for _ in range(ROUNDS):
        by_key = written(rows.join(homes, "set_id").groupBy("key").agg(F.max("home").alias("home"), F.count("*").alias("n")), "by_key")
        new = written(join_dealt(rows, by_key, ["key"], n, by=["set_id"]).groupBy("set_id").agg(F.max("home").alias("home")), "homes")
        discard(homes, by_key)
        homes = new
    sized = written(homes.select("set_id", F.col("home.set_id").alias("home")).join(classes.select("set_id", "size"), "set_id"), "sized")
    by_home = written(sized.groupBy("home").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.sum("size") / PART, F.count("*") / PART_SETS)).cast("int").alias("of")), "by_home")
    placed = join_dealt(sized, by_home, ["home"], sized.count(), by=["set_id"])
    placed = written(placed.select("set_id", F.xxhash64("home", F.pmod(F.xxhash64("set_id"), "of")).alias("part"), "size"), "parts")
    discard(homes, sized, by_home)
    return placed


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the distinct ``pairs`` (a, b: set ids; pa, pb: their parts) whose sets have the similarity, counted exactly.

    The pairs of two parts are a cell. A set goes to each of its cells once, whatever the number of its pairs there; a cell holds two parts, so its size is bounded.
    """
    cell = [F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y")]
    pairs = written(pairs.select("a", "b", *cell), "pairs")
    needed = written(pairs.select("x", "y", F.col("a").alias("set_id")).union(pairs.select("x", "y", "b")).distinct(), "needed")

    def count(links: pa.Table, held: pa.Table) -> pa.Table:
        ids, sets = held["set_id"].to_numpy(), _unpacked(held, Hasher(1))
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, links[c].to_numpy(), sorter=order)] for c in "ab")
        return _linked(ids, sets, a, b, similarity)

    named, texts = _texts(needed, docs, classes)
    shipped = needed.join(texts, "set_id")
    links = written(pairs.groupBy("x", "y").cogroup(shipped.groupBy("x", "y")).applyInArrow(count, LINKS), "links")
    discard(pairs, needed, named)
    return links


def across(open_: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the sets of ``open_`` (key, set_id, root, part) that share a band, lie in different components and have the similarity.

    Parts that meet in a bucket with several components are a cell; its sets are compared there, so that no candidate pair is ever a row.
    Those whose fingerprints agree in fewer places than six standard errors below the similarity leave likely aren't counted (3 of 10^8 pairs at 0.8 are lost).
    """
    least = (similarity - 6 * (similarity * (1 - similarity) / PERMUTATIONS) ** 0.5) * PERMUTATIONS
    here = open_.groupBy("key", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = here.toDF("key", "x", "low_x", "high_x"), here.toDF("key", "y", "low_y", "high_y")
    cells = x.join(y, "key").where("x <= y and least(low_x, low_y) <> greatest(high_x, high_y)").select("x", "y").distinct()
    sides = cells.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    needed = written(sides.join(open_.select("set_id", "root", "part").distinct(), "part"), "needed")

    def compare(held: pa.Table) -> pa.Table:
        h = Hasher()
        ids, root, part = (held[c].to_numpy() for c in ("set_id", "root", "part"))
        sets = _unpacked(held, h)
        prints = np.array([h.least(s) for s in sets]).astype("<u2")
        bands, size, within = prints.view("<i8"), np.array(list(map(len, sets))), held["x"][0] == held["y"][0]
        found = []
        for i in range(len(ids)):
            may = (root != root[i]) & (ids > ids[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
            may = np.flatnonzero(may if within else may & (part != part[i]))
            may = may[(bands[may] == bands[i]).any(1)]
            found.append(may[(prints[may] == prints[i]).sum(1) >= least])
        return _linked(ids, sets, np.repeat(np.arange(len(ids)), list(map(len, found))), np.concatenate(found), similarity)

    named, texts = _texts(needed, docs, classes)
    links = written(needed.join(texts, "set_id").groupBy("x", "y").applyInArrow(compare, LINKS), "links")
    discard(needed, named)
    return links


LINKS = "a long, b long, jaccard double"


def _texts(needed: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = written(classes.select("set_id", "doc_id", "text_key").join(needed.select("set_id").distinct(), "set_id"), "named")
    return named, text_of_sets(docs, named).hint("merge")


def _unpacked(held: pa.Table, h: Hasher) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.unique(h.shingles(unpack(t.as_py()).decode("utf-8", "surrogatepass"))) for t in held["text"]]


def _linked(ids: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> pa.Table:
    """The pairs of places ``a``, ``b`` whose sets have the similarity."""
    size = np.array(list(map(len, sets)))
    edge = np.concatenate(([0], np.cumsum(size)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, shared = np.zeros(codes.max() + 1, bool), np.zeros(len(a), np.int64)
    by = np.argsort(a, kind="stable")
    for one in np.split(by, np.flatnonzero(np.diff(a[by])) + 1) if len(by) else ():
        mine = codes[edge[a[one[0]]] : edge[a[one[0]] + 1]]
        mark[mine] = True
        for i in one:
            shared[i] = np.count_nonzero(mark[codes[edge[b[i]] : edge[b[i] + 1]]])
        mark[mine] = False
    jaccard = shared / (size[a] + size[b] - shared)
    return pa.table({"a": ids[a], "b": ids[b], "jaccard": jaccard}).filter(pa.array(jaccard >= similarity, pa.bool_()))


def _alike(x: str, y: str, similarity: float) -> F.Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between classes, and membership.

    Texts with equal shingle sets form a class; texts without words are one. Returns ``(links, members)``: links (a, b, jaccard)
    of classes (set_id) whose exact Jaccard similarity is ``similarity`` at least; members (doc_id, text_key, set_id, class_id,
    component_id, n_links, jaccard), one row for each row: class_id and component_id are the least doc_id of the class and of
    its component under the links (null if it has no other id), n_links counts the class's links, jaccard is the greatest of them.

    Classes that share a band are candidates. Each is held against the most central class of its bucket first, so that near copies
    of one another cost one comparison each and not one for each pair. What then lies in different components though it shares a bucket is
    compared within the task of its cell, so that every two candidates end in one component if a chain of verified links joins them.
    """
    own = written(signatures(docs), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = written(own.groupBy("set_id").agg(least.alias("of"), F.count("*").alias("n"), F.max("size").alias("size")).select("set_id", "of.doc_id", "of.text_key", "n", "size"), "classes")
    met = met_in_bands(own)
    placed = parts(met, classes)
    with_head = written(met.where("set_id <> head.set_id").select(F.col("head.set_id").alias("a"), F.col("set_id").alias("b")).distinct(), "with_head")
    heads = with_head.groupBy("a").agg(F.count("*").alias("n")).join(placed.toDF("a", "pa", "na"), "a")
    pairs = join_dealt(with_head.join(placed.toDF("b", "pb", "nb"), "b"), heads, ["a"], with_head.count(), by=["b"]).where(_alike("na", "nb", similarity))
    links = verified(pairs, docs, classes, similarity)
    # The rest: buckets that hold several components.
    roots = written(components(links.select("a", "b")).toDF("set_id", "root"), "roots")
    rooted = written(_rooted(met.select("key", "set_id"), roots), "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_ = written(rooted.join(several, "key").join(placed.select("set_id", "part"), "set_id"), "open")
    more = across(open_, docs, classes, similarity)
    links = links.union(more)
    ends = links.select(F.col("a").alias("set_id"), "jaccard").union(links.select("b", "jaccard")).groupBy("set_id").agg(F.count("*").alias("n_links"), F.max("jaccard").alias("jaccard"))
    whole = components(links.select("a", "b")).toDF("set_id", "root")
    grouped = written(_rooted(classes.select("set_id", "doc_id", "n"), whole).join(ends, "set_id", "left"), "grouped")
    by_root = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = join_dealt(grouped.withColumnRenamed("n", "n_rows"), written(by_root, "components"), ["root"], classes.count(), by=["set_id"])
    by_set = named.select("set_id", F.col("doc_id").alias("class_id"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "jaccard", F.col("n_rows").alias("n"))
    members = join_dealt(own.select("doc_id", "text_key", "set_id"), written(by_set, "by_set"), ["set_id"], own.count())
    discard(met, placed, with_head, roots, rooted, open_)
    return links, members


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (set_id, ...) with their component's root; a set without links is its own. Copies of a set are few (one for each band)."""
    return rows.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NOTES = "class_id long, component_id long, n_links long, jaccard double"
_LEAST = -(1 << 63)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """What ``edited`` gives, with each row's class, component and links from ``near_duplicates``."""
    return edited(docs, members=near_duplicates(docs)[1])


def edited(docs: DataFrame, buckets: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text: the last half of it replaced by the start of the next document.

    Next is the document that follows by descending id, after the last the first. Texts move once: they are dealt by ranges of
    ids, whose bounds are quantiles; a range's first document also goes to the range before it, so that each task has all
    its rows' successors and no task orders the whole table. Only the bounds and one id for each range reach the driver.
    With ``members`` (doc_id, text_key and the columns of ``NOTES``) these columns follow: the short rows go to the same ranges, each right
    before the texts it tells of, so that texts aren't moved again to join them.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", text_key().alias("text_key")).withColumn("k", F.coalesce("doc_id", F.lit(_LEAST)))
    splits = [] if buckets == 1 else sorted({int(x) for x in keyed.select("k").approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.1 / buckets)}, reverse=True)
    bounds = F.array(*map(F.lit, splits)) if splits else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda s: s > F.col("k"))).alias("bucket")
    heads = sorted(keyed.select("k", bucket).groupBy("bucket").agg(F.max("k").alias("k")).collect())
    schema = EDITED if members is None else f"{EDITED}, {NOTES}"
    if not heads:
        return spark.createDataFrame([], schema)
    before = spark.createDataFrame([(h.k, heads[i - 1].bucket) for i, h in enumerate(heads)], "k long, guest_in int")
    note, plain = [x.split()[0] for x in NOTES.split(", ")], members is None
    texts = (
        squeezed(keyed.select("*", bucket)).join(F.broadcast(before), "k", "left")
        .select("*", F.explode(F.expr("if(guest_in is null, array(struct(bucket, false as guest)), array(struct(bucket, false as guest), struct(guest_in as bucket, true as guest)))")).alias("at"))
        .select("doc_id", "text", "text_key", "k", "at.bucket", "at.guest", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':') for x in NOTES.split(', '))}>").alias("note"))
    )
    if members is not None:
        short = members.withColumn("k", F.coalesce("doc_id", F.lit(_LEAST))).select("doc_id", F.lit(None).cast("binary").alias("text"), "text_key", "k", bucket, F.lit(False).alias("guest"), F.struct(*note).alias("note"))
        texts = texts.unionByName(short)
    dealt = (
        texts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc("k"), F.col("doc_id").isNull(), "text_key", F.col("note").isNull(), "text")
        .select("doc_id", "text", "bucket", "guest", "note")
    )
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        h, unpack = Hasher(), zstandard.ZstdDecompressor().decompress
        held = closed = noted = None  # the row that waits for its successor; the bucket that is done with; what is known of the next texts

        def result(row, after):
            (doc_id, text, sig, more), (_, other, other_sig, _) = row, after
            half = len(text) // 2
            new = text[: len(text) - half] + other[:half]
            s = h.signature(new)
            return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_of(sig), fingerprint_of(s), likeness(sig, s), likeness(sig, other_sig), *more

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, text, bucket, guest, now in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if now is not None:
                        noted = now
                        continue
                    if guest and closed == bucket:
                        continue
                    text = unpack(text).decode("utf-8", "surrogatepass")
                    row = doc_id, text, h.signature(text), () if plain or guest else tuple(noted[c] for c in note)
                    if held is not None:
                        out.append(result(held, row))
                    held, closed = (None, bucket) if guest else (row, None)
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), arrow)] if out else [pa.array([], x.type) for x in arrow], schema=arrow)

    return dealt.mapInArrow(run, schema)
