"""Exact top-k by inner product over an impact-ordered index, processed score at a time.

Vectors are turned into integers, floor(scale * x). Candidates are dealt into blocks of about ``BLOCK`` rows; a block's index
holds for each dimension its rows in segments of like impact: how far a component lies above the block's least one (for
queries with a positive weight there) or below its greatest one (negative weight), in ``LEVELS`` steps. For a query all
segments of all dimensions are taken by descending weight times impact, and each adds its lower bound to its rows' sums.
At any time a row's score is at most its sum plus what every dimension can still add; rows for which this is less than the k-th
greatest sum can't be members. Processing stops only when that proof leaves few rows (or nothing is left to process), and
these are scored exactly, so that the result is exact whenever it stops.

Candidates are shuffled once; queries go to every block and stream past its index, so that a task holds one block and one
batch of queries. Each block gives at most k rows for each query.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors of different lengths are compared
on the dimensions they share. A row isn't a candidate for queries with its own id; rows that repeat an id are candidates
each, and one query (of their least vector). Null ids take no part. Ties go to the smaller id. Sums must fit 64 bits. Tables
without rows or without queries give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BLOCK, LEVELS, PACE, QUERIES, LEAST = 16_384, 8, 64, 256, 2048
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v: array of longs) of the vectors that take part."""
    good = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return vectors.where(good).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("v"))


class Index:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        self.ids, self.rows = ids, rows
        self.low, self.high = rows.min(0), rows.max(0)
        self.step = (self.high - self.low) // levels + 1
        # Segments of both directions: dimension, direction, level, the next lower level held there (-1: none), and rows.
        facts, self.members = [], []
        for sign in (1, -1):
            level = ((rows - self.low) if sign > 0 else (self.high - rows)) // self.step
            order = np.argsort(-level, 0, kind="stable")
            for d in range(rows.shape[1]):
                held = level[order[:, d], d]
                cut = np.flatnonzero(np.diff(held)) + 1
                firsts = held[np.concatenate(([0], cut))].tolist()
                facts += [(d, sign, x, y) for x, y in zip(firsts, [*firsts[1:], -1])]
                self.members += np.split(order[:, d], cut)
        self.dim, self.sign, self.level, self.after = np.array(facts, np.int64).T

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, best first; a row whose id is ``own`` is left out."""
        n, dims = self.rows.shape
        q = np.zeros(dims, np.int64)
        q[: min(dims, len(query))] = query[:dims]
        weight, mine, sums = np.abs(q), np.flatnonzero(self.ids == own), np.zeros(n, np.int64)
        if n == len(mine):
            return self.ids[:0], sums[:0]
        use = np.flatnonzero(q[self.dim] * self.sign > 0)
        d = self.dim[use]
        adds = weight[d] * self.level[use] * self.step[d]
        # What a dimension adds at most: to rows not yet met there, the next segment's greatest value; to those met, what rounding took off.
        slack = weight * (self.step - 1)
        limits = np.where(self.after[use] >= 0, np.maximum(slack[d], weight[d] * ((self.after[use] + 1) * self.step[d] - 1)), slack[d])
        most = (weight * (self.high - self.low)).tolist()
        room, few, possible, order = sum(most), max(4 * k, n // 64), None, np.argsort(-adds, kind="stable")
        for i, (add, dim, limit, segment) in enumerate(zip(adds[order].tolist(), d[order].tolist(), limits[order].tolist(), use[order].tolist(), strict=True)):
            if add:
                sums[self.members[segment]] += add
            room += limit - most[dim]
            most[dim] = limit
            if i % PACE == PACE - 1:
                possible = self._possible(sums, mine, room, k)
                if np.count_nonzero(possible) <= few:
                    break
        else:
            possible = self._possible(sums, mine, room, k)
        keep = np.flatnonzero(possible)
        scores = self.rows[keep] @ q
        best = np.lexsort((self.ids[keep], -scores))[:k]
        return self.ids[keep][best], scores[best]

    def _possible(self, sums: np.ndarray, mine: np.ndarray, room: int, k: int) -> np.ndarray:
        """Rows that may still be among the k best."""
        sums[mine] = -1  # below all others
        n = len(sums)
        at = max(0, int(np.partition(sums, n - k)[n - k])) if n > k else 0
        out = sums >= at - room
        out[mine] = False
        return out


def _matrix(lists: list[list[int]]) -> np.ndarray:
    width = max(map(len, lists))
    if all(len(x) == width for x in lists):
        return np.array(lists, np.int64)
    return np.array([x + [0] * (width - len(x)) for x in lists], np.int64)


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """For each id divisible by ``every`` its ``k`` best rows: query_id, rank, vec_id, score."""
    rows = integers(vectors, scale)
    n, tasks = rows.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block), min(tasks, n // LEAST))  # smaller ones as long as tasks would lie idle
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    dealt = (
        rows.select(own.alias("block"), F.lit(False).alias("query"), "vec_id", "v")
        .union(queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True), "vec_id", "v"))
        .repartition(2 * blocks, "block").sortWithinPartitions("block", "query", "vec_id")
    )
    arrow = to_arrow_schema(_parse_datatype_string(FOUND))

    def run(batches):
        now, ids, lists, index = None, [], [], None
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                out = ([], [], [])
                for which, query, vec_id, v in zip(*(c.to_pylist() for c in b.slice(at, QUERIES).columns), strict=True):
                    if which != now:
                        now, ids, lists, index = which, [], [], None
                    if not query:
                        ids.append(vec_id)
                        lists.append(v)
                    elif ids:
                        if index is None:
                            index = Index(np.array(ids, np.int64), _matrix(lists))
                            lists = []
                        found, scores = index.search(np.array(v, np.int64), k, vec_id)
                        out[0].extend([vec_id] * len(found))
                        out[1].extend(found.tolist())
                        out[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, arrow)], schema=arrow)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
