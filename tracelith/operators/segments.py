"""Linear segments of integer sequences: greedy runs of (start, step, length), as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(values: DataFrame, key: list[str], order: str = "i", value: str = "v") -> DataFrame:
    """For each ``key``: segment (number), start, step, length, greedily from the left.

    Differences are cut into greatest runs of equal ones. A run of two or more always ends what stands before it; single
    differences between pair up from the left, as the greedy walk does, and what is left over is a segment of one value.
    """
    w = Window.partitionBy(*key).orderBy(order)
    rows = values.select(*key, F.col(order).alias("i"), F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("at"), F.lead(value).over(w).alias("next"))
    diffs = rows.where("next is not null").withColumn("step", F.col("next") - F.col("v"))
    wi = Window.partitionBy(*key).orderBy("at")
    runs = (
        diffs.withColumn("new", F.coalesce((F.col("step") != F.lag("step").over(wi)).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(wi.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "run").agg(F.min("at").alias("a"), F.count("*").alias("n"), F.first("step").alias("step"), F.min_by("v", "at").alias("v0"), F.min_by("next", "at").alias("v1"))
    )
    wr = Window.partitionBy(*key).orderBy("run")
    grouped = runs.withColumn("grp", F.coalesce(F.sum((F.col("n") >= 2).cast("int")).over(wr.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    odd = grouped.withColumn("m", F.row_number().over(Window.partitionBy(*key, "grp").orderBy("run")) - 1)
    skip = F.when(F.col("grp") == 0, F.col("m") % 2 == 1).otherwise(F.col("m") % 2 == 0)
    found = odd.withColumn("skip", skip).where(~(F.col("skip") & (F.col("n") == 1))).select(
        *key, F.when(F.col("skip"), F.col("a") + 1).otherwise(F.col("a")).alias("at"), F.when(F.col("skip"), F.col("v1")).otherwise(F.col("v0")).alias("start"),
        "step", F.when(F.col("skip"), F.col("n")).otherwise(F.col("n") + 1).alias("length"),
    )
    ends = found.groupBy(*key).agg(F.max(F.col("at") + F.col("length")).alias("covered"))
    last = rows.where("next is null").select(*key, "at", F.col("v").alias("start"))
    left = F.col("covered").isNull() | (F.col("covered") <= F.col("at"))
    single = last.join(ends, key, "left").where(left).select(*key, "at", "start", F.lit(0).cast("bigint").alias("step"), F.lit(1).cast("bigint").alias("length"))
    every = found.union(single)
    return every.select(*key, (F.row_number().over(wi) - 1).cast("bigint").alias("segment"), "start", "step", "length")


def expand(segments: DataFrame, key: list[str]) -> DataFrame:
    """The values of segments: key, segment, j (place in the segment), v."""
    return segments.select(*key, "segment", "start", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("j")).select(*key, "segment", "j", (F.col("start") + F.col("step") * F.col("j")).alias("v"))


def value_at(segments: DataFrame, index: int, key: list[str]) -> DataFrame:
    """The value at ``index`` of each sequence; no row beyond its end."""
    w = Window.partitionBy(*key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("from", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return placed.where((F.col("from") <= index) & (index < F.col("from") + F.col("length"))).select(*key, (F.col("start") + F.col("step") * (index - F.col("from"))).alias("v"))
