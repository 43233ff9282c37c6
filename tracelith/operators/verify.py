"""Comparison of two traces as multisets of events by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fingerprint
from .encode import STREAM

#: How many examples a report shows.
MISMATCHES, STREAM_DIFFS = 5, 10


def stream_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*STREAM).agg(F.count("*").alias("n"))


def fingerprints(events: DataFrame) -> DataFrame:
    """How often each event stands in each stream. The fingerprint is hashed for the shuffle and compared as 256 bits."""
    return events.groupBy(*STREAM, F.sha2(fingerprint(), 256).alias("fp")).agg(F.count("*").alias("n"))


def _same(keys: tuple[str, ...]) -> F.Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def counts_side_by_side(original: DataFrame, restored: DataFrame) -> DataFrame:
    """(stream, fp, o, r): counts of either side, 0 where an event is missing."""
    keys = (*STREAM, "fp")
    return (
        fingerprints(original).alias("o").join(fingerprints(restored).alias("r"), _same(keys), "full_outer")
        .select(*(F.coalesce(f"o.{k}", f"r.{k}").alias(k) for k in keys), F.coalesce("o.n", F.lit(0)).alias("o"), F.coalesce("r.n", F.lit(0)).alias("r"))
    )


def missing_streams(original: DataFrame, restored: DataFrame) -> DataFrame:
    """Streams of ``original`` that ``restored`` lacks."""
    a, b = original.select(*STREAM).distinct(), restored.select(*STREAM).distinct()
    return a.alias("o").join(b.alias("r"), _same(STREAM), "left_anti")


def extra_streams(original: DataFrame, restored: DataFrame) -> DataFrame:
    return missing_streams(restored, original)


def stream_count_diffs(original: DataFrame, restored: DataFrame) -> DataFrame:
    both = stream_counts(original).alias("o").join(stream_counts(restored).alias("r"), _same(STREAM))
    return both.where("o.n <> r.n").select(*(F.col(f"o.{k}") for k in STREAM), F.col("o.n").alias("original"), F.col("r.n").alias("restored"))


def metadata_mismatches(original: DataFrame, restored: DataFrame) -> DataFrame:
    """Ranks whose metadata differ, as lists in order. One row for each rank."""
    fields = ("rank", "seq", "name", "pid", "tid", "args")
    place = lambda m: m.select(*fields)
    both = place(original).alias("o").join(place(restored).alias("r"), _same(fields), "full_outer")
    return both.where("o.name is null or r.name is null").select(F.coalesce("o.rank", "r.rank").alias("rank")).distinct()


def first_mismatches(original: DataFrame, restored: DataFrame) -> DataFrame:
    """The first few events whose counts differ, in streams that both sides have."""
    sides = counts_side_by_side(original, restored).where("o <> r")
    for other in (missing_streams(original, restored), extra_streams(original, restored)):
        sides = sides.alias("o").join(other.alias("r"), _same(STREAM), "left_anti")
    return sides.orderBy(*STREAM, "fp").limit(MISMATCHES)


def report(original: DataFrame, restored: DataFrame, metadata: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row: counts, and whether all is equal. ``first_mismatches`` and ``stream_count_diffs`` give examples.

    Events of missing and extra streams aren't counted as mismatched; such streams make the comparison fail by themselves.
    """
    by_stream = counts_side_by_side(original, restored).groupBy(*STREAM).agg(
        F.sum("o").alias("o"), F.sum("r").alias("r"), F.sum(F.least("o", "r")).alias("same"), F.sum(F.abs(F.col("o") - F.col("r"))).alias("apart"),
    )
    both = (F.col("o") > 0) & (F.col("r") > 0)
    total = by_stream.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("original_event_count"), F.coalesce(F.sum("r"), F.lit(0)).alias("reconstructed_event_count"),
        F.coalesce(F.sum(F.when(both, F.col("same"))), F.lit(0)).alias("matching_events"), F.coalesce(F.sum(F.when(both, F.col("apart"))), F.lit(0)).alias("mismatched_events"),
        F.count_if(F.col("r") == 0).alias("missing_streams"), F.count_if(F.col("o") == 0).alias("extra_streams"), F.count_if(both & (F.col("o") != F.col("r"))).alias("stream_count_diffs"),
    )
    parts = [total]
    if metadata:
        parts.append(metadata_mismatches(*metadata).agg(F.count("*").alias("metadata_mismatches")))
    # Each part is one row; their columns are added up, what a part doesn't have counting as 0.
    names = [*total.columns, "metadata_mismatches"]
    filled = [p.select(*(F.col(c) if c in p.columns else F.lit(0).cast("bigint").alias(c) for c in names)) for p in parts]
    rows = filled[0] if len(filled) == 1 else filled[0].union(filled[1])
    whole = rows.agg(*(F.sum(c).alias(c) for c in names))
    return whole.withColumn("ok", F.expr("mismatched_events = 0 and missing_streams = 0 and extra_streams = 0 and metadata_mismatches = 0 and original_event_count = reconstructed_event_count"))
