"""Analyses over raw events, and in situ over the template tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import CPU, GPU, is_gpu, normalize_name

#: Fewer rows than this are never asked for.
LEAST_TOP = 20


def operator_hotspot(events: DataFrame, top_k: int = 0) -> DataFrame:
    """CPU operators by total duration, greatest first, ties by name."""
    rows = events.where(~is_gpu()).groupBy(normalize_name("name").alias("operator")).agg(F.sum(F.coalesce("dur", F.lit(0))).alias("total_dur"))
    return rows.orderBy(F.desc("total_dur"), "operator").limit(max(top_k, LEAST_TOP))


def operator_hotspot_insitu(template: DataFrame, top_k: int = 0) -> DataFrame:
    """The same from the templates' totals: reads two columns of one partition, no instance."""
    rows = template.where(F.col("kind") == CPU).groupBy(F.col("name_pattern").alias("operator")).agg(F.sum("dur_total").alias("total_dur"))
    return rows.orderBy(F.desc("total_dur"), "operator").limit(max(top_k, LEAST_TOP))


def _balance(rows: DataFrame, dur: F.Column) -> DataFrame:
    total = rows.groupBy("pid", "tid").agg(F.sum(dur).alias("busy")).orderBy(F.desc("busy"), "pid", "tid")
    return total.select(F.format_string("%d:%s", "pid", "tid").alias("stream"), "busy")


def stream_load_balance(events: DataFrame) -> DataFrame:
    """Busy time of each GPU stream, greatest first; ranks with equal pid and stream merge, overlaps count twice."""
    return _balance(events.where(is_gpu()), F.coalesce("dur", F.lit(0)))


def stream_load_balance_insitu(load: DataFrame) -> DataFrame:
    """The same from the table of durations by template, pid and stream."""
    return _balance(load.where(F.col("kind") == GPU), F.col("dur_total"))


@dataclass(frozen=True)
class Task:
    """An analysis: over raw events, and over a stored trace where ``in_situ`` is given."""

    name: str
    raw: Callable[[DataFrame], DataFrame]
    in_situ: Callable[["object"], DataFrame] | None = None


TASKS: dict[str, Task] = {
    t.name: t
    for t in (
        Task("operator_hotspot", operator_hotspot, lambda stored: operator_hotspot_insitu(stored.template)),
        Task("stream_load_balance", stream_load_balance, lambda stored: stream_load_balance_insitu(stored.load)),
    )
}
