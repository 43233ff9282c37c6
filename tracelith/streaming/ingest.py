"""Structured Streaming over trace files that land in a folder (beyond the batch tools)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import is_gpu, normalize_name
from ..sources.chrome import read_trace
from ..sources.store import StoredTrace, save


def watch(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the paths of trace files as they land. Contents aren't read here."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json*").option("maxFilesPerTrigger", files_at_once).load(folder).select("path")


def store_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Stores the files of each batch as one trace under ``out``, named by the batch; files tell themselves apart by source, so any may share a stem or a rank.

    A store is published whole or not at all, and a batch that is repeated after a failure has the number and the files that it had: one
    that is there already is left, after its files have been compared. The driver sees a batch's paths, ``files_at_once`` at most.
    """

    def store(batch: DataFrame, number: int) -> None:
        paths, path = sorted(r.path for r in batch.collect()), f"{out}/batch-{number:09}"
        try:
            save(read_trace(spark, *paths), path)
        except FileExistsError:
            there = sorted(r.source for r in StoredTrace(spark, path).files.select("source").collect())
            if there != paths:
                raise

    return watch(spark, folder, files_at_once).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_load(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Durations of operators by time window over a stream of events with an ``at`` timestamp; later ones than ``late`` are dropped."""
    return (
        events.withWatermark("at", late).groupBy(F.window("at", window), normalize_name("name").alias("operator"), is_gpu().alias("gpu"))
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("dur", F.lit(0))).alias("total_dur"))
    )
