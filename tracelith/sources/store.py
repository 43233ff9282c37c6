"""Stored traces: a folder of Parquet tables and a manifest, published in one step.

``template`` and ``instance`` are partitioned by kind, ``load`` holds durations by template, pid and lane, ``metadata`` and ``files`` what their
names say. The folder is written beside its place and renamed when complete; on failure nothing is left.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidStore
from ..operators import encode
from .chrome import Trace
from .files import hadoop, publish, remove, stem_column

VERSION = 1
TABLES = ("template", "instance", "load", "metadata", "files")
MANIFEST = "manifest.json"


class StoredTrace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = read_manifest(spark, path)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def events(self) -> DataFrame:
        """The events again, times relative."""
        return encode.decode(self.instance, self.template)

    @property
    def starts(self) -> DataFrame:
        """One row for each file: files that share a rank keep times of their own."""
        return self.files.select("source", "rank", "start_ts")


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, p = hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        raise InvalidStore(f"{path} holds no stored trace")
    found = json.loads("\n".join(r.value for r in spark.read.text(str(p.toString()), wholetext=True).collect()))
    if not 1 <= found.get("format_version", 0) <= VERSION:
        raise InvalidStore(f"unsupported version {found.get('format_version')}")
    return found


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def entries(trace: Trace, events: DataFrame) -> DataFrame:
    """Per file: source, artifact, rank, events, input bytes."""
    n = events.groupBy("source").agg(F.count("*").alias("events"))
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    return trace.files.join(n, "source", "left").select(name.alias("source"), stem_column(F.col("source")).alias("artifact"), "rank", F.coalesce("events", F.lit(0)).alias("events"), "input_bytes").orderBy("source")


def write_tables(events: DataFrame, folder: str, options: dict[str, str] | None = None) -> None:
    """``template``, ``instance`` and ``load`` of ``events`` under ``folder``. The totals behind all three are made once."""
    found = encode.encode(events, f"{folder}/_encoded")
    found.template.write.options(**(options or {})).partitionBy("kind").parquet(f"{folder}/template")
    found.instance.write.options(**(options or {})).partitionBy("kind").parquet(f"{folder}/instance")
    found.load.write.options(**(options or {})).parquet(f"{folder}/load")
    remove(events.sparkSession, f"{folder}/_encoded")


def save(trace: Trace, path: str, codec_level: int = 3, check: Callable[[StoredTrace], None] | None = None) -> StoredTrace:
    """Encodes and stores a trace at a new path. Files are parsed once; all tables come from the rows written down then."""
    spark = trace.files.sparkSession
    fs, p = hadoop(spark, path)
    if fs.exists(p):
        raise FileExistsError(f"refusing to overwrite {path}")
    staging = f"{path.rstrip('/')}.staging"
    try:
        options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(codec_level)}
        remove(spark, staging)  # what a killed run may have left
        trace = trace.parsed(f"{staging}/_rows")
        events = trace.events
        write_tables(events, staging, options)
        trace.metadata.write.options(**options).parquet(f"{staging}/metadata")
        trace.files.write.options(**options).parquet(f"{staging}/files")
        listed = [r.asDict() for r in entries(trace, events).toLocalIterator()]  # a row for each input file
        remove(spark, f"{staging}/_rows")
        write_text(spark, f"{staging}/{MANIFEST}", json.dumps({"format_version": VERSION, "entries": listed}, indent=2) + "\n")
        if check:
            check(StoredTrace(spark, staging))
        publish(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise
    return StoredTrace(spark, path)


def inspect(stored: StoredTrace) -> dict:
    fs, p = hadoop(stored.spark, stored.path)
    totals = stored.template.agg(F.count("*").alias("templates"), F.coalesce(F.sum("n"), F.lit(0)).alias("instances")).first()
    return {
        "path": stored.path, "format_version": stored.manifest["format_version"], "artifact_bytes": fs.getContentSummary(p).getLength(),
        "ranks": sorted({e["rank"] for e in stored.manifest["entries"]}), "templates": totals.templates, "event_instances": totals.instances,
    }

