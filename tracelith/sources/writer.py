"""Writes events as Chrome trace JSON: one file for each rank, metadata first."""

from __future__ import annotations

import gzip
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidTrace
from .files import file_system, is_file, publish, shared_dir

_SCHEMA = "rank string, path string, n_rows long"


def event_json() -> F.Column:
    """A row of the event schema (times absolute) as a JSON object; absent fields are left out, canonical arguments are kept as they are."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    member = lambda name, c, is_text: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{name}":'), text(c) if is_text else F.col(c).cast("string")))
    key = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    args = F.concat(F.lit('"args":{'), F.array_join(F.transform(F.array_sort(F.map_keys("args")), lambda k: F.concat(key(k), F.lit(":"), F.coalesce(F.element_at("args", k), F.lit("null")))), ","), F.lit("}"))
    parts = [member(n, n, n in ("name", "ph", "tid", "cat", "bp", "s")) for n in ("name", "ph", "pid", "tid", "ts", "dur", "cat", "id", "bp", "s")] + [F.when(F.col("args").isNotNull(), args)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def metadata_json() -> F.Column:
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.concat(F.lit('{"name":'), text("name"), F.lit(',"ph":"M","pid":'), F.col("pid").cast("string"), F.lit(',"tid":'), text("tid"), F.coalesce(F.concat(F.lit(',"args":'), "args"), F.lit("")), F.lit("}"))


def _lines(events: DataFrame, metadata: DataFrame | None) -> DataFrame:
    source = lambda df: (F.col("source") if "source" in df.columns else F.lit("")).alias("source")
    lines = events.select("rank", F.lit(1).alias("part"), source(events), "seq", event_json().alias("line"))
    return lines if metadata is None else lines.union(metadata.select("rank", F.lit(0), source(metadata), "seq", metadata_json()))


def write_ranks(events: DataFrame, folder: str, metadata: DataFrame | None = None, compress: bool = False) -> DataFrame:
    """One file for each rank in ``folder``; returns (rank, path, n_rows). A rank's file is one stream, so one task writes it, row by row.

    Each attempt of a task writes under a name of its own; the names returned are those of finished attempts.
    """
    ordered = _lines(events, metadata).repartition("rank").sortWithinPartitions("rank", "part", "source", "seq")
    arrow = pa.schema([("rank", pa.string()), ("path", pa.string()), ("n_rows", pa.int64())])

    def run(batches):
        fs, base = file_system(folder)
        now = raw = out = path = None
        n = 0

        def close():
            out.write(b"]}")
            if out is not raw:
                out.close()
            raw.close()
            return pa.RecordBatch.from_pydict({"rank": [now], "path": [f"{folder}/{path}"], "n_rows": [n]}, schema=arrow)

        for b in batches:
            for rank, line in zip(b.column("rank").to_pylist(), b.column("line").to_pylist(), strict=True):
                if out is None or rank != now:
                    if out is not None:
                        yield close()
                    now, n, path = rank, 0, f"rank-{uuid.uuid4().hex}.json" + ".gz" * compress
                    fs.create_dir(base, recursive=True)
                    raw = fs.open_output_stream(f"{base}/{path}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1) if compress else raw
                    number = rank.lstrip("-").isdigit() and str(int(rank)) == rank
                    out.write(b'{"distributedInfo":{"rank":%s},"traceEvents":[' % (rank if number else json.dumps(rank)).encode())
                out.write((b",\n" if n else b"\n") + line.encode())
                n += 1
        if out is not None:
            yield close()

    return ordered.mapInArrow(run, _SCHEMA)


def write_json(events: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """Writes the one rank of ``events`` (times as recorded) to ``path``, which must be new. Files that share the rank follow one another."""
    spark = events.sparkSession
    if is_file(path):
        raise FileExistsError(f"refusing to overwrite {path}")
    ranks = [r.rank for r in events.select("rank").union(metadata.select("rank") if metadata is not None else events.select("rank").limit(0)).distinct().limit(2).collect()]
    if len(ranks) != 1:
        raise InvalidTrace("a JSON trace holds exactly one rank")
    folder = shared_dir(spark, "json")
    done = write_ranks(events, folder, metadata, path.endswith(".gz")).collect()
    publish(spark, done[0].path, path)
