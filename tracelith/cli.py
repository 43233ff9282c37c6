"""Command line: ``python -m tracelith.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .errors import TraceError, UnknownTask, VerifyError
from .operators import encode, verify
from .operators.analysis import TASKS
from .sources import store, writer
from .sources.chrome import read_trace
from .sources.files import exists, is_file, refuse_equal_stems, trace_files


def session() -> SparkSession:
    return SparkSession.builder.appName("tracelith").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _file(path: str) -> str:
    if not is_file(path):
        raise FileNotFoundError(f"{path} isn't a file")
    return path


def compress(spark: SparkSession, path: str, out: str, level: int = 3) -> store.StoredTrace:
    """Stores one trace file."""
    return store.save(read_trace(spark, _file(path)), out, level)


def compress_dir(spark: SparkSession, path: str, out: str, level: int = 3, workers: int | None = None) -> store.StoredTrace:
    """Stores all trace files of a folder; one that can't be read, or two of one stem, fail the whole, and nothing is left."""
    found = trace_files(path)
    if not found:
        raise FileNotFoundError(f"no trace files in {path}")
    refuse_equal_stems(found)
    return store.save(read_trace(spark, path, tasks=workers), out, level)


def decompress(spark: SparkSession, path: str, out: str) -> None:
    """Writes a stored trace of one rank as JSON, times as recorded."""
    stored = store.StoredTrace(spark, path)
    writer.write_json(encode.absolute(stored.events(), stored.starts), out, stored.metadata)


def check(spark: SparkSession, path: str, stored: str | None = None) -> DataFrame:
    """Compares a trace with its stored form, or with its own encoding."""
    trace = read_trace(spark, _file(path))
    if stored:
        s = store.StoredTrace(spark, stored)
        return verify.report(trace.events, s.events(), (trace.metadata, s.metadata))
    return verify.report(trace.events, encode.encode(trace.events).decoded, (trace.metadata, trace.metadata))


def analyze(spark: SparkSession, path: str, task: str) -> DataFrame:
    if task not in TASKS:
        raise UnknownTask(f"unknown analysis: {task}")
    if TASKS[task].in_situ is None:
        raise UnknownTask(f"{task} doesn't run on stored traces")
    return TASKS[task].in_situ(store.StoredTrace(spark, path))


def list_tasks() -> list[str]:
    return [t.name for t in TASKS.values() if t.in_situ]


def _level(x: str) -> int:
    if not -7 <= int(x) <= 22:
        raise argparse.ArgumentTypeError("levels go from -7 to 22")
    return int(x)


def _workers(x: str) -> int:
    if int(x) < 1:
        raise argparse.ArgumentTypeError("at least one worker")
    return int(x)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelith")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("compress", "compress-dir", "decompress"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("-o", "--output", required=True)
        if name != "decompress":
            c.add_argument("--zstd-level", type=_level, default=3)
        if name == "compress-dir":
            c.add_argument("--workers", type=_workers, default=1)
    c = sub.add_parser("verify")
    c.add_argument("input")
    c.add_argument("--artifact")
    c = sub.add_parser("analyze")
    c.add_argument("input")
    c.add_argument("--task", required=True)
    sub.add_parser("inspect").add_argument("input")
    sub.add_parser("list")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "list":
            print("\n".join(list_tasks()))
            return 0
        spark = session()
        if a.command in ("compress", "compress-dir", "decompress") and exists(a.output):
            raise FileExistsError(f"refusing to overwrite {a.output}")
        if a.command == "compress":
            compress(spark, a.input, a.output, a.zstd_level)
        elif a.command == "compress-dir":
            compress_dir(spark, a.input, a.output, a.zstd_level, a.workers)
        elif a.command == "decompress":
            decompress(spark, a.input, a.output)
        elif a.command == "inspect":
            print(json.dumps(store.inspect(store.StoredTrace(spark, a.input)), indent=2))
        elif a.command == "analyze":
            print(json.dumps([r.asDict() for r in analyze(spark, a.input, a.task).toLocalIterator()], indent=2))
        else:
            found = check(spark, a.input, a.artifact).first().asDict()
            print(json.dumps(found, indent=2))
            if not found["ok"]:
                raise VerifyError("the reconstruction differs")
    except (TraceError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
