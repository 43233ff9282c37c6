"""Files by any path or URI: listing, opening, shared folders, atomic publishing."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidTrace

SUFFIXES = (".json", ".json.gz")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (pafs.LocalFileSystem(), path)


def is_file(path: str) -> bool:
    fs, p = file_system(path)
    return fs.get_file_info(p).type == pafs.FileType.File


def exists(path: str) -> bool:
    fs, p = file_system(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def trace_files(path: str) -> list[str]:
    """The trace files of a folder, not of folders below it, sorted; a file stands for itself; none if the folder can't be read."""
    fs, p = file_system(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [path]
    try:
        found = fs.get_file_info(pafs.FileSelector(p))
    except OSError:
        return []
    return [f"{path.rstrip('/')}/{x}" for x in sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(SUFFIXES))]


#: What a trace file's name ends with, beyond its stem.
_ENDING = r"\.json(\.gz)?$"


def stem(path: str) -> str:
    return re.sub(_ENDING, "", path.rstrip("/").rpartition("/")[2])


def stem_column(path: Column) -> Column:
    """``stem`` of a column of paths."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), _ENDING, "")


def refuse_equal_stems(paths: list[str]) -> None:
    """Files whose names differ in their ending only would be one artifact."""
    seen: dict[str, str] = {}
    for p in paths:
        if (other := seen.setdefault(stem(p), p)) != p:
            raise InvalidTrace(f"{other} and {p} would both be stored as {stem(p)}")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``). Only a local session, as in tests, may do without one: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidTrace("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tracelith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to a new folder and reads it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, staging: str, path: str) -> None:
    """Renames a finished folder to its place; refuses to replace anything."""
    fs, to = hadoop(spark, path)
    if fs.exists(to):
        remove(spark, staging)
        raise FileExistsError(f"refusing to overwrite {path}")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), to):
        raise OSError(f"can't rename {staging} to {path}")
