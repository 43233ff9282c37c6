"""The ``chrome_trace`` data source: trace files in Chrome's JSON format, plain or gzip, read incrementally.

One partition for each file. An element of ``traceEvents`` is decoded at a time, so memory doesn't follow the file's size. Rows
are of three kinds (column ``row``): ``event``, ``metadata`` (phase M; only name, pid, tid and args survive) and one ``file`` row at each file's
end with its rank and least time. The option ``row`` asks for one kind; the others aren't made then.

Tolerance is the same for files of every size: fields of a wrong type are absent or default, elements that aren't
objects are skipped; a file without ``traceEvents``, truncated or with anything after its root is an error.
"""

from __future__ import annotations

import codecs
import gzip
import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ParseError
from ..functions.canonical import canonical, whole_text
from .files import file_system, stem, trace_files

ROW = "row string, source string, rank string, seq bigint, pid bigint, tid string, ph string, name string, ts bigint, dur bigint, cat string, id bigint, bp string, s string, args map<string,string>, metadata_args string, input_bytes bigint"
_ARROW = pa.schema([(n, pa.map_(pa.string(), pa.string()) if t.startswith("map") else pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split(" ", 1) for x in ROW.split(", "))])
#: The columns that a row is made of; the source is the same for all rows of a file.
FIELDS = [n for n in _ARROW.names if n != "source"]
BATCH, PIECE = 8192, 1 << 20
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole(x: Any) -> int | None:
    """A JSON number as a long, floats cut towards zero; null for all else."""
    kind = type(x)
    if kind is float and math.isfinite(x):
        x = int(x)
    elif kind is not int:
        return None
    return x if _LOW <= x <= _HIGH else None


def process_id(x: Any) -> int:
    if isinstance(x, str):
        return int(x) if re.fullmatch(r"[+-]?[0-9]+", x) and _LOW <= int(x) <= _HIGH else 0
    return whole(x) or 0


def thread_id(x: Any) -> str:
    if isinstance(x, str):
        return x
    return str(x) if type(x) is int else "0"


def text(x: Any) -> str | None:
    return x if isinstance(x, str) else None


def event_fields(e: dict, seq: int) -> tuple:
    """One element of ``traceEvents`` as a row, in the order of FIELDS."""
    get = e.get
    ph, args, tid, pid, name = (text(get("ph")) or "X")[:1], get("args"), thread_id(get("tid")), process_id(get("pid")), text(get("name")) or ""
    if ph == "M":
        return "metadata", None, seq, pid, tid, ph, name, None, None, None, None, None, None, None, None if args is None else canonical(args), None
    cat, found = text(get("cat")), None
    stream = None
    if isinstance(args, dict):
        stream = args.get("stream")
        found = [(k, canonical(args[k])) for k in sorted(args)] or None
    if type(stream) is int or isinstance(stream, str):
        tid = f"stream {stream}"
    elif cat == "gpu_user_annotation":
        tid = f"stream {tid}"
    return "event", None, seq, pid, tid, ph, name, whole(get("ts")) or 0, whole(get("dur")), cat, whole(get("id")), text(get("bp")), text(get("s")), found, None, None


def _refuse(x: str):
    raise ParseError(f"{x} is no JSON value")


class Stream:
    """Decodes one JSON value at a time from a byte stream."""

    any_length = json.JSONDecoder(parse_constant=_refuse, parse_int=whole_text)

    space, comma = re.compile(r"[ \t\n\r]*"), re.compile(r"[ \t\n\r]*,[ \t\n\r]*")

    def __init__(self, source):
        self.source, self.utf8, self.json = source, codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder(parse_constant=_refuse)
        self.held, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.source.read(max(PIECE, len(self.held)))  # larger pieces for larger values, so that work stays linear
        self.ended = not raw
        self.held, self.at = self.held[self.at :] + self.utf8.decode(raw, self.ended), 0
        return True

    def peek(self) -> str:
        while True:
            self.at = self.space.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ParseError(f"{wanted} expected, {self.peek() or 'the end'} found")
        self.at += 1

    def value(self) -> Any:
        self.peek()
        while True:
            try:
                out, end = self.json.raw_decode(self.held, self.at)
                # A number at the end of what is held may go on.
                if end < len(self.held) or not self.more():
                    self.at = end
                    return out
            except (ValueError, RecursionError) as e:
                if type(e) is ValueError and self.json is not self.any_length:
                    self.json = self.any_length  # a number of more digits than int() takes
                elif not isinstance(e, json.JSONDecodeError) or not self.more():
                    raise ParseError(str(e)) from e

    def followed(self) -> Iterator[Any]:
        """The values that stand whole in what is held, each with the comma after it: many at little cost. May give none."""
        decode, comma = self.json.scan_once, self.comma.match
        self.peek()
        while True:
            try:
                out, end = decode(self.held, self.at)
            except (StopIteration, ValueError, RecursionError):
                return  # cut off, or broken: value() tells
            if not (m := comma(self.held, end)):
                return
            self.at = m.end()
            yield out


def elements(source, info: dict) -> Iterator[Any]:
    """The elements of ``traceEvents``; ``info`` gets ``rank`` if the file tells it."""
    s, found = Stream(source), False
    s.take("{")
    while s.peek() != "}":
        key = s.value()
        s.take(":")
        if key == "traceEvents":
            found = True
            s.take("[")
            after_comma = False
            while s.peek() != "]" or after_comma:
                for x in s.followed():
                    after_comma = True
                    yield x
                if after_comma and s.peek() == "]":
                    raise ParseError("a value expected after a comma")
                yield s.value()
                after_comma = s.peek() == ","
                if after_comma:
                    s.take(",")
                elif s.peek() != "]":
                    raise ParseError("a comma expected")
            s.take("]")
        else:
            v = s.value()
            if key == "distributedInfo":
                rank = v.get("rank") if isinstance(v, dict) else None
                if isinstance(rank, (int, str)) and not isinstance(rank, bool):
                    info["rank"] = str(rank)
        if s.peek() == ",":
            s.take(",")
            if s.peek() == "}":
                raise ParseError("a key expected after a comma")
        elif s.peek() != "}":
            raise ParseError("a comma expected")
    s.take("}")
    if s.peek():
        raise ParseError("text after the root object")
    if not found:
        raise ParseError("no traceEvents")


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ChromeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.only = [options["path"]] if "path" in options else json.loads(options["paths"]), options.get("row")

    def partitions(self):
        return [File(f) for p in self.paths for f in trace_files(p)]

    def read(self, partition):
        path = partition.path
        fs, p = file_system(path)
        info, low, seq, rows, only = {}, None, 0, [], self.only
        with fs.open_input_stream(p, compression=None) as raw:
            source = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            try:
                for e in elements(source, info):
                    if not isinstance(e, dict):
                        continue
                    row = event_fields(e, seq)
                    seq += 1
                    if row[0] == "event" and (low is None or row[7] < low):
                        low = row[7]
                    if only is None or only == row[0]:
                        rows.append(row)
                    if len(rows) >= BATCH:
                        yield self.batch(rows, path)
                        rows = []
            except (ParseError, UnicodeDecodeError, EOFError, OSError) as e:
                raise ParseError(f"{path}: {e}") from e
        if only in (None, "file"):
            last = {"row": "file", "rank": info.get("rank") or stem(path) or "0", "ts": low or 0, "seq": seq, "input_bytes": fs.get_file_info(p).size}
            rows.append(tuple(map(last.get, FIELDS)))
        if rows:
            yield self.batch(rows, path)

    @staticmethod
    def batch(rows: list[tuple], path: str) -> pa.RecordBatch:
        columns = dict(zip(FIELDS, zip(*rows, strict=True), strict=True)) | {"source": [path] * len(rows)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


class ChromeTrace(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chrome_trace"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> ChromeReader:
        return ChromeReader(dict(self.options))


class Trace:
    """What has been read: ``files`` (source, rank, start_ts, input_bytes, n_rows), ``events`` (times relative), ``metadata``.

    ``rows`` gives the rows of one kind, or all.
    """

    def __init__(self, rows: Callable[[str | None], DataFrame]):
        self.rows = rows
        self.files = rows("file").select("source", "rank", F.col("ts").alias("start_ts"), "input_bytes", F.col("seq").alias("n_rows"))
        known = self.files.select("source", F.col("rank").alias("r"), "start_ts")
        self.events = rows("event").join(known, "source").select(
            "source", F.col("r").alias("rank"), "pid", "tid", "ph", "seq", "name", (F.col("ts") - F.col("start_ts")).alias("ts"), "dur", "cat", "id", "bp", "s", "args",
        )
        self.metadata = rows("metadata").join(known, "source").select("source", F.col("r").alias("rank"), "seq", "name", "pid", "tid", F.col("metadata_args").alias("args"))

    @property
    def starts(self) -> DataFrame:
        """One row for each file: files that share a rank keep times of their own."""
        return self.files.select("source", "rank", "start_ts")

    def parsed(self, folder: str) -> Trace:
        """The same from rows written down, so that files are parsed once."""
        rows = self.rows(None)
        rows.write.partitionBy("row").parquet(folder)
        # Row kinds are folders there: each frame reads its own.
        stored = rows.sparkSession.read.schema(rows.schema).parquet(folder)
        return Trace(lambda kind: stored if kind is None else stored.where(F.col("row") == kind))


def read_trace(spark: SparkSession, *paths: str, tasks: int | None = None) -> Trace:
    """Reads files or folders. Every row of every file stays, also where files share a rank; ``source`` tells them apart. ``tasks`` bounds how many files are read at once."""
    spark.dataSource.register(ChromeTrace)

    def rows(kind: str | None) -> DataFrame:
        reader = spark.read.format("chrome_trace").option("paths", json.dumps(list(paths)))
        found = (reader.option("row", kind) if kind else reader).load()
        return found.coalesce(tasks) if tasks else found

    return Trace(rows)


def header_check(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """Whether files begin with a binary artifact's header: (path, ok, version, problem).

    Eight magic bytes (the caller's), a little-endian version of 1 or 2, codec byte 1, five zero bytes.
    """
    head = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 16).alias("h"))
    byte = lambda i: F.conv(F.hex(F.substring("h", i, 1)), 16, 10).cast("int")
    version = byte(9) + 256 * byte(10)
    problem = (
        F.when(F.octet_length("h") < 16, "truncated").when(F.substring("h", 1, 8) != F.lit(magic), "magic").when(~version.between(1, 2), "version")
        .when(byte(11) != 1, "codec").when(F.substring("h", 12, 5) != F.lit(bytes(5)), "reserved")
    )
    return head.select("path", problem.isNull().alias("ok"), version.alias("version"), problem.alias("problem"))

