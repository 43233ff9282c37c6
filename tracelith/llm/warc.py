"""WARC archives: written whole-file compressed, normalised to a gzip member for each record with a sidecar offset index, read back.

``write`` streams rows into archives of about ``ARCHIVE`` bytes of payload, each one gzip stream. ``normalise`` inflates such a
file once, in pieces, rewrites every record as its own member and writes an index of offsets beside it. ``read`` fetches
records by the index. Files go to the shared folder of the cluster (through pyarrow's file systems: local or mounted paths,
HDFS, object stores); each attempt of a task writes files of its own, and only those that the attempt reported are
used, so lost executors and repeated tasks do no harm. No task holds more than one record and one piece of a stream.

Payloads are UTF-8; a null html is an empty payload. Of payloads of ``LEAST`` bytes or more that are equal (by SHA-1 and length), the
record with the largest page_id holds it; the others are revisits that name it. Rows that repeat the largest page_id are
responses each (revisits name the one with the greatest url); null page_ids never count as the largest, and without any other id such rows are
all responses. A revisit names its holder by ``WARC-Record-ID``, and by page. Control characters in urls are percent-encoded in headers;
urls of any length are written whole; null urls have no header. Tables without rows give no archives and no rows. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import join_dealt, remove_dir, shared_dir, written

LEAST, ARCHIVE, PIECE, LEVEL = 1000, 32 << 20, 1 << 18, 1
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, n_records long"
INDEXED = "path string, index_path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit (``refers_to`` isn't null) carries HTTP headers only and the id of the record that holds the payload."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe}"] if url else []), *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {size}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


def inflate(source, piece: int = PIECE) -> Iterator[bytes]:
    """Inflates a gzip file, of one member or many, in pieces of bounded size."""
    d = zlib.decompressobj(31)
    while raw := source.read(piece):
        while raw:
            yield d.decompress(raw, piece)
            raw = d.unconsumed_tail
            if d.eof:
                raw, d = d.unused_data, zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of WARC records."""
    held = bytearray()
    need = lambda: next(pieces, None)
    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if (more := need()) is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
            held += more
        head = parse_head(bytes(held[:cut]))
        end = cut + 4 + int(head["content-length"]) + 4
        while len(held) < end:
            if (more := need()) is None:
                raise ValueError("the archive ends inside a record")
            held += more
        yield head, bytes(held[:end])
        del held[:end]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, refers_to and refers_url (null for responses).

    Only digests that repeat are joined; the rows of one that many pages share are dealt to many tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    repeated = (
        rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("h"), F.count("*").alias("n")).where("n > 1 and h is not null")
        .select("payload_digest", "payload_bytes", "n", F.col("h.page_id").alias("holder"), F.col("h.url").alias("holder_url"))
    )
    repeated = written(repeated, "repeated")  # read for the heavy keys and for the join
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("holder"))
    joined = join_dealt(rows, repeated, ["payload_digest", "payload_bytes"], rows.count(), "left", by=["page_id", "url"])
    return joined.withColumns({"refers_to": F.when(other, F.col("holder")), "refers_url": F.when(other, F.col("holder_url"))}).drop("holder", "holder_url")


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes archives under ``folder`` and returns their paths (written down, so that later reads don't write again)."""
    rows = decided(pages, least).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to", "refers_url")
    arrow = to_arrow_schema(_parse_datatype_string(FILES))

    def run(batches):
        fs, base = file_system(folder)
        out = z = path = None
        n = size = 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, length, refers_to, refers_url = (c[i].as_py() for c in b.columns)
                if out is None:
                    path, z, n, size = f"part-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                out.write(z.compress(record(page_id, url, payload, digest, length, refers_to, refers_url)))
                n, size = n + 1, size + length
                if size >= ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(rows.mapInArrow(run, FILES), "archives")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each archive of ``source`` with a member for each record, and its index, under ``target``."""
    arrow = to_arrow_schema(_parse_datatype_string(INDEXED))

    def run(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                fs, base = file_system(source)
                to, new = file_system(target)
                to.create_dir(new, recursive=True)
                stem = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                at = n = 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, to.open_output_stream(f"{new}/{stem}.warc.gz", compression=None) as out, to.open_output_stream(f"{new}/{stem}.idx", compression=None) as index:
                    for head, whole in records(inflate(raw)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        index.write(json.dumps([at, len(member), head["warc-type"], head["warc-record-id"]]).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{stem}.warc.gz"], "index_path": [f"{stem}.idx"], "n_records": [n]}, schema=arrow)

    # One file is one stream and one task's work; files are dealt out evenly.
    return written(spread(files).mapInArrow(run, INDEXED), "members")


def spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, min(10_000, files.count())), F.xxhash64("path"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, fetched by their index; digests of response payloads are computed anew and must agree."""
    arrow = to_arrow_schema(_parse_datatype_string(RECORDS))

    def one(raw: bytes):
        head = parse_head(raw[: raw.index(b"\r\n\r\n")])
        digest, size, kind = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), int(head["x-payload-length"]), head["warc-type"]
        if kind == "response":
            body = raw[raw.index(b"\r\n\r\n") + 4 : -4]
            payload = body[body.index(b"\r\n\r\n") + 4 :]
            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("a record's payload doesn't match its digest")
        page_id, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        return None if page_id is None else int(page_id), size, digest, kind, int(refers) if refers else None

    def run(batches):
        for b in batches:
            for name, index in zip(b.column("path").to_pylist(), b.column("index_path").to_pylist(), strict=True):
                fs, base = file_system(folder)
                with fs.open_input_stream(f"{base}/{index}", compression=None) as lines:
                    entries = [json.loads(x) for x in lines.read().splitlines()]
                with fs.open_input_file(f"{base}/{name}") as f:
                    for a in range(0, len(entries), 512):
                        rows = [one(zlib.decompress(f.read_at(n, at), 31)) for at, n, *_ in entries[a : a + 512]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), arrow)], schema=arrow)

    return spread(files).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, normalises the archives and reads every record back."""
    folder = shared_dir(pages.sparkSession, "warc")
    raw = write(pages, f"{folder}/raw")
    members = normalise(raw, f"{folder}/raw", f"{folder}/members")
    if raw.count():
        remove_dir(pages.sparkSession, f"{folder}/raw")
    return read(members, f"{folder}/members")
