"""WARC archives: a writer with revisit records and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import materialise
from loreweave.shared import shared_folder

MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes that the reader fetches at once.
FETCH = 4 << 20
_STEP = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


class Opened:
    """A file by path or URI: the local file system, or any that pyarrow knows (hdfs, s3, gs)."""

    def __init__(self, uri: str) -> None:
        if (path := _local(uri)) is not None:
            self.file, self.size = open(path, "rb"), os.path.getsize(path)
        else:
            fs, path = pa.fs.FileSystem.from_uri(uri)
            self.file, self.size = fs.open_input_file(path), fs.get_file_info(path).size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


def _create(uri: str):
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "xb")
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path)


def _record_id(group: str, page_id: int | None, digest: str) -> str:
    """Of a page that others may refer to, an id that follows from the archive, the page and its payload."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{group}/{page_id}/{digest}')}>"


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first_url: str | None = None, group: str = "") -> bytes:
    """A record as one gzip member; with refers_to, a revisit that has the HTTP head only, of the record of that page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own_id = _record_id(group, page_id if refers_to is None else None, digest)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(group, refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_target(first_url)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_mb: int = 256) -> DataFrame:
    """Writes a record for every row; returns the files (path, size, records) as a written table.

    Of rows with equal payloads of ``least_bytes`` or more, that with the smallest id is the response and others
    revisit it. A null payload counts as empty. A null id is behind all others: such a row revisits a row that has an
    id, and is a response if none has. Rows that repeat the smallest id too are all responses.

    Equal payloads are found by SHA-256 on rows of id and digest alone; payloads move once, with their row's decision.
    Every attempt of a task writes files of its own, and only those of attempts that succeed are in the returned table,
    so tasks can be lost and run again. A payload of any length is one record. An empty table writes no file; other
    columns are ignored, whatever their names.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    url = F.col(f"`{url_col}`").cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long_enough = rows.filter(F.octet_length("payload") >= least_bytes)
    groups = long_enough.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null").drop("n")
    again = long_enough.select("page_id", "digest").distinct().join(groups, "digest").filter("not (page_id <=> first_id)").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first_id", "first_url")
    decided = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "payload", "first_id", "first_url")
    base = f"{folder}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, path, size, n, part = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, first, first_url in zip(*batch.columns, strict=True):
                if out is None:
                    path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{part:03d}.warc.gz"
                    out, size, n, part = _create(path), 0, 0, part + 1
                data = record(page_id.as_py(), url.as_py(), (payload.as_py() or "").encode(), first.as_py(), first_url.as_py(), base)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_mb << 20:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "records"])

    return materialise(decided.mapInArrow(run, "path string, size long, records long"), "warc-files")


class _Window:
    """A file's bytes around a moving place, fetched in blocks."""

    def __init__(self, file: Opened) -> None:
        self.file, self.at, self.data = file, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read(at, max(n, FETCH))
        return self.data[at - self.at : at - self.at + n]

    def find(self, what: bytes, lo: int, hi: int) -> int:
        """The first place of ``what`` in [lo, hi), or -1."""
        while lo < hi:
            data = self.bytes(lo, min(_STEP, hi - lo) + len(what) - 1)
            i = data.find(what)
            if i >= 0:
                return lo + i
            lo += _STEP
        return -1


def _member(window: _Window, at: int, size: int) -> tuple[bytes, int] | None:
    """The content and the end of the gzip member at a place; None if none with a WARC head begins there."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and pos < size:
            data = window.bytes(pos, min(_STEP, size - pos))
            if not data:
                return None
            out.append(unpack.decompress(data))
            pos += len(data)
            if out and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    content = b"".join(out)
    if not unpack.eof or not content.startswith(b"WARC/"):
        return None
    return content, pos - len(unpack.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(content: bytes) -> dict:
    """Of one record's content: page id, payload and its size and digest, type, and what it refers to."""
    head, _, rest = content.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = f["warc-type"]
    if kind == "response":
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError("a payload does not have the digest in its head")
    else:
        n, digest, payload = int(_fields(http).get("content-length", 0)), f["warc-payload-digest"].removeprefix("sha1:"), None
    number = lambda k: int(f[k]) if k in f else None
    return {"page_id": number("x-page-id"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload": payload}


def records_in(path: str, begin: int, end: int) -> Iterator[dict]:
    """Records that start in [begin, end): finds gzip magic, decodes heads to prove members, goes on at their ends."""
    file = Opened(path)
    try:
        window, at = _Window(file), begin
        while at < end:
            at = window.find(MAGIC, at, end)
            if at < 0:
                break
            got = _member(window, at, file.size)
            if got is None:
                at += 1
                continue
            yield parse(got[0])
            at = got[1]
    finally:
        file.close()


def read_warc(files: DataFrame, *, split_mb: int = 32, payloads: bool = False) -> DataFrame:
    """Records of archives, from a table of their paths and sizes.

    Files are cut to byte ranges without looking into them; each range is a row that goes to some task, which owns the
    records that start inside and reads past the end for the last of them. No rows give no records.

    payloads: adds the column payload (binary; null for revisits).
    """
    step = split_mb << 20
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("long")))
    parts = files.filter("size > 0").select("path", "size", starts.alias("begin"))
    parts = parts.select("path", "begin", F.least(F.col("begin") + step, F.col("size")).alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("size") / step))).first()[0] or 1
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[dict] = []
                held = 0
                for r in records_in(path, begin, end):
                    rows.append(r)
                    held += 200 + (r["payload_bytes"] if payloads else 0)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)

    return parts.repartition(int(min(n, 100_000))).mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and reads all records back."""
    spark: SparkSession = pages.sparkSession
    split_mb = options.pop("split_mb", 32)
    return read_warc(write_warc(pages, f"{shared_folder(spark)}/warc", **options), split_mb=split_mb)
