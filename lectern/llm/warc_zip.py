"""WARC records in ZIP archives: written as stored members, read back by ranges without extraction.

An archive holds `archive/data.warc.gz`, each record a gzip member of its own, and `indexes/index.cdxj`, a line a
record with its offset and length. A reader parses the end record (or the ZIP64 end record and its locator), then the
central directory with its ZIP64 fields, finds the data of stored members from their local headers, reads the index,
and from then on reads each record by its range. Archives and their records are spread over tasks by ranges.

Records with equal payloads of at least `min_bytes` bytes are stored once: the one with the smallest page id is a
response, the others are revisits that keep the HTTP headers and name it. A task writes its archive under a name of
its own and reports it; only archives that are reported are read, so repeated attempts leave nothing in the result.

A record is held as a whole, so the longest payload bounds memory; equal smallest ids are ties that all stay responses.

Defined results: a null payload is empty; a null url is an empty target; a null id becomes the id of no record and
reads back as null, and such a row never is what others refer to; rows that repeat the smallest id of their payload
are all responses; an empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import shared_dir, small_batches

#: Names that Hadoop's connectors give to schemes that pyarrow opens under another. Fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD_ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records within so many bytes of an archive are read by one task.
RANGE_BYTES = 32 << 20
#: Payload bytes after which a batch of records is passed on.
OUT_BYTES = 4 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; payload is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ':/?#[]@!$&()*+,;=~' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), type, ids, and the payload's bytes and length."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    heads = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    http, _, payload = rest[: int(heads["content-length"])].partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    return {"heads": heads, "http": fields, "payload": payload}


def _page(ref: str | None) -> int | None:
    digits = (ref or "").strip("<>").removeprefix(RECORD_ID)
    return int(digits) if digits else None


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a URI names, and the path in it."""
    scheme, colon, rest = uri.partition("://")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    except (pa.ArrowException, OSError) as e:
        raise ValueError(f"archives need a folder that pyarrow can open, which {uri} is not: {e}") from e


def _writer(folder: str, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        out = path = None
        index, at = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.zip"
                        path = f"{folder}/{name}"
                        out = store.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                        member = archive.open(DATA, "w", force_zip64=True)
                    refers = None if r["response"] else r["refers_to"]
                    digest = base64.b32encode(bytes(r["sha1"])).decode()
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"] if r["response"] else None, r["n_bytes"], digest, refers, date), level, mtime=0)
                    member.write(data)
                    index.append(f"{'-' if r['page_id'] is None else r['page_id']} {date} " + json.dumps({"offset": at, "length": len(data), "digest": f"sha1:{digest}"}))
                    at += len(data)
        if out is not None:
            member.close()
            archive.writestr(INDEX, "".join(f"{line}\n" for line in index))
            archive.close()
            out.close()
            yield pa.record_batch({"path": [path], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives below folder (a URI that driver and executors share): a row (path, records, bytes) for each."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload")), "sha2": F.unhex(F.sha2("payload", 256))})
    firsts = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha2").agg(F.min("page_id").alias("refers_to"))
    rows = rows.join(firsts, "sha2", "left").withColumn("response", F.col("refers_to").isNull() | F.col("page_id").eqNullSafe(F.col("refers_to")))
    rows = rows.select("page_id", "url", F.when(F.col("response"), F.col("payload")).alias("payload"), "n_bytes", "sha1", "response", "refers_to")
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    # the driver gets a row an archive, as many as there are tasks that write; so each archive is written once
    schema = "path string, records long, bytes long"
    return pages.sparkSession.createDataFrame(rows.mapInArrow(_writer(folder, level, date), schema).collect(), schema)


def central_directory(f) -> dict[str, tuple[int, int, int, int]]:
    """name: (method, compressed size, size, offset of the local header) of the members of a ZIP file that can seek."""
    size = f.seek(0, io.SEEK_END)
    tail_at = max(0, size - 22 - 0xFFFF)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if tail_at + end >= 20:
        f.seek(tail_at + end - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            f.seek(struct.unpack_from("<Q", locator, 8)[0])
            record64 = f.read(56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record64, 32)
    f.seek(start)
    directory, at, members = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: those of the fields that are all ones, in this order
                p = k + 4
                if full == 0xFFFFFFFF:
                    (full,) = struct.unpack_from("<Q", extra, p)
                    p += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", extra, p)
                    p += 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", extra, p)
            k += 4 + n
        members[name] = (method, packed, full, header)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_at(f, members: dict, name: str) -> tuple[int, int]:
    """Offset and length of the data of a stored member."""
    method, packed, full, header = members[name]
    if method != 0 or packed != full:
        raise ValueError(f"{name} is not stored")
    f.seek(header)
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return header + 30 + n_name + n_extra, full


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = opened(path)
            with store.open_input_file(name) as f:
                members = central_directory(f)
                data, _ = stored_at(f, members, DATA)
                at, n = stored_at(f, members, INDEX)
                f.seek(at)
                lines = f.read(n).decode().splitlines()
            for lo in range(0, len(lines), 10_000):
                found = [json.loads(line.split(" ", 2)[2]) for line in lines[lo : lo + 10_000]]
                yield pa.record_batch({"path": pa.array([path] * len(found)), "at": pa.array([data + x["offset"] for x in found], pa.int64()), "length": pa.array([x["length"] for x in found], pa.int64())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, f = None, None
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    try:
        for batch in batches:
            out, size = [], 0
            for r in batch.to_pylist():
                if r["path"] != path:
                    if f:
                        f.close()
                    store, name = opened(r["path"])
                    path, f = r["path"], store.open_input_file(name)
                f.seek(r["at"])
                out.append(_fields(parse_record(zlib.decompress(f.read(r["length"]), 31))))
                size += len(out[-1][-1] or b"")
                if len(out) == 256 or size >= OUT_BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    finally:
        if f:
            f.close()


def _fields(x: dict) -> tuple:
    """A parsed record's row; a response's payload must have the digest that its headers name."""
    heads, response = x["heads"], x["heads"]["warc-type"] == "response"
    digest = heads["warc-payload-digest"].removeprefix("sha1:")
    if response and base32_sha1(x["payload"]) != digest:
        raise ValueError(f"the payload of {heads['warc-record-id']} has another digest than its record says")
    size = len(x["payload"]) if response else int(x["http"]["content-length"])
    return _page(heads["warc-record-id"]), heads["warc-target-uri"], heads["warc-type"], _page(heads.get("warc-refers-to")), digest, size, x["payload"] if response else None


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives whose URIs are in the column path: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = archives.select("path").repartition(n).mapInArrow(_locate, "path string, at long, length long")
    places = places.repartition(n, "path", F.floor(F.col("at") / RANGE_BYTES)).sortWithinPartitions("path", "at")
    return places.mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def new_folder(spark: SparkSession) -> str:
    """The URI of a new folder in the shared one."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
