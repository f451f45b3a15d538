"""WARC archives: a writer, and a sequential reader with one gzip member per record.

*Writing.* Of records with equal payloads the one with the smallest page id is a `response`, the others
are `revisit` records that name it. Equal payloads are found by SHA-1 and length: a grouped minimum,
pre-aggregated, is written and joined back, and AQE splits the join where one payload is very common. A task streams
its rows into archives of about `ROLL` bytes in the shared folder; the returned manifest names only the
archives of tasks that finished, so a retried task leaves no record twice.

*Reading.* A task opens an archive as a stream, feeds it to an incremental zlib decompressor in chunks,
takes the end of a gzip member for the end of a record, frames the block by Content-Length and checks
the payload digest (a response's) as it goes. No more than a chunk and a header block are held, unless
payloads are asked for.

Defined results: a null payload is empty; a null id makes a record without id, which is a response
only if no equal payload has an id; rows that share the smallest id are all responses; a null URL leaves
Target-URI out; an empty table writes no archive and reads as no rows. A record that is cut off or whose
length or digest differs raises `WarcError` with archive and offset, or with strict=False ends up as a
row with valid = false. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .store import Scratch, make_folder

CHUNK, ROLL, LEVEL = 1 << 16, 256 << 20, 1
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"


class WarcError(ValueError):
    """A record that is not what its headers say."""


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder that executors share, and the path in it.

    Hadoop's names of S3 are Arrow's `s3`; HDFS, Azure (abfss) and Google storage (gs) have the same names in both."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, rest = uri.split("://", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def qualified(spark: SparkSession, path: str) -> str:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(hadoop).makeQualified(p).toString()


def _member(kind: str, page_id: int | None, url: str | None, sha1: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        made: list[tuple[str, int, int]] = []
        out, records, size = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                page_id, url, html, sha1, refers_to = (x.as_py() for x in row)
                if out is None:
                    out = fs.open_output_stream(f"{name}-{len(made)}.warc.gz", compression=None)
                data = _member("response" if refers_to is None else "revisit", page_id, url, sha1, html, refers_to)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll:
                    out.close()
                    made.append((f"{name}-{len(made)}.warc.gz", records, size))
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            made.append((f"{name}-{len(made)}.warc.gz", records, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, scratch: Scratch, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes a record per row into archives below `folder`; returns the manifest (archive, records, bytes)."""
    spark = prepare(pages.sparkSession)
    make_folder(spark, folder)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html")).withColumns({"sha1": F.sha1("html"), "n": F.octet_length("html")})
    first = scratch.table(rows.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    lead = rows.join(first, ["sha1", "n"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return scratch.table(lead.select("page_id", "url", "html", "sha1", refers.alias("refers_to")).mapInArrow(_write(qualified(spark, folder), roll), "archive string, records long, bytes long"))


class _Record:
    """A record as its bytes arrive: header block, HTTP head, payload, and the two line ends after it."""

    def __init__(self, archive: str, offset: int, keep: bool) -> None:
        self.archive, self.offset, self.keep = archive, offset, keep
        self.head, self.http = bytearray(), bytearray()
        self.fields: dict[str, str] | None = None
        self.http_fields: dict[str, str] | None = None
        self.left, self.bytes, self.tail = 0, 0, bytearray()
        self.sha1, self.payload = hashlib.sha1(), bytearray()

    @staticmethod
    def _parse(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            self.fields = self._parse(bytes(self.head[:end]))
            data = bytes(self.head[end + 4 :])
            self.left = int(self.fields.get("content-length", "0"))
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.tail += rest
        if self.http_fields is None and "application/http" in self.fields.get("content-type", ""):
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            self.http_fields = self._parse(bytes(self.http[:end]))
            block = bytes(self.http[end + 4 :])
        self.sha1.update(block)
        self.bytes += len(block)
        if self.keep:
            self.payload += block

    def row(self) -> dict:
        fields, http = self.fields or {}, self.http_fields or {}
        kind, name = fields.get("warc-type"), lambda k: (fields.get(k) or "").strip("<>") or None
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        wrong = None
        if self.fields is None or not fields[""].startswith("WARC/"):
            wrong = "no WARC header"
        elif self.left or bytes(self.tail) != b"\r\n\r\n":
            wrong = "the block's length is not Content-Length"
        elif kind != "revisit" and stated and base64.b32encode(self.sha1.digest()).decode() != stated:
            wrong = "the payload's digest differs"
        elif kind == "response" and "content-length" in http and int(http["content-length"]) != self.bytes:
            wrong = "the payload's length differs"
        whole = int(http.get("content-length", "0")) if kind == "revisit" else self.bytes
        return {
            "archive": self.archive, "offset": self.offset, "record_type": kind, "record_id": name("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": whole,
            "payload_digest": stated or None, "refers_to": name("warc-refers-to"), "payload": bytes(self.payload) if self.keep else None, "error": wrong,
        }


def read_archive(archive: str, keep_payload: bool = False, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of one archive in order."""
    fs, path = open_folder(archive if "://" in archive or archive.startswith("file:") else f"file:{archive}")
    with fs.open_input_stream(path, compression=None) as stream:
        offset, data = 0, stream.read(chunk)
        while data:
            unpack, record, used = zlib.decompressobj(31), _Record(archive, offset, keep_payload), 0
            while data and not unpack.eof:
                try:
                    piece = unpack.decompress(data, CHUNK)
                except zlib.error as e:
                    raise WarcError(f"{archive} at {offset}: {e}") from e
                used += len(data)
                record.feed(piece)
                data = unpack.unconsumed_tail or unpack.unused_data
                used -= len(data)
                if not data:
                    data = stream.read(chunk)
            if not unpack.eof:
                record.feed(unpack.flush())
                yield record.row() | {"error": "the gzip member is cut off"}
                return
            yield record.row()
            offset += used


_RECORD = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
)


def _read(keep_payload: bool, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows: list[dict] = []
                size = 0
                for row in read_archive(archive, keep_payload):
                    if strict and row["error"]:
                        raise WarcError(f"{archive} at {row['offset']}: {row['error']}")
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return run


def read_warc(archives: DataFrame, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of the archives named in the column `archive`, each archive in one stream."""
    spark = prepare(archives.sparkSession)
    dealt = archives.select("archive").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive")
    kinds = "archive string, offset long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
    return dealt.mapInArrow(_read(keep_payload, strict), kinds).withColumn("valid", F.col("error").isNull())


def op3_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch, f"{scratch.root}/archives")
    number = lambda c: F.regexp_extract(c, f"^{_ID}(-?[0-9]+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read_warc(manifest).select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "valid")
