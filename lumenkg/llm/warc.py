"""Content-addressed web archive.

An archive is two tables. ``payloads`` holds the bytes of each distinct payload once, under its SHA-256;
``headers`` holds the exact header of each WARC record with that digest. Records are put together again
by a join. The digest is verified on the way in and out: two different payloads with one digest are an error.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r$", re.M)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(page_id: int | None, url: str | None, kind: str, refers_to: int | None, sha1: str, size: int, date: str) -> bytes:
    """The bytes of a record before its payload: WARC header, blank line, HTTP header, blank line. Line ends within a url are escaped."""
    http = _HTTP % size
    block = len(http) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def fields(head: bytes) -> dict[str, str]:
    """The fields of a WARC header; those of the HTTP header after the blank line are left out."""
    return {k.decode(): v.decode("utf-8", "surrogatepass") for k, v in _FIELD.findall(head[: head.index(b"\r\n\r\n") + 2])}


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    inner = name[len("<urn:page:") : -1] if name else ""
    return int(inner) if inner and inner != "none" else None


@dataclass(frozen=True)
class Archive:
    """Where the two tables lie."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


_DIGESTS = "page_id long, url string, key string, sha1 string, size long"


def _digests(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            payloads = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([base32_sha1(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())],
                names=["page_id", "url", "key", "sha1", "size"],
            )

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(run, _DIGESTS)


def write(pages: DataFrame, path: str | None = None, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", date: datetime.datetime | None = None) -> Archive:
    """Archive each row of pages.

    Of records with equal payloads (UTF-8; null: empty) of at least ``least`` bytes, the one with the
    largest page_id is the response and the others revisit it; smaller payloads are all responses, though
    stored once like the rest. A null page_id is the smallest; of rows that repeat the largest page_id one is
    the response and the others revisit it. A null url leaves its field out. Other columns are left out, long pages are records
    like others, and an empty table makes an empty archive. date: of the records, that of the call if none.
    """
    stamp = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    archive = Archive(path or f"{shared_dir(pages.sparkSession)}/archive-{uuid.uuid4().hex}")
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    # Each payload once. Rows with equal payloads are merged before they are shuffled; a digest with several payloads has several rows.
    once = pages.select(F.sha2(payload, 256).alias("key"), payload.alias("payload")).distinct()
    once.write.option("compression", "zstd").parquet(archive.payloads)
    rows = stored(_digests(pages, page_id, url, html).withColumn("row", F.monotonically_increasing_id()), "digests")
    responses = rows.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("page_id", "row")).alias("last"))
    kinds = rows.join(responses, F.col("key") == F.col("k")).select("page_id", "url", "key", "sha1", "size", F.col("last.page_id").alias("response"), (F.col("row") == F.col("last.row")).alias("first"))

    def run(batches):
        for batch in batches:
            heads = []
            for p, u, sha1, size, r, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "size", "response", "first")), strict=True):
                kind = "response" if size < least or first else "revisit"
                heads.append(header(p, u, kind, r, sha1, size, stamp))
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), batch.column("key")], names=["header", "key"])

    kinds.mapInArrow(run, "header binary, key string").write.option("compression", "zstd").parquet(archive.headers)
    clash = spark_payloads(pages.sparkSession, archive).groupBy("key").count().where("count > 1")
    if not clash.isEmpty():  # two payloads with one SHA-256
        raise ValueError("different payloads share a SHA-256 digest; no archive that is addressed by it can hold both")
    return archive


def spark_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema("key string, payload binary").parquet(archive.payloads)


def spark_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema("header binary, key string").parquet(archive.headers)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records, put together: record binary, and the key of its payload. A revisit has no payload of its own, and is not joined."""
    end = F.lit(b"\r\n\r\n")
    heads = spark_headers(spark, archive).withColumn("revisit", F.instr(F.substring("header", 1, 40).cast("string"), "WARC-Type: revisit") > 0)
    whole = heads.where("not revisit").join(spark_payloads(spark, archive), "key").select("key", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(heads.where("revisit").select("key", F.concat("header", end).alias("record")))


def parsed(record: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """The fields of a record, the length of the payload by its HTTP header, and the payload; null for a revisit. A record that is cut off or too long is an error."""
    head, _, block = record[:-4].partition(b"\r\n\r\n")
    f = fields(head + b"\r\n\r\n")
    if len(block) != int(f["Content-Length"]) or record[-4:] != b"\r\n\r\n":
        raise ValueError(f"the record {f['WARC-Record-ID']} is not as long as it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"^Content-Length: ([0-9]+)", http, re.M)[1])
    return f, size, None if f["WARC-Type"] == "revisit" else payload


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, read from the records as they are put together.

    The payload of a response is measured and hashed: its SHA-256 must be its key, its SHA-1 and its length
    those of the headers, or an error is raised. A revisit tells the digest and length of what it refers to.
    """

    def parse(batches):
        for batch in batches:
            out = []
            for key, record in zip(*(batch.column(c).to_pylist() for c in ("key", "record")), strict=True):
                f, size, payload = parsed(record)
                sha1 = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and (hashlib.sha256(payload).hexdigest() != key or base32_sha1(payload) != sha1 or len(payload) != size):
                    raise ValueError(f"the payload of {f['WARC-Record-ID']} does not match its header or its key")
                url = f.get("WARC-Target-URI")
                out.append((_page(f["WARC-Record-ID"]), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), size, sha1, f["WARC-Type"], _page(f.get("WARC-Refers-To"))))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records(spark, archive).mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
