"""Content-addressed web archive: payloads once by digest, exact record headers separately.

``write`` makes two Parquet tables under one folder:

* ``payloads``: one row per distinct payload - SHA-256 (the key), SHA-1 (as WARC headers quote
  it), length, the gzip-compressed bytes, and the page whose record is the ``response``;
* ``headers``: one row per page - the exact bytes of its WARC record up to the payload (WARC
  header, blank line, HTTP header, blank line) and the key of its payload.

``read`` joins the two by digest, puts every record together byte for byte, parses it and checks
lengths and digests; ``export`` writes the records as ``.warc.gz`` files.

The payload travels compressed, is folded per task before the one shuffle that groups it by
digest, and never meets its copies uncompressed: a payload that a third of all pages share costs
one row per task. The header join is on narrow rows, where adaptive execution splits a hot
digest. Both tables are written under the folder given, which must be shared.

Of equal payloads of at least ``min_bytes`` bytes the record of the largest page_id is the
response and the others are revisits of it. Defined results: a null html is the empty payload; a
null url leaves out the target header; a null page_id is smaller than any other; equal rows that
all carry the largest page_id are all responses; if all page_ids of a payload are null, all are
responses. A very long page is one record like any other; an empty table gives an archive without
records. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.llm.common import map_batches

DATE = "1970-01-01T00:00:00Z"       # the pages carry no fetch time
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(x or "").encode() for x in batch.column("html").to_pylist()]
            cols = {"page_id": batch.column("page_id"),
                    "sha256": pa.array([hashlib.sha256(p).digest() for p in payloads],
                                       pa.binary())}
            if with_payload:
                cols["sha1"] = pa.array(map(base32_sha1, payloads), pa.string())
                cols["n_bytes"] = pa.array(map(len, payloads), pa.int64())
                cols["gz"] = pa.array([gzip.compress(p, 6, mtime=0) for p in payloads],
                                      pa.binary())
            else:
                cols["url"] = batch.column("url")
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def record_head(page_id: int | None, url: str | None, sha1: str, n_bytes: int, response: bool,
                refers_to: int | None = None, date: str = DATE) -> bytes:
    """The bytes of a record before its payload: WARC header and HTTP header."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {n_bytes}\r\n\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}",
             f"WARC-Record-ID: <{_ID}{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if not response:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    length = len(http) + (n_bytes if response else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in
                     ("page_id", "url", "sha1", "n_bytes", "response", "refers_to")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("sha256"),
             pa.array([record_head(*r) for r in rows], pa.binary())],
            names=["page_id", "sha256", "head"])


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Write the archive of ``pages`` (page_id, url, html) under ``path``; returns ``path``."""
    spark = pages.sparkSession
    (map_batches(pages.select("page_id", "html"), _digests(True),
                 "page_id long, sha256 binary, sha1 string, n_bytes long, gz binary")
     .groupBy("sha256")
     .agg(F.max("page_id").alias("response_id"), F.first("sha1").alias("sha1"),
          F.first("n_bytes").alias("n_bytes"), F.first("gz").alias("gz"))
     .write.parquet(f"{path}/payloads"))
    store = (spark.read.parquet(f"{path}/payloads")
             .select("sha256", "response_id", "sha1", "n_bytes"))
    shared = F.col("n_bytes") >= min_bytes
    heads = (map_batches(pages.select("page_id", "url", "html"), _digests(False),
                         "page_id long, sha256 binary, url string")
             .join(store, "sha256")
             .withColumn("response", ~shared | F.col("page_id").eqNullSafe(F.col("response_id")))
             .withColumn("refers_to", F.when(~F.col("response"), F.col("response_id"))))
    map_batches(heads, _heads, "page_id long, sha256 binary, head binary").write.parquet(
        f"{path}/headers")
    return path


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, HTTP payload) of one record; raises ValueError if its lengths don't agree."""
    head, _, block = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    if int(fields["Content-Length"]) != len(block):
        raise ValueError("Content-Length and block differ")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = http.decode()
    return fields, payload


def _page(reference: str | None) -> int | None:
    found = re.fullmatch(rf"<{_ID}(-?\d+)>", reference or "")
    return int(found[1]) if found else None


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, key, head, gz in zip(*(batch.column(c).to_pylist() for c in
                                            ("page_id", "sha256", "head", "gz"))):
            payload = zlib.decompress(gz, 31)
            if hashlib.sha256(payload).digest() != key:
                raise ValueError(f"payload of page {page_id} does not match its digest")
            response = b"\r\nWARC-Type: response\r\n" in head[:40]
            record = head + payload if response else head
            fields, own = parse_record(record)
            if fields["WARC-Payload-Digest"] != "sha1:" + base32_sha1(payload):
                raise ValueError(f"record of page {page_id} quotes another digest")
            if response and own != payload:
                raise ValueError(f"record of page {page_id} holds another payload")
            rows.append((_page(fields["WARC-Record-ID"]), len(payload),
                         fields["WARC-Payload-Digest"][5:], fields["WARC-Type"],
                         _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"),
                         record, payload.decode()))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                 pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                   "url", "record", "html"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record put together and checked: its fields, its exact bytes, the page's html."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "gz")
    return map_batches(headers.join(payloads, "sha256"), _records,
                       "page_id long, payload_bytes long, payload_digest string, "
                       "record_type string, refers_to long, url string, record binary, "
                       "html string")


def export(records: DataFrame, path: str) -> None:
    """Write the records of ``read`` as ``.warc.gz`` files (each record ends in two line ends)."""
    (records.select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))
