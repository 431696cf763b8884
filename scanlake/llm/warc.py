"""WARC archives: written from captures, read back, and joined into transactions.

Writing: each capture gives a request, a response (or a revisit, where another capture with the same payload is the
response) and a metadata record, bound by WARC-Concurrent-To. Records are text columns, built without Python,
and Spark's text writer lays them down with the blank lines that end a record, compressed with gzip.

Reading: each file is parsed as a stream by Content-Length. Transactions: records are brought together by the
request that they are concurrent to, one nested row for each capture; a revisit gets length and digest of its
payload from the response that it refers to.

Of captures with equal payloads the one with the largest page id is the response. Every record has an identifier of
its own. Defined cases: a null html is an empty payload, a null url an empty target; rows that repeat the largest id
are responses each, of which revisits refer to one, and so are rows without an id that share a payload with no
row that has one; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_map, fewer_parts, scratch_path, written

#: Captures in one file at most, and bytes of payload by the mean; a file is unpacked as a stream, so that a task holds its packed bytes and one record.
FILE_CAPTURES, FILE_BYTES = 2000, 64 << 20
#: Payload groups up to this number (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
DATE = "2024-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hexadecimal digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _uuid(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the captures in pages as WARC files under path."""
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).cast("long").alias("n"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.sha1(F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")).alias("sha1"),
    )
    rows = rows.withColumn("at", F.monotonically_increasing_id().cast("string"))
    keys = written(rows.select("sha1", "n", F.octet_length("html").alias("bytes")), "keys")  # so that payloads are read and hashed twice only
    groups = written(keys.groupBy("sha1").agg(F.max("n").alias("lead"), F.count("*").alias("copies"), F.sum("bytes").alias("bytes")), "payloads")
    captures, held = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shared = groups.where("copies > 1 and lead is not null").select(F.col("sha1").alias("of"), "lead")
    if shared.count() <= BROADCAST_GROUPS:
        shared = F.broadcast(shared)
    rows = rows.join(shared, rows["sha1"] == shared["of"], "left")
    leading = F.col("n").eqNullSafe(F.col("lead"))
    again = F.col("lead").isNotNull() & ~leading
    leads = keys.join(shared, keys["sha1"] == shared["of"]).where("n = lead")
    repeated = written(leads.groupBy(F.col("sha1").alias("again_of")).count().where("count > 1").select("again_of"), "repeated")
    if repeated.isEmpty():
        first = F.lit(True)
    else:  # of rows that repeat the largest id one is referred to, so they are numbered in a table that is read once more
        rows = written(rows.drop("of"), "captures")
        one = written(rows.where(F.col("lead").isNotNull() & leading).join(repeated, F.col("sha1") == F.col("again_of")).groupBy(F.col("sha1").alias("one_of")).agg(F.min("at").alias("one")), "firsts")
        rows = rows.join(one, F.col("sha1") == F.col("one_of"), "left")
        first = F.coalesce(F.col("at") == F.col("one"), F.lit(True))
    capture = _uuid("request", F.coalesce("id", F.lit("")), F.col("at"))
    ident = lambda n: _uuid("response", F.coalesce(n.cast("string"), F.lit("")), F.col("sha1"))
    own = F.when(F.col("n").isNotNull() & first, ident(F.col("n"))).otherwise(_uuid("response", F.coalesce("id", F.lit("")), F.col("sha1"), F.col("at")))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    rest = F.substring_index("url", "://", -1)
    host, path_ = F.regexp_extract(rest, "^([^/?#]*)", 1), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(F.startswith(path_, F.lit("/")), path_).otherwise(F.concat(F.lit("/"), path_)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", DATE), ("WARC-Target-URI", F.col("url"))]
    out = rows.select(
        F.array(
            _record([("WARC-Type", "request"), ("WARC-Record-ID", capture), *common, ("Content-Type", "application/http;msgtype=request")], request),
            F.when(
                again,
                _record(
                    [("WARC-Type", "revisit"), ("WARC-Record-ID", _uuid("revisit", F.coalesce("id", F.lit("")), F.col("at"))), ("WARC-Concurrent-To", capture), ("WARC-Refers-To", ident(F.col("lead"))), *common,
                     ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")],
                    answer,
                ),
            ).otherwise(
                _record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Concurrent-To", capture), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")], F.concat(answer, "html"))
            ),
            _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata", F.coalesce("id", F.lit("")), F.col("at"))), ("WARC-Concurrent-To", capture), *common, ("Content-Type", "application/warc-fields")], F.concat(F.lit("pageId: "), F.coalesce("id", F.lit("")), F.lit("\r\n"))),
        ).alias("records")
    )
    in_file = max(1, min(FILE_CAPTURES, FILE_BYTES * captures // max(1, held)))
    out = fewer_parts(out.select(F.explode("records").alias("value")))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * in_file).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)


class _Stream:
    """Bytes of a gzip (or plain) file, unpacked as they are asked for."""

    def __init__(self, raw: bytes, step: int = 1 << 20):
        self.raw, self.at, self.step, self.buffer = raw, 0, step, bytearray()
        self.unpack = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + self.step]
        self.at += len(part)
        if self.unpack is None:
            self.buffer += part
            return True
        while part:
            self.buffer += self.unpack.decompress(part)
            part = self.unpack.unused_data
            if self.unpack.eof:  # members may follow one another, one for each record
                self.unpack = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of the records in a WARC file."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().lstrip("\r\n").rstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"a record starts with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record has another length than it says")
        yield headers, block


_FIELDS = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id string, payload_bytes long, payload_digest string, payload binary"


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                for h, block in records(b.column(0)[i].as_py()):
                    kind, page_id, n, digest, payload = h["warc-type"], None, None, None, None
                    if kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                        page_id = fields["pageId"] or None
                    elif kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if h["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"the payload of {h['warc-record-id']} has another digest than its header")
                    elif kind == "revisit":
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page_id, n, digest, payload if with_payload else None))
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) >= 1024 or held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the WARC files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return arrow_map(files.select("content"), _parse(with_payload), _FIELDS)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (a response or a revisit) and metadata."""
    capture = F.when(F.col("type") == "request", F.col("record_id")).otherwise(F.col("concurrent_to"))
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct("*")), ignorenulls=True)
    nested = found.groupBy(capture.alias("capture")).agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata")).where("request is not null")
    page_id = F.col("metadata.page_id").cast("long")
    # a table of its own, so that the join of many revisits of one response reads plain exchanges, which Spark can split
    leads = written(nested.where("response.type = 'response'").select(F.col("response.record_id").alias("of"), F.col("response.payload_bytes").alias("bytes_"), F.col("response.payload_digest").alias("digest_"), page_id.alias("lead_id")), "leads")
    # captures that refer to nothing are dealt by their own identifier, which no response has
    joined = nested.join(leads, F.coalesce("response.refers_to", "capture") == F.col("of"), "left")
    revisit = F.col("response.type") == "revisit"
    return joined.select(
        page_id.alias("page_id"), F.when(revisit, F.col("bytes_")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest_")).otherwise(F.col("response.payload_digest")).alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.when(revisit, F.col("lead_id")).alias("refers_to"), "request", "response", "metadata",
    )


def query(spark, sf_dir: str) -> DataFrame:
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path := scratch_path(spark, "archives"))
    found = written(read_records(spark, path), "records")
    return transactions(found).drop("request", "response", "metadata")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS lead FROM h),
d AS (SELECT *, [CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT) & 31 FOR i IN range(32)] AS digits FROM l)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x + 1 AS INT), 1) FOR x IN digits], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM d
"""
