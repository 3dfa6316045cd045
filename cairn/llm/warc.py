"""Content-addressed WARC archive.

``write_archive`` turns pages into WARC records and stores them as two tables: ``payloads`` holds every
distinct payload once, compressed, under its SHA-256, and ``records`` the exact header bytes of each record (WARC
header and HTTP header) with the digest of its payload. The digest is verified twice: when writing, all
records that share it must agree in size and SHA-1; when reading, the stored bytes must hash to it.
``read_archive`` rebuilds the original records by joining the two tables and parses them.

Of the records whose payloads are equal and have at least ``revisit_bytes`` bytes, the one with the largest
page_id is the response and the others revisit it; smaller payloads are responses always.

Skew: a digest that many records share is dealt out over salts of ``SALT_ROWS`` records each, on both sides of
the join, so no task gets an unbounded group.

Defined cases: a null html is an empty payload; a null url gives an empty target; line ends in a url are percent-encoded in its header; null page_ids rank below all
others (a group of nothing but nulls has only responses); repeated rows are records of their own, and rows that
share the largest page_id are all responses; an empty table gives an empty archive. Only the three named
columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, shared_path

SALT_ROWS = 10_000
REVISIT_BYTES = 1000
RECORD_DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-cairn:page:"
PARSED_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id) -> F.Column:
    return F.concat(F.lit("<" + URN), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads as zlib streams, by which they move and are stored."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            packed = pa.array([zlib.compress(x.as_buffer(), 3) for x in part.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=["page_id", "sha256", "packed"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write ``path/payloads`` and ``path/records``."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumns({"size": F.length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.unhex(F.sha2("payload", 256))})
    verified = F.when((F.min("sha1") == F.max("sha1")) & (F.min("size") == F.max("size")), F.count(F.lit(1))).otherwise(F.raise_error(F.lit("different payloads share a digest")).cast("long"))
    groups = base.groupBy("sha256").agg(F.max("page_id").alias("keep_id"), verified.alias("n"))
    groups = groups.select("sha256", "keep_id", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    kept = groups.withColumnRenamed("sha256", "key")
    # packed before they move; the join's keys are those of the de-duplication: one shuffle
    payloads = base.select("page_id", "sha256", "payload").mapInArrow(_packed, "page_id long, sha256 binary, packed binary").join(kept, F.col("page_id").eqNullSafe(F.col("keep_id")) & (F.col("sha256") == F.col("key")))
    payloads.dropDuplicates(["page_id", "sha256"]).select("sha256", "salts", "packed").write.parquet(f"{path}/payloads")
    del payloads
    release(pages.sparkSession)

    revisit = (F.col("size") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    length = F.length("http") + F.when(revisit, 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Date", F.lit(RECORD_DATE)), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn(F.col("keep_id"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length.cast("string")), F.lit("\r\n"), F.col("http"),
    )
    # a hot digest is on one side only, so adaptive execution can split it
    records = base.drop("payload").join(groups.hint("merge"), "sha256").withColumn("http", http)
    records.select("page_id", "sha256", "salts", kind.alias("record_type"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/records")


def rebuild(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record, referred): the exact bytes of each record, and for revisits the payload they refer to."""
    spread = payloads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = records.withColumn("salt", F.pmod(F.xxhash64("header"), F.col("salts")).cast("int")).drop("salts")
    joined = salted.join(spread, ["sha256", "salt"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                keys, kinds, headers, packed = (c.to_pylist() for c in batch.slice(first, 256).columns)
                payloads = [zlib.decompress(x) for x in packed]
                whole = [k == "response" for k in kinds]
                records = [h + (p if w else b"") + b"\r\n\r\n" for h, p, w in zip(headers, payloads, whole, strict=True)]
                referred = [None if w else p for p, w in zip(payloads, whole, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (keys, records, referred)], names=["sha256", "record", "referred"])

    return joined.select("sha256", "record_type", "header", "packed").mapInArrow(opened, "sha256 binary, record binary, referred binary")


def parse_record(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``start``; header names are lower-case."""
    end = data.index(b"\r\n\r\n", start)
    version, *lines = data[start:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    first, size = end + 4, int(headers["content-length"])
    if len(data) < first + size + 4 or data[first + size : first + size + 4] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    return headers, data[first : first + size], first + size + 4


def _page(urn: str | None) -> int | None:
    text = (urn or "<null>").rpartition(":")[2].strip("<>")
    return int(text) if text != "null" else None


def parsed(rebuilt: DataFrame) -> DataFrame:
    """Parse rebuilt records, as PARSED_SCHEMA; a payload that doesn't match its digests is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, record, referred in zip(*batch.columns, strict=True):
                headers, block, _ = parse_record(record.as_py())
                payload = block.partition(b"\r\n\r\n")[2] if not referred.is_valid else referred.as_py()
                digest = hashlib.sha1(payload).hexdigest()
                if headers["warc-payload-digest"] != f"sha1:{digest}" or hashlib.sha256(payload).digest() != key.as_py():
                    raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
                kind = headers["warc-type"]
                out.append((_page(headers["warc-record-id"]), len(payload), digest, kind, _page(headers.get("warc-refers-to")) if kind == "revisit" else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return rebuilt.select("sha256", "record", "referred").mapInArrow(rows, PARSED_SCHEMA)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of a content-addressed archive, rebuilt and parsed."""
    return parsed(rebuild(spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_type, target, headers, block): records of plain or gzipped WARC files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, at, out = content.as_py(), 0, []
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                while at < len(data):
                    headers, block, at = parse_record(data, at)
                    out.append({"file": name.as_py(), "record_type": headers.get("warc-type"), "target": headers.get("warc-target-uri"), "headers": list(headers.items()), "block": block})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, record_type string, target string, headers map<string,string>, block binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    release(spark)  # the archive is written: its shuffles needn't lie beside those of reading it
    return read_archive(spark, path)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep_id FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> keep_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> keep_id THEN keep_id END AS refers_to
FROM p JOIN g USING (h)
"""
