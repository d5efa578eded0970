"""WARC records as a chunked table: (record, chunk number) rows, with a digest carried from chunk to chunk."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, table

#: Payload bytes of a chunk, and about how many bytes a task hands on at once.
CHUNK = 1 << 16
BATCH = 1 << 21
#: Payloads below this are always written in full.
REVISIT_BYTES = 100
#: Parts into which the rows of one payload digest are dealt for the join with their original.
SALTS = 32

_CHUNKS = pa.schema(
    [("record_no", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("header", pa.string()), ("data", pa.binary()), ("running_sha256", pa.string())]
)
_CHUNKS_SQL = "record_no long, record_id string, chunk_no long, last boolean, header string, data binary, running_sha256 string"


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload (UTF-8 of html), payload_bytes, payload_digest, record_type and refers_to.

    Of payloads of at least ``revisit_bytes`` that are equal, the record with
    the smallest page_id is the response, the others are revisits. Rows that
    share this smallest page_id are all responses; null ids are revisits of
    any id, and responses among themselves. The smallest ids come from an
    aggregation with partial sums; only digests that repeat are joined back,
    each dealt over ``SALTS`` parts, so a payload with many copies is not one
    task's work.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    repeated = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    salted = repeated.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_id"))}).drop("salt", "first_id")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header(row: dict) -> str:
    """The header block of a record, with the empty line that ends it."""
    revisit = row["record_type"] == "revisit"
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['payload_digest'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url}"] if url else []),
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        *(
            [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: {record_id(row['refers_to'], row['payload_digest'])}",
                f"X-Refers-To-Page: {row['refers_to']}",
            ]
            if revisit
            else ["Content-Type: text/html; charset=utf-8"]
        ),
        *([] if row["page_id"] is None else [f"X-Page: {row['page_id']}"]),
        f"X-Payload-Length: {row['payload_bytes']}",
        f"Content-Length: {0 if revisit else row['payload_bytes']}",
    ]
    return "\r\n".join(lines) + "\r\n\r\n"


class _Rows:
    """Collects rows and hands them on as batches of about BATCH bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 200
        if self.size > BATCH:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


def _write(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_CHUNKS)
        for batch in batches:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                body = memoryview(payloads[i].as_buffer())  # a view: the record is not copied
                if row["record_type"] == "revisit":
                    body = body[:0]
                digest, n = hashlib.sha256(), max(1, -(-len(body) // chunk))
                rid = record_id(row["page_id"], row["payload_digest"])
                for k in range(n):
                    part = body[k * chunk : (k + 1) * chunk]
                    digest.update(part)
                    yield from out.add((row["record_no"], rid, k, k == n - 1, header(row) if k == 0 else None, bytes(part), digest.hexdigest()), len(part))
        yield from out.end()

    return run


def write_chunks(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The archive as chunk rows.

    Columns: record_no (one number a record), record_id, chunk_no (from 0),
    last, header (on chunk 0), data (up to ``chunk`` payload bytes) and
    running_sha256, the digest of the payload up to the end of the chunk.
    The header, the data in the order of chunk_no and two line ends are the
    bytes of the WARC record. A task holds one batch of chunks at a time and
    carries the digest over; no record is put together again. Revisits have one
    chunk without data. Needs page_id, url and html; other columns are not
    written. Null html is an empty payload, repeated rows are records of their
    own, an empty table gives an empty archive.
    """
    typed = with_record_types(pages).withColumn("record_no", F.monotonically_increasing_id())
    return typed.select("record_no", "page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(_write(chunk), _CHUNKS_SQL)


_READ = pa.schema([("record_no", pa.int64()), ("header", pa.string()), ("read_bytes", pa.int64()), ("read_sha256", pa.string()), ("intact", pa.bool_())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, record after record: the digest goes on from chunk to chunk."""
    out, now, digest, head, size, intact, count = _Rows(_READ), None, hashlib.sha256(), None, 0, True, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["record_no"] != now:
                if now is not None:  # the last chunk of the record before is missing
                    yield from out.add((now, head, size, digest.hexdigest(), False), 0)
                now, digest, head, size, intact, count = row["record_no"], hashlib.sha256(), row["header"], 0, True, 0
            digest.update(row["data"])
            size += len(row["data"])
            intact &= row["chunk_no"] == count and digest.hexdigest() == row["running_sha256"]
            count += 1
            if row["last"]:
                yield from out.add((now, head, size, digest.hexdigest(), intact), 0)
                now = None
    if now is not None:
        yield from out.add((now, head, size, digest.hexdigest(), False), 0)
    yield from out.end()


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record from its chunks: page_id, record_type, refers_to, payload_bytes, payload_digest, url, intact.

    Records of one chunk are digested where they lie. Only the chunks of longer
    records are shuffled, by record, and streamed in order. For responses,
    bytes and digest are those of the data read; revisits state those of the
    payload they refer to. ``intact`` is false if chunks are missing, out of
    order or changed, or if the digest is not the header's.
    """
    single = F.col("last") & (F.col("chunk_no") == 0)
    whole = chunks.where(single).select("record_no", "header", F.octet_length("data").cast("long").alias("read_bytes"), F.sha2("data", 256).alias("read_sha256"), (F.sha2("data", 256) == F.col("running_sha256")).alias("intact"))
    long = chunks.where(~single).select("record_no", "chunk_no", "last", "header", "data", "running_sha256").repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
    found = whole.unionByName(long.mapInArrow(_stream, "record_no long, header string, read_bytes long, read_sha256 string, intact boolean"))

    def field(name: str):
        return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    claimed = F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "")
    return found.withColumns({"record_type": field("WARC-Type"), "claimed": claimed, "length": field("X-Payload-Length").cast("long"), "stored": field("Content-Length").cast("long")}).select(
        field("X-Page").cast("long").alias("page_id"),
        F.when(revisit, F.col("length")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("claimed")).otherwise(F.col("read_sha256")).alias("payload_digest"),
        "record_type",
        field("X-Refers-To-Page").cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.coalesce(F.col("intact") & (F.col("stored") == F.col("read_bytes")) & (revisit | (F.col("claimed") == F.col("read_sha256"))), F.lit(False)).alias("intact"),
    )


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = stage(write_chunks(table(spark, sf_dir, "pages")), "warc", "zstd")
    return read_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM m
"""
