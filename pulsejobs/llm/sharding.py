"""Contiguous shards of equal bytes from global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

SHARDS = 8


def byte_shards(df: DataFrame, order_by: list[str], size: str, n_shards: int) -> DataFrame:
    """Cut the rows, in the order of ``order_by``, into ``n_shards`` contiguous runs of near-equal ``size`` sums.

    The rows are range-partitioned on the order columns (a running row number
    last, so that no key, however frequent, fills a partition). Each partition
    sums its own bytes and rows; the running totals over *partitions* (one row
    each) give every partition its offset; a row's global prefix sum is that
    offset plus the prefix sum inside its partition. A row goes to the shard in
    which its first byte lies: cuts fall at equal byte targets, a shard is at
    most one row over its target.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).
    Only the given columns travel; pass a slim table. Null order values come
    first, sizes that are null count as 0, rows that are equal in all order
    columns are put in an arbitrary order, an empty table gives an empty
    result. All rows of size 0 go to shard 0. Sizes must not be negative.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    order = [F.col(c).asc_nulls_first() for c in order_by]
    dealt = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_tie"))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    )
    dealt = stage(dealt, "shard-rows")  # the ranges are sampled: fixed here, once
    # One row for each partition from here on.
    parts = dealt.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    placed = (
        dealt.withColumn("_sum", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_row", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(parts), "_part")
        .withColumn("_start", F.col("_sum") + F.col("_bytes_before"))
        .withColumn(
            "shard",
            F.when(F.col("_total") > 0, F.least(F.lit(n_shards - 1), F.floor(F.col("_start").cast("decimal(38,0)") * n_shards / F.col("_total")).cast("int"))).otherwise(0),
        )
        .withColumn("_row", F.col("_row") + F.col("_rows_before"))
    )
    placed = stage(placed.drop("_part", "_bytes_before", "_rows_before", "_total", "_sum", "_start", "_size", "_tie"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def doc_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """One row per document: where :func:`byte_shards` puts it, in the order of doc_id, text_crc32 and size."""
    return byte_shards(doc_sizes(docs), ["doc_id", "text_crc32", "size"], "size", n_shards)


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ids with size, shard and slot."""
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


OP6_SQL = """
WITH steps AS (
  SELECT n, list_reduce(list_concat([n::BIGINT], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(n)),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM steps),
bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS e FROM documents),
crcs AS (
  SELECT doc_id, octet_length(e)::BIGINT + 1 AS size,
    xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(e), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)::BIGINT AS text_crc32
  FROM bytes, crc_table),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total
  FROM crcs),
cut AS (SELECT *, least(7, (start::HUGEINT * 8) // total::HUGEINT)::INT AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""
