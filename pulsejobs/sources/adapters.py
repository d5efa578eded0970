"""Other tables in the shapes of waveform data: events as samples, embeddings as windows, orders as feature rows, line items as cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import segment


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (patient, channel, idx, x, len): one record a user, in the order of time; abp_signal trails signal by three samples and starts with zeros."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("patient"), "ts", "event_id", F.col("value").alias("x"))
    rows = segment.placed(rows, "patient", F.date_trunc("day", "ts"), ["ts", "event_id"])
    as_channel = lambda c, i, x: F.struct(F.lit(c).alias("channel"), i.cast("long").alias("idx"), x.alias("x"))
    idx, x = F.col("idx"), F.col("x")
    each = F.array(as_channel("signal", idx, x), as_channel("abp_signal", idx + 3, x), F.when(idx < 3, as_channel("abp_signal", idx, F.lit(0.0))))
    return rows.select("patient", "len", F.explode(F.array_compact(each)).alias("s")).select("patient", "s.*", "len")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record (patient, signal, abp_signal): the canonical shape of stored waveforms, for records that fit in a row; samples() serves longer ones."""
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    signal = F.transform("r", lambda x: x["value"])
    return rows.select(F.col("user_id").alias("patient"), signal.alias("signal")).withColumn("abp_signal", F.transform("signal", lambda _, i: F.coalesce(F.get("signal", i - 3), F.lit(0.0))))


def wide_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 samples (patient, trial, signal)."""
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("patient"), F.col("vec_id").alias("trial"), F.col("embedding").cast("array<double>").alias("signal"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows (patient, trial, SP, DP, f1..f4): an order with the aggregates of its line items."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("f1"), F.max("l_extendedprice").alias("f2"), F.avg("l_discount").alias("f3"), F.count("*").cast("double").alias("f4"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("trial"), "o_totalprice")
    return orders.join(lines, orders.trial == lines.l_orderkey).select(
        "patient", "trial", (80 + F.col("o_totalprice") / 4000).alias("SP"), (40 + (F.col("o_totalprice") % 7000) / 100).alias("DP"), "f1", "f2", "f3", "f4"
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged cycles, one sample a row (win, cyc, pos, x): the quantities that a supplier shipped in a month."""
    order = Window.partitionBy("l_suppkey", F.date_trunc("month", "l_shipdate")).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("win"), F.date_trunc("month", "l_shipdate").alias("cyc"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_quantity").alias("x"))
