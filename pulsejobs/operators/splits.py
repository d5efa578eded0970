"""Splits by patient, rotations of folds, their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(c: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))


def _ranked(df: DataFrame, seed: int, patient: str) -> DataFrame:
    """(patient, _rank, _all): the patients' places in the order of a seeded hash, and their number.

    Ranks come from counting range partitions first, so no task sees all
    patients: a patient's rank is the number in earlier hash buckets (4096,
    counted) and its rank inside the bucket.
    """
    who = df.select(patient).distinct().withColumn("_h", _draw(F.col(patient), seed))
    who = who.withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = who.groupBy("_bucket").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_bucket")  # at most 4096 rows
    before = counts.select("_bucket", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", patient)) - 1
    return who.withColumn("_rank", rank).join(F.broadcast(before), "_bucket").select(patient, (F.col("_rank") + F.col("_before")).alias("_rank"), "_all")


def patient_folds(df: DataFrame, k: int, seed: int, patient: str = "patient") -> DataFrame:
    """(patient, fold): patients in the order of a seeded hash, cut into k near-equal parts, the first ones larger."""
    placed = _ranked(df, seed, patient)
    base, more = F.floor(F.col("_all") / k), F.col("_all") % k
    # the first `more` folds hold one patient more
    large = more * (base + 1)
    fold = F.when(F.col("_rank") < large, F.floor(F.col("_rank") / (base + 1))).otherwise(more + F.floor((F.col("_rank") - large) / F.greatest(base, F.lit(1))))
    return placed.select(patient, fold.cast("int").alias("fold"))


def with_folds(df: DataFrame, k: int, seed: int, patient: str = "patient") -> DataFrame:
    """Every row with its patient's fold."""
    return df.join(patient_folds(df, k, seed, patient), patient)


def part_of(patient: str | Column) -> Column:
    """The first two tokens of an id, the part of the collection it comes from."""
    return F.substring_index(F.col(patient) if isinstance(patient, str) else patient, "_", 2)


def hold_out(df: DataFrame, train: list[str], val: list[str], test: list[str], seed: int = 0, patient: str = "patient", val_share: float = 0.2) -> DataFrame:
    """Rows of the listed parts with fold 0 (test), 1 (val), 2 (train).

    If val and test are the same parts, int(val_share * n) of their n patients,
    the first by a seeded hash, become val, the others test.
    """
    part = part_of(patient)
    if sorted(val) != sorted(test):
        fold = F.when(part.isin(test), 0).when(part.isin(val), 1).when(part.isin(train), 2)
        return df.withColumn("fold", fold).where("fold IS NOT NULL")
    shared = df.where(part.isin(test))
    chosen = _ranked(shared, seed, patient).where(F.col("_rank") < F.floor(F.col("_all") * val_share)).select(patient)
    return (
        shared.join(chosen, patient, "left_semi").withColumn("fold", F.lit(1))
        .unionByName(shared.join(chosen, patient, "left_anti").withColumn("fold", F.lit(0)))
        .unionByName(df.where(part.isin(train) & ~part.isin(test)).withColumn("fold", F.lit(2)))
    )


def rotations(df: DataFrame, k: int, first_only: bool = False) -> DataFrame:
    """Every row once for each rotation: run i tests fold i, validates on fold i + 1, trains on the rest. Adds run, mode."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(0 if first_only else k - 1)))
    out = df.withColumn("run", runs)
    return out.withColumn("mode", F.when(F.col("fold") == F.col("run"), "ts").when(F.col("fold") == (F.col("run") + 1) % k, "val").otherwise("tr"))


def leaks(df: DataFrame, patient: str = "patient") -> DataFrame:
    """Patients in more than one fold: none, if a split is right."""
    return df.groupBy(patient).agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def fold_counts(df: DataFrame) -> DataFrame:
    """(fold, rows) and the total with a null fold."""
    return df.rollup("fold").agg(F.count("*").alias("rows"))
