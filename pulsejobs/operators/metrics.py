"""Errors of predictions, baselines and pressure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .splits import rotations


def error_columns(error: str = "error", digits: int = 3) -> list:
    """Mean absolute error, population deviation, mean error."""
    e = F.col(error)
    return [F.round(F.avg(F.abs(e)), digits).alias("mae"), F.round(F.stddev_pop(e), digits).alias("std"), F.round(F.avg(e), digits).alias("me")]


def summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Errors (pred - label) of a long prediction table by columns, e.g. mode and target."""
    return predictions.withColumn("error", F.col("pred") - F.col("label")).groupBy(*by).agg(*error_columns())


def summary_with_folds(predictions: DataFrame) -> DataFrame:
    """Errors by mode, target and fold, and pooled over folds (fold null), from one pass."""
    held = predictions.withColumn("error", F.col("pred") - F.col("label"))
    return held.groupingSets([["mode", "target", "fold"], ["mode", "target"]], "mode", "target", "fold").agg(*error_columns())


def with_naive(folded: DataFrame, k: int, targets: list[str]) -> DataFrame:
    """Long table (run, mode, target, patient, trial, label, naive): naive is the mean label of the run's train rows.

    The train mean comes from sums by fold (k rows), not from k copies of the rows.
    """
    sums = folded.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(t).alias(f"s_{t}") for t in targets])
    means = rotations(sums, k).where("mode = 'tr'").groupBy("run").agg(*[(F.sum(f"s_{t}") / F.sum("n")).alias(f"naive_{t}") for t in targets])
    out = rotations(folded, k).join(F.broadcast(means), "run")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("label"), F.col(f"naive_{t}").alias("naive")) for t in targets]))
    return out.select("run", "mode", "patient", "trial", "fold", each.alias("r")).select("run", "mode", "patient", "trial", "fold", "r.*")


def naive_report(folded: DataFrame, k: int, targets: list[str]) -> DataFrame:
    """(target, mae, std, me) of the naive baseline, pooled over the test rows of all rotations: each row is tested once."""
    sums = folded.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(t).alias(f"s_{t}") for t in targets])
    means = rotations(sums, k).where("mode = 'tr'").groupBy("run").agg(*[(F.sum(f"s_{t}") / F.sum("n")).alias(f"naive_{t}") for t in targets])
    tested = folded.join(F.broadcast(means), F.col("fold") == F.col("run"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), (F.col(f"naive_{t}") - F.col(t)).alias("error")) for t in targets]))
    return tested.select(each.alias("r")).select("r.*").groupBy("target").agg(*error_columns())


def scaled_error(model: DataFrame, naive: DataFrame) -> DataFrame:
    """(target, scaled_mae): error of the model in units of the baseline's."""
    return model.alias("m").join(naive.alias("n"), "target").select("target", F.round(F.col("m.mae") / F.col("n.mae"), 4).alias("scaled_mae"))


def pressure_shares(df: DataFrame, sp: str = "SP", dp: str = "DP") -> DataFrame:
    """One row: shares of rows beyond the usual pressure limits."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(
        *[share(F.col(sp) >= x).alias(f"sp_ge_{x}") for x in (160, 140)],
        share(F.col(sp) <= 100).alias("sp_le_100"),
        *[share(F.col(dp) >= x).alias(f"dp_ge_{x}") for x in (100, 85)],
        *[share(F.col(dp) <= x).alias(f"dp_le_{x}") for x in (70, 60)],
    )


def waveform_error(df: DataFrame, pred: str, true: str) -> DataFrame:
    """One row: mse, mae and me over all samples, and the sample deviation of the windows' mean errors."""
    e = F.zip_with(pred, true, lambda p, t: p - t)
    held = df.select(e.alias("e"))
    n = F.sum(F.size("e"))
    return held.agg(
        (F.sum(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)) / n).alias("mse"),
        (F.sum(F.aggregate("e", F.lit(0.0), lambda s, x: s + F.abs(x))) / n).alias("mae"),
        (F.sum(A.total("e")) / n).alias("me"),
        F.stddev_samp(A.mean("e")).alias("std"),
    )


def masked_pressure(df: DataFrame, pred: str, mask: str) -> DataFrame:
    """Adds SP and DP: largest and smallest prediction where the mask is 1; null if it is nowhere."""
    kept = F.filter(pred, lambda _, i: A.at(mask, i) == 1)
    return df.withColumns({"SP": F.array_max(kept), "DP": F.array_min(kept)})
