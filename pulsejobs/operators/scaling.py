"""Scaling of features, labels and waveforms, and choice of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .splits import rotations

#: Fixed ranges of label scales.
RANGES = {"SP": (80.0, 200.0), "DP": (50.0, 110.0), "ptt": (100.0, 900.0)}


def fold_extremes(folded: DataFrame, features: list[str]) -> DataFrame:
    """One row a fold: lowest and highest value of each feature; missing values do not count. One pass with partial results."""
    return folded.groupBy("fold").agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"_{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])


def run_extremes(folded: DataFrame, k: int, features: list[str], first_only: bool = False) -> DataFrame:
    """One row a rotation: the extremes of its train rows, put together from those of the folds, so no row is read or copied once for each rotation."""
    train = rotations(fold_extremes(folded, features), k, first_only).where("mode = 'tr'").groupBy("run")
    return train.agg(*[f(f"_{n}_{c}").alias(f"_{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])


def min_max(c: str, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo), x - lo if constant."""
    return (F.col(c) - lo) / F.when(hi - lo == 0, 1.0).otherwise(hi - lo)


def scaled_rotations(folded: DataFrame, k: int, features: list[str], first_only: bool = False) -> DataFrame:
    """The rows of all rotations (run, mode), features scaled by the train rows of their rotation; missing values stay missing.

    The fits are one row a rotation, which is broadcast.
    """
    out = rotations(folded, k, first_only).join(F.broadcast(run_extremes(folded, k, features, first_only)), "run")
    out = out.withColumns({c: min_max(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in features})
    return out.drop(*[f"_{n}_{c}" for c in features for n in ("lo", "hi")])


def to_range(c: Column, kind: str) -> Column:
    lo, hi = RANGES[kind]
    return (c - lo) / (hi - lo)


def from_range(c: Column, kind: str) -> Column:
    lo, hi = RANGES[kind]
    return c * (hi - lo) + lo


def global_statistics(df: DataFrame, train_only: bool = False) -> DataFrame:
    """One row: mean, deviation, min and max of SP and DP (sample deviation) and of all samples of signal and abp_signal (population).

    Each window sums its samples and their squares around a fixed centre (the
    first pass's mean), so no sample leaves its row. Without abp_signal its
    figures are 0, 1, 0, 1.
    """
    if train_only:
        df = df.where("mode = 'tr'")
    waves = [c for c in ("signal", "abp_signal") if c in df.columns]
    means = df.agg(*[(F.sum(A.total(c)) / F.sum(F.size(c))).alias(f"_{c}") for c in waves])
    held = df.crossJoin(F.broadcast(means))
    out = []
    for c in ("SP", "DP"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    for c in waves:
        around = A.moment(c, F.col(f"_{c}"), 2) * F.size(c)
        out += [F.max(f"_{c}").alias(f"{c}_mean"), F.sqrt(F.sum(around) / F.sum(F.size(c))).alias(f"{c}_std"), F.min(F.array_min(c)).alias(f"{c}_min"), F.max(F.array_max(c)).alias(f"{c}_max")]
    if "abp_signal" not in waves:
        out += [F.lit(float(v)).alias(f"abp_signal_{n}") for n, v in (("mean", 0), ("std", 1), ("min", 0), ("max", 1))]
    return held.agg(*out)


def global_min_max(x: Column, kind: str, inverse: bool = False) -> Column:
    lo, hi = F.col(f"{kind}_min"), F.col(f"{kind}_max")
    return x * (hi - lo) + lo if inverse else (x - lo) / (hi - lo)


def global_z(x: Column, kind: str, inverse: bool = False, eps: float = 1e-6) -> Column:
    m, s = F.col(f"{kind}_mean"), F.col(f"{kind}_std") + eps
    return x * s + m if inverse else (x - m) / s


def filled(df: DataFrame, features: list[str], trees: bool = False) -> DataFrame:
    """Missing features are 0, except for tree models."""
    return df if trees else df.na.fill(0.0, features)


def mean_importance(sp: DataFrame, dp: DataFrame) -> DataFrame:
    """(features, importance): mean of two importance tables over the features that both have."""
    return sp.alias("a").join(dp.alias("b"), "features").select("features", ((F.col("a.importance") + F.col("b.importance")) / 2).alias("importance"))


def top_features(importance: DataFrame, rate: float) -> DataFrame:
    """The int(n * rate) most important features; equal ones by name."""
    return importance.orderBy(F.desc("importance"), "features").limit(int(importance.count() * rate))
