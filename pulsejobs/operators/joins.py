"""Joins and set operations on windows, subjects, features and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_subjects(windows: DataFrame, info: DataFrame, on: str = "patient") -> DataFrame:
    """Windows of known patients with their demographics; Spark broadcasts the table if its size allows."""
    return windows.join(info, on)


def first_match(lookup: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first in the given order. Minima merge before the shuffle, so a frequent key is no large group."""
    first = F.min_by(F.struct(*lookup.columns), F.struct(*order))
    return lookup.groupBy(key).agg(first.alias("_r")).select("_r.*")


def keep_in_step(signals: DataFrame, features: DataFrame, on: tuple[str, ...] = ("patient", "trial")) -> DataFrame:
    """The signal rows whose feature rows are still there."""
    return signals.join(features.select(*on), list(on), "left_semi")


def without(windows: DataFrame, deny: DataFrame, on: list[str]) -> DataFrame:
    return windows.join(deny, on, "left_anti")


def stacked(*parts: DataFrame) -> DataFrame:
    """Parts one under the other; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def without_helpers(df: DataFrame, helpers: tuple[str, ...] = ("label_class", "agg_ohe")) -> DataFrame:
    return df.drop(*helpers)
