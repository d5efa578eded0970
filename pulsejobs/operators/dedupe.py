"""Duplicate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many keys of removed windows are broadcast (some 50 bytes each); more take part in a shuffle join.
BROADCAST_KEYS = 1_000_000


def digest(c: str) -> Column:
    """128 bits of an array: two 64-bit hashes of its values with different beginnings, its length and the places of its nulls.

    0.0 and -0.0 are equal, as are all NaN. A null array is equal to null
    arrays only.
    """
    missing = F.transform(c, lambda x: x.isNull())
    return F.struct(*[F.xxhash64(F.lit(k), F.col(c).isNull(), F.size(c), missing, F.col(c)).alias(f"h{k}") for k in (1, 2)])


def _slim(windows: DataFrame, order: list[str], channels: tuple[str, ...]) -> DataFrame:
    return windows.select(F.struct(*order).alias("_key"), *[digest(c).alias(f"_{c}") for c in channels])


def removed_keys(windows: DataFrame, order: list[str], channels: tuple[str, ...] = ("signal", "abp_signal")) -> DataFrame:
    """The order keys of windows that are not the first (by ``order``, unique) of their equals in a channel, among those that the channels before have left.

    Firsts are minima with partial results, so a digest with very many copies
    is no hot group there; the join that finds the others is on slim rows, and
    only digests that occur twice take part.
    """
    left, gone = _slim(windows, order, channels), None
    for d in [f"_{c}" for c in channels]:
        firsts = left.groupBy(d).agg(F.min_by(F.struct("_key", *[f"_{c}" for c in channels]), "_key").alias("_first"), F.count("*").alias("_n"))
        many = firsts.where("_n > 1").select(F.col(d).alias("_of"), F.col("_first._key").alias("_least"))
        copies = left.join(many, left[d] == many["_of"]).where(~F.col("_key").eqNullSafe(F.col("_least"))).select("_key")
        gone = copies if gone is None else gone.unionByName(copies)
        left = firsts.select("_first.*")
    return gone.select("_key.*")


def drop_duplicate_windows(windows: DataFrame, order: list[str], channels: tuple[str, ...] = ("signal", "abp_signal"), most: int = BROADCAST_KEYS) -> DataFrame:
    """The first window (by ``order``, unique) of each equal first channel; of these the first of each equal second channel, and so on.

    Windows stay where they are: the keys of those that go are counted up to
    ``most``, and so many are broadcast. With more of them, windows and keys
    meet by a shuffle.
    """
    gone = removed_keys(windows, order, channels)
    few = gone.limit(most + 1).count() <= most
    keys = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in order])
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_gone_{c}"))
    return windows.join(F.broadcast(keys) if few else keys, same, "left_anti")


def duplicate_counts(windows: DataFrame, order: list[str], channels: tuple[str, ...] = ("signal", "abp_signal")) -> DataFrame:
    """(rows, removed): one row, before the duplicates go and how many go."""
    removed = removed_keys(windows, order, channels).agg(F.count("*").alias("removed"))
    return windows.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(removed))
