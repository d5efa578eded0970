"""Mean pressure cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

LIMIT, ADDED, WIDTH = 149, 15, 1.25
ROUNDING = 1e-12


def clipped(cycles: str, limit: int = LIMIT) -> Column:
    return F.transform(cycles, lambda c: F.slice(c, 1, limit))


def samples(df: DataFrame, keys: list[str], cycles: str) -> DataFrame:
    """Long form (keys, cyc, pos, x) of a list of cycles."""
    each = df.select(*keys, F.posexplode(cycles).alias("cyc", "c"))
    return each.select(*keys, "cyc", F.posexplode("c").alias("pos", "x"))


def position_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, mu, sigma, n): mean and population deviation at each position over the cycles that reach it."""
    return rows.groupBy(*keys, "pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"), F.count("*").alias("n"))


def trimmed_mean(rows: DataFrame, keys: list[str], width: float = WIDTH, hot: int = 1_000_000, salts: int = 32) -> DataFrame:
    """(keys, pos, x): mean of the samples within ``width`` deviations of the mean of their position.

    A sample at exactly that distance counts. Deviations come from partial
    results that merge in any order, so such a sample may miss by rounding;
    ``ROUNDING`` is the room it has, in units of the numbers at hand.
    A single cycle comes out as it is: each sample is its position's mean. A
    position with missing samples only stays, without a value. Two passes of
    sums that merge: the moments of each position, then the sums of what is
    near. A position of more than ``hot`` samples is dealt over ``salts``
    tasks; there is at most one such position for ``hot`` rows, so their keys
    are broadcast.
    """
    by = [*keys, "pos"]
    stats = position_stats(rows, keys).withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    large = F.broadcast(stats.where(F.col("n") > hot).select(*[f"_k_{c}" for c in by], F.lit(True).alias("_large")))
    dealt = rows.join(large, same, "left").withColumn("_salt", F.when(F.col("_large"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")).otherwise(0)).drop("_large", *[f"_k_{c}" for c in by])
    copied = stats.withColumn("_s", F.explode(F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    held = dealt.join(copied, same & (F.col("_salt") == F.col("_s")))
    near = F.abs(F.col("x") - F.col("mu")) <= width * F.col("sigma") + ROUNDING * (F.abs("mu") + F.abs("x"))
    parts = held.groupBy(*by, "_salt").agg(*[f(x).alias(n) for n, f, x in (("_s", F.sum, F.when(near, F.col("x"))), ("_c", F.count, F.when(near, F.col("x"))), ("_all", F.sum, F.col("x")), ("_n", F.count, F.col("x")))])
    # equal samples may all miss their mean by rounding
    return parts.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("_s"), F.sum("_c")), F.try_divide(F.sum("_all"), F.sum("_n"))).alias("x"))


def mean_cycles(trimmed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean): the positions as one array."""
    held = trimmed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_r"))
    return held.select(*keys, F.transform("_r", lambda r: r["x"]).alias("mean"))


def gradient(a: str) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(a)
    return F.when(n > 1, F.transform(a, lambda x, i: F.when(i == 0, A.at(a, 1) - x).when(i == n - 1, x - A.at(a, n - 2)).otherwise((A.at(a, i + 1) - A.at(a, i - 1)) / 2)))


def landmarks(df: DataFrame, mean: str = "mean") -> DataFrame:
    """Adds sys_peak (highest sample of the first 45 %), dia_notch, SP, DP and class_limits.

    The notch is the steepest rise after the steepest fall in the half of the
    rest that follows the peak. Cycles that are too short for a peak get null.
    """
    n = F.size(mean)
    df = df.withColumn("sys_peak", A.argmax(A.cut(mean, 0, F.floor(n * 0.45)))).withColumn("_g", gradient(mean))
    end = F.floor((n - F.col("sys_peak")) * 0.5).cast("int") + F.col("sys_peak")
    df = df.withColumn("_end", end)
    df = df.withColumn("_y", A.argmin(A.cut("_g", F.col("sys_peak"), F.col("_end"))) + F.col("sys_peak"))
    df = df.withColumn("dia_notch", A.argmax(A.cut("_g", F.col("_y"), F.col("_end") + 1)) + F.col("_y"))
    limits = F.array("sys_peak", "dia_notch", n, n + ADDED)
    return df.withColumns({"SP": F.array_max(mean), "DP": F.array_min(mean), "class_limits": limits}).drop("_g", "_end", "_y")


def wrapped(a: str, length: int = LIMIT + ADDED) -> Column:
    """The array repeated up to a fixed length."""
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: A.at(a, i % F.size(a))))


def flag_shares(df: DataFrame, cycles: str = "cs") -> DataFrame:
    """One row: counts and percentages of flag1, flag2 and windows without a cycle."""
    marks = {"f1": F.col("flag1"), "f2": F.col("flag2"), "nocy": F.size(cycles) == 0}
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(*[count(c).alias(k) for k, c in marks.items()], *[F.try_divide(count(c) * 100.0, F.count("*")).alias(f"{k}_pct") for k, c in marks.items()])


def phase_masks(limits: str = "class_limits", length: int = LIMIT + ADDED) -> Column:
    """Four 0/1 rows: beyond the cycle, up to the peak, peak to notch, notch to end."""
    peak, notch, end = (A.at(limits, i) for i in range(3))
    row = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= lo) & (i < hi)).cast("int"))
    return F.array(row(end, F.lit(length)), row(F.lit(0), peak), row(peak, notch), row(notch, end))


def valid_mask(limits: str = "class_limits", length: int = LIMIT + ADDED) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i < A.at(limits, 3)).cast("int"))
