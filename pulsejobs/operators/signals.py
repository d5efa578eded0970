"""Transforms of one array to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.vec import band_pass, spline_baseline

#: Fixed weights of the smoothed first derivative (7 points, cubic), over 252.
SMOOTH = (22, -67, -58, 0, 58, 67, -22)


def filtered(signal: str, low: float, high: float, fs: float) -> Column:
    """Mean removed, band-passed without phase shift, scaled to [0, 1]."""
    return band_pass(low, high, fs)(A.col(signal))


def filtered_or_scaled(signal: str, low: float | None, high: float | None, fs: float) -> Column:
    return A.min_max(signal, 1e-10) if low is None or high is None else filtered(signal, low, high, fs)


def derivatives(signal: str) -> dict[str, Column]:
    return {name: A.padded_diff(signal, k) for k, name in enumerate(("vpg", "apg", "ppg3", "ppg4"), 1)}


def smoothed_derivative(signal: str) -> Column:
    """Weighted sum of 7 samples; beyond the ends the samples are mirrored."""
    n = F.size(signal)
    mirrored = lambda i: F.when(i < 0, -i).when(i > n - 1, 2 * (n - 1) - i).otherwise(i)
    return F.transform(signal, lambda _, i: sum((w * A.at(signal, mirrored(i + k - 3)) for k, w in enumerate(SMOOTH) if w), F.lit(0.0)) / 252)


def without_baseline(df: DataFrame, signal: str, vlys: str) -> DataFrame:
    """Subtracts a cubic spline through the valleys, less the mean valley. Adds ``baseline``; needs two valleys (else null).

    Before and after the valleys the spline goes on through knots at the median
    distance with the median valley value, to beyond both ends.
    """
    values = A.pick(signal, vlys)
    dist = A.median(F.transform(A.diff(vlys), lambda x: x.cast("double")))
    first, last = A.at(vlys, 0), F.element_at(F.col(vlys), -1)
    before, after = F.ceil(first / dist).cast("int"), F.ceil((F.size(signal) - last) / dist).cast("int")
    none = F.array().cast("array<int>")
    df = df.withColumns({"_dist": F.when(F.size(vlys) > 1, dist), "_before": before, "_after": after, "_med": A.median(values), "_values": values})
    head = F.transform(F.when(F.col("_before") > 0, F.sequence(F.col("_before"), F.lit(1), F.lit(-1))).otherwise(none), lambda i: first - i * F.col("_dist"))
    tail = F.transform(F.when(F.col("_after") > 0, F.sequence(F.lit(1), F.col("_after"))).otherwise(none), lambda i: last + i * F.col("_dist"))
    knots = F.concat(head, F.transform(vlys, lambda v: v.cast("double")), tail)
    heights = F.concat(F.transform(head, lambda _: F.col("_med")), F.col("_values"), F.transform(tail, lambda _: F.col("_med")))
    ready = F.col("_dist").isNotNull()
    df = df.withColumns({"_knots": F.when(ready, knots), "_heights": F.when(ready, heights)})
    df = df.withColumn("baseline", spline_baseline("_knots", "_heights", F.size(signal)))
    level = A.mean("_values")
    flat = F.zip_with(signal, "baseline", lambda x, b: x - (b - level))
    return df.withColumn(signal, flat).drop("_dist", "_before", "_after", "_med", "_values", "_knots", "_heights")


def channels(*signals: str | Column | float, like: str) -> Column:
    """A list of channels, each an array; a number becomes a constant channel as long as ``like``."""
    return F.array(*[F.array_repeat(F.lit(float(s)), F.size(like)) if isinstance(s, int | float) else A.col(s) for s in signals])


def with_pressure(df: DataFrame, signal: str = "signal", abp: str = "abp_signal") -> DataFrame:
    """A missing pressure channel becomes a copy of the pulse."""
    return df.withColumn(abp, F.coalesce(abp, signal) if abp in df.columns else F.col(signal))
