"""Peaks, valleys and cycles of windows, as arrays of sample indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.vec import multi_scale_maxima


def find_peaks(signal: str | Column, scale: int, strip_ends: bool = True) -> Column:
    """Multi-scale peaks; an index 0 or len - 1 does not count."""
    a = A.col(signal)
    found = multi_scale_maxima(scale)(a)
    return F.filter(found, lambda i: (i > 0) & (i < F.size(a) - 1)) if strip_ends else found


def find_valleys(signal: str | Column, scale: int, strip_ends: bool = True) -> Column:
    a = A.col(signal)
    found = multi_scale_maxima(scale, -1)(a)
    return F.filter(found, lambda i: (i > 0) & (i < F.size(a) - 1)) if strip_ends else found


def beats(df: DataFrame, signal: str, pks: str, vlys: str, th: float = 0.6, remove_ends: bool = True) -> DataFrame:
    """Peaks between valleys: replaces ``pks`` and ``vlys``, adds flag1 (low peaks dropped) and flag2 (not valley-peak-valley...).

    With ``remove_ends`` the first of all extrema goes, and the last. Then peaks
    before the first and after the last valley go. From the left, the first
    peak over ``th`` times its successor (over the mean valley) is accepted,
    then each peak over ``th`` times the last accepted one. Windows without
    peaks or valleys, and windows in which no first peak is found, get empty
    lists and both flags.
    """
    peaks, valleys = F.col(pks), F.col(vlys)
    some = (F.size(peaks) > 0) & (F.size(valleys) > 0)
    if remove_ends:
        peak_first, peak_last = A.at(peaks, 0) < A.at(valleys, 0), F.element_at(peaks, -1) > F.element_at(valleys, -1)
        drop_first = lambda a, c: F.when(c, A.cut(a, 1, F.size(a))).otherwise(a)
        drop_last = lambda a, c: F.when(c, A.cut(a, 0, F.size(a) - 1)).otherwise(a)
        df = df.withColumns({"_p": F.when(some, drop_first(peaks, peak_first)), "_v": F.when(some, drop_first(valleys, ~peak_first))})
        both = (F.size("_p") > 0) & (F.size("_v") > 0)
        peak_last = F.element_at(F.col("_p"), -1) > F.element_at(F.col("_v"), -1)
        df = df.withColumns({"_p2": F.when(both, drop_last(F.col("_p"), peak_last)), "_v2": F.when(both, drop_last(F.col("_v"), ~peak_last))})
    else:
        df = df.withColumns({"_p": peaks, "_v": valleys, "_p2": F.when(some, peaks), "_v2": F.when(some, valleys)})
    # peaks outside the valleys go; without valleys there is nothing to compare with
    inside = F.filter("_p2", lambda p: (p >= A.at("_v2", 0)) & (p <= F.element_at(F.col("_v2"), -1)))
    df = df.withColumn("_p3", F.when(F.size("_v2") > 0, inside))
    base = A.mean(A.pick(signal, "_v2"))
    df = df.withColumn("_h", F.transform("_p3", lambda p: A.at(signal, p) - base))
    n = F.size("_p3")
    first = F.when(n == 1, F.lit(0)).otherwise(A.first_where("_h", lambda h, i: (i < n - 1) & (h > A.at("_h", i + 1) * th)))
    df = df.withColumn("_first", F.when(n > 0, first))
    state = F.struct(F.array(F.col("_first")).alias("keep"), A.at("_h", F.col("_first")).alias("last"))
    rest = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i > F.col("_first"))
    taken = F.aggregate(
        rest,
        state,
        lambda s, i: F.when(A.at("_h", i) > s["last"] * th, F.struct(F.array_append(s["keep"], i).alias("keep"), A.at("_h", i).alias("last"))).otherwise(s),
    )["keep"]
    df = df.withColumn("_new", F.when(F.col("_first").isNotNull(), A.pick("_p3", taken)))
    good = F.col("_new").isNotNull()
    none = F.array().cast("array<int>")
    m = F.size("_v2")
    between = F.forall(F.transform("_new", lambda p, i: (A.at("_v2", i) < p) & (p < A.at("_v2", i + 1))), lambda x: x)
    out = df.withColumns(
        {
            "flag1": F.when(good, F.col("_new") != F.col("_p3")).otherwise(True),
            "flag2": F.when(good, (m - 1 != F.size("_new")) | ~F.coalesce(between, F.lit(False))).otherwise(True),
            pks: F.when(good, F.col("_new")).otherwise(none),
            vlys: F.when(good, F.col("_v2")).otherwise(none),
        }
    )
    return out.drop("_p", "_v", "_p2", "_v2", "_p3", "_h", "_first", "_new")


def valleys_before_peaks(pks: str, vlys: str) -> Column:
    """For each peak the last valley before it, each once, and the last valley of all: an as-of match inside the row."""
    before = F.transform(pks, lambda p: F.array_max(F.filter(vlys, lambda v: v < p)))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(before, F.array(F.element_at(F.col(vlys), -1))))))


def cycles(signal: str, vlys: str) -> Column:
    """The samples between consecutive valleys, one array a cycle."""
    n = F.size(vlys)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: A.cut(signal, A.at(vlys, i), A.at(vlys, i + 1)))).otherwise(F.array().cast("array<array<double>>"))


def peaks_in_cycles(pks: str, vlys: str) -> Column:
    """Each peak counted from the valley that opens its cycle; empty unless there is a peak for each cycle."""
    return F.when(F.size(vlys) - 1 == F.size(pks), F.transform(pks, lambda p, i: p - A.at(vlys, i))).otherwise(F.array().cast("array<int>"))


def pressure_from_wave(signal: str, pks: str, vlys: str) -> dict[str, Column]:
    """SP: median of the values at peaks, DP: at valleys; -1 without any."""
    return {"SP": F.coalesce(A.median(A.pick(signal, pks)), F.lit(-1.0)), "DP": F.coalesce(A.median(A.pick(signal, vlys)), F.lit(-1.0))}


def mask(signal: str, indices: str) -> Column:
    """True at the given indices; all false for null lists."""
    return F.transform(signal, lambda _, i: F.coalesce(F.array_contains(indices, i), F.lit(False)))
