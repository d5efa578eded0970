"""Records to fixed windows: cutting, trimming, scaling, ids, order, resampling, alignment. One row a record in, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.vec import align_shift, block_lag_sums, fourier_resampled, linear_map, resample_each


@dataclass(frozen=True)
class WindowSpec:
    """Window and stride in samples, from seconds or samples."""

    size: int
    stride: int

    @classmethod
    def of(cls, fs: int, win_sec: float | None = None, win_sam: int | None = None, wait_sec: float = 0.0) -> WindowSpec:
        """Seconds win over samples; the stride is the waiting time, at least the window."""
        if win_sec is None and win_sam is None:
            raise ValueError("give the window in seconds (win_sec) or samples (win_sam)")
        size = int(win_sec * fs) if win_sec is not None else int(win_sam)
        if size < 1:
            raise ValueError("a window needs a sample at least")
        return cls(size, max(int(wait_sec * fs), size))


def windows(records: DataFrame, spec: WindowSpec, channels: list[str], record: str = "patient") -> DataFrame:
    """One row a window: all other columns, j, trial = record_j, the channels cut to [j*stride, j*stride+size).

    int(length / stride) windows, the rest of the record is dropped; with a
    stride over the size there is a gap after each window.
    """
    n = F.floor(F.size(channels[0]) / spec.stride).cast("int")
    out = records.withColumn("j", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    out = out.withColumns({c: A.cut(c, F.col("j") * spec.stride, F.col("j") * spec.stride + spec.size) for c in channels})
    out = out.where(F.size(channels[0]) == spec.size)
    return out.withColumn("trial", F.concat_ws("_", F.col(record).cast("string"), F.col("j").cast("string")))


def placed(samples: DataFrame, record: str, bucket: Column, order: list[str]) -> DataFrame:
    """Adds idx, the place of a sample in its record, and len, the record's length, without one task for a whole record.

    ``bucket`` is a coarse part of the order, such as the day; ranks are taken
    inside a bucket, after the counted samples of the record's earlier ones.
    """
    rows = samples.withColumn("_b", bucket)
    in_record = Window.partitionBy(record)
    counts = rows.groupBy(record, "_b").agg(F.count("*").alias("_c"))
    counts = counts.withColumns({"_before": F.sum("_c").over(in_record.orderBy("_b")) - F.col("_c"), "len": F.sum("_c").over(in_record)}).drop("_c")
    rank = F.row_number().over(Window.partitionBy(record, "_b").orderBy(*order)) - 1
    held = counts.withColumnsRenamed({record: "_r", "_b": "_rb"})
    same = F.col(record).eqNullSafe(F.col("_r")) & F.col("_b").eqNullSafe(F.col("_rb"))
    return rows.withColumn("_rank", rank).join(held, same).withColumn("idx", F.col("_rank") + F.col("_before")).drop("_r", "_b", "_rb", "_rank", "_before")


def windows_of_samples(samples: DataFrame, spec: WindowSpec, channels: list[str], record: str = "patient") -> DataFrame:
    """windows() for records too long for one row: from rows (record, channel, idx, x, len), one for a sample of a channel.

    Rows are grouped by window, so a long record is as many small groups.
    Windows that lack samples of the first channel go.
    """
    j = F.floor(F.col("idx") / spec.stride).cast("int")
    held = samples.withColumn("j", j).where((F.col("j") < F.floor(F.col("len") / spec.stride)) & (F.col("idx") % spec.stride < spec.size))
    wave = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct("idx", "x")))), lambda r: r["x"])
    out = held.groupBy(record, "j").agg(*[wave(c).alias(c) for c in channels]).where(F.size(channels[0]) == spec.size)
    return out.withColumn("trial", F.concat_ws("_", F.col(record).cast("string"), F.col("j").cast("string")))


def centre_window(records: DataFrame, size: int, channels: list[str]) -> DataFrame:
    """One window from the middle of each record; shorter records go."""
    start = F.floor((F.size(channels[0]) - size) / 2)
    return records.where(F.size(channels[0]) >= size).withColumns({c: A.cut(c, start, start + size) for c in channels})


def centre_of_samples(samples: DataFrame, size: int) -> DataFrame:
    """centre_window() for sample rows (idx, len, ...): the rows of the middle window, idx counted from its start; no shuffle."""
    start = F.floor((F.col("len") - size) / 2)
    held = samples.where((F.col("len") >= size) & (F.col("idx") >= start) & (F.col("idx") < start + size))
    return held.withColumns({"idx": F.col("idx") - start, "len": F.lit(size).cast("long")})


def trimmed_samples(samples: DataFrame, last: int, both: int) -> DataFrame:
    """trimmed() for sample rows (idx, len, ...): those that stay, idx counted from the first of them; no shuffle."""
    held = samples.where((F.col("idx") >= both) & (F.col("idx") < F.col("len") - last - both))
    return held.withColumns({"idx": F.col("idx") - both, "len": F.col("len") - last - 2 * both})


def trimmed(a: str | Column, last: int, both: int) -> Column:
    """The samples without the last ``last``, then without ``both`` at either end."""
    n = F.size(A.col(a)) - last
    return A.cut(a, both, n - both)


def scaled(a: str | Column, factor: float) -> Column:
    return F.transform(A.col(a), lambda x: x * factor)


def in_listed_order(records: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """Records that are named in a list, with the places that they have there.

    ``listed`` has a row for each name: pos, name. The rows come in no order of
    their own; ``pos`` orders them, also where a table is written sorted.
    """
    held = listed.select("pos", F.trim("name").alias("_listed"))
    return records.join(held, F.col(name) == F.col("_listed")).drop("_listed")


def resample_matrix(n: int, m: int) -> np.ndarray:
    """(m, n): Fourier resampling as a linear map."""
    return fourier_resampled(np.eye(n), m).T


def at_rate(c: str, old: float, new: float) -> Column:
    """A recording of n samples at another rate: round(n / old * new) samples, halves to even, by its Fourier coefficients; null for null, empty for empty."""
    n = F.bround(F.size(c) / F.lit(float(old)) * F.lit(float(new))).cast("int")
    return F.when(F.size(c) > 0, F.get(resample_each(F.array(F.coalesce(F.col(c), F.array(F.lit(0.0)))), F.greatest(n, F.lit(1))), F.lit(0))).otherwise(F.col(c))


def resampled(df: DataFrame, c: str, n: int, m: int) -> DataFrame:
    """Windows of n samples at a new length m, one matrix product a batch."""
    return df.withColumn(c, linear_map(resample_matrix(n, m))(F.col(c)))


def aligned(records: DataFrame, fs: int, lag_mode: str = "literal") -> DataFrame:
    """Shift ``signal`` against ``abp_signal`` by the lag, within a second, that maximises their product sum.

    Both come out one second shorter. ``exact`` cuts at the best lag; ``literal``
    cuts where counting full-correlation indices from the truncated length
    lands, one sample later for whole seconds (kept so that results compare).
    Adds ``shift`` (samples, 0 or negative).
    """
    size = F.floor(F.size("signal") / fs).cast("int") * fs
    out = records.withColumn("_n", size).where(F.col("_n") > fs)
    best = align_shift(fs)(F.col("abp_signal"), F.col("signal"), F.col("_n"))
    out = out.withColumn("shift", best - F.col("_n"))
    start = -F.col("shift")
    if lag_mode == "exact":
        start = F.size("signal") - 1 - best
    elif lag_mode != "literal":
        raise ValueError("lag_mode is literal or exact")
    keep = F.col("_n") - fs
    return out.withColumns({"signal": A.cut("signal", start, start + keep), "abp_signal": A.cut("abp_signal", 0, keep)}).drop("_n")


def aligned_samples(samples: DataFrame, fs: int, record: str = "patient", block: int = 4096, lag_mode: str = "literal") -> DataFrame:
    """aligned() for records too long for one row: rows (record, channel, idx, x, len) in and out, with ``shift`` and the new len.

    The product sums of the lags are taken in blocks of ``block`` samples of
    abp_signal, each with the samples of signal that its lags reach (two
    seconds more), and added up by record and lag; so a record of any length
    is as many small groups, and one row for each lag remains of it. Lags whose
    sums differ by rounding only count as equal: the first of the full
    correlation wins. Null and NaN samples count as 0 in the sums; records of
    up to a second go, as do those without a name.
    """
    if lag_mode not in ("literal", "exact"):
        raise ValueError("lag_mode is literal or exact")
    if block < 2 * fs:
        raise ValueError("a block holds two seconds at least")
    whole = F.floor(F.col("len") / fs) * fs
    rows = samples.withColumn("_n", whole).where(F.col("_n") > fs)
    of, at = F.floor(F.col("idx") / block), F.col("idx") % block
    is_abp = F.col("channel") == "abp_signal"
    blocks = F.when(is_abp | (at >= 2 * fs) | (of == 0), F.array(of)).otherwise(F.array(of - 1, of))
    value = F.when(F.isnan("x"), F.lit(0.0)).otherwise(F.coalesce("x", F.lit(0.0)))
    dealt = rows.where(F.col("channel").isin("signal", "abp_signal")).select(record, is_abp.alias("_abp"), "len", "_n", "idx", value.alias("x"), F.explode(blocks).alias("_b"))
    place = (F.col("idx") - F.col("_b") * block).cast("int")
    lists = lambda c: F.collect_list(F.when(c, F.struct(place.alias("i"), "x")))
    grouped = dealt.groupBy(record, "_n", "len", "_b").agg(lists(F.col("_abp")).alias("_a"), lists(~F.col("_abp")).alias("_p"))
    sums = block_lag_sums(fs, block)(F.col("_a.i"), F.col("_a.x"), F.col("_p.i"), F.col("_p.x"), F.col("len") - F.col("_n"))
    parts = grouped.select(record, "_n", "len", F.posexplode(sums).alias("_lag", "_v")).groupBy(record, "_n", "len", "_lag").agg(F.sum("_v").alias("_v"))
    in_record = Window.partitionBy(record)  # a row for each lag, and two for the sums of squares
    room = 1e-12 * F.sqrt(F.max(F.when(F.col("_lag") == fs, F.col("_v"))).over(in_record) * F.max(F.when(F.col("_lag") == fs + 1, F.col("_v"))).over(in_record))
    top = F.max(F.when(F.col("_lag") < fs, F.col("_v"))).over(in_record)
    best = parts.withColumns({"_top": top, "_room": room}).where((F.col("_lag") < fs) & (F.col("_v") >= F.col("_top") - F.col("_room"))).groupBy(record, "_n", "len").agg(F.max("_lag").alias("_lag"))
    start = F.col("_lag") + 1 if lag_mode == "literal" else F.col("len") - F.col("_n") + F.col("_lag")
    best = best.select(F.col(record).alias("_r"), (-1 - F.col("_lag")).alias("shift"), start.alias("_start"), (F.col("_n") - fs).alias("_keep"))
    moved = samples.join(best, F.col(record) == F.col("_r")).withColumns({"idx": F.when(F.col("channel") == "signal", F.col("idx") - F.col("_start")).otherwise(F.col("idx")), "len": F.col("_keep")})
    return moved.where((F.col("idx") >= 0) & (F.col("idx") < F.col("_keep"))).drop("_r", "_start", "_keep")
