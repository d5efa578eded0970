"""One job from pressure windows to mean cycles with landmarks, of one length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extrema, mabp, splits
from ..sources import files

OUT = ["patient", "trial", "SP", "DP", "signal", "abp_signal", "class_limits"]


def with_cycles(windows: DataFrame, fs: int) -> DataFrame:
    """Adds the cycles ``cs`` of the pressure wave and the two flags; first and last extrema count."""
    df = windows.withColumns({"_pks": extrema.find_peaks("abp_signal", fs), "_vlys": extrema.find_valleys("abp_signal", fs)})
    df = extrema.beats(df, "abp_signal", "_pks", "_vlys", remove_ends=False)
    return df.withColumn("cs", extrema.cycles("abp_signal", "_vlys")).drop("_pks", "_vlys")


def mean_pressure(with_cycles: DataFrame, limit: int = mabp.LIMIT, width: float = mabp.WIDTH) -> DataFrame:
    """The windows with ``abp_signal`` replaced by their trimmed mean cycle, wrapped to limit + 15 samples, and ``class_limits``.

    Windows are told apart by (patient, trial), which must be theirs alone.
    Those without a cycle go, and those whose mean cycle is too short for a
    peak. Only samples of cycles are shuffled; the window's other columns come
    back by a join.
    """
    keys = ["patient", "trial"]
    rows = mabp.samples(with_cycles.select(*keys, mabp.clipped("cs", limit).alias("cs")), keys, "cs")
    mean = mabp.mean_cycles(mabp.trimmed_mean(rows, keys, width), keys)
    found = mabp.landmarks(mean).where("sys_peak IS NOT NULL AND dia_notch IS NOT NULL")
    found = found.select(*keys, mabp.wrapped("mean", limit + mabp.ADDED).alias("abp_signal"), "class_limits")
    return with_cycles.drop("abp_signal", "class_limits").join(found, keys).select(*OUT)


def run(windows: DataFrame, out: str, fs: int = 125, parts: tuple[list[str], list[str], list[str]] | None = None, seed: int = 0) -> dict[str, str]:
    """Writes ``cycles``, ``flags`` (one row of counts and shares), ``mean`` and, with parts (train, val, test), ``folds``; returns the paths."""
    spark, path = windows.sparkSession, {n: f"{out}/{n}" for n in ("cycles", "flags", "mean", "folds")}
    files.write_windows(with_cycles(windows, fs), path["cycles"])
    held = spark.read.parquet(path["cycles"])
    files.write_windows(mabp.flag_shares(held), path["flags"])
    files.write_windows(mean_pressure(held), path["mean"])
    if parts:
        files.write_folds(splits.hold_out(spark.read.parquet(path["mean"]), *parts, seed=seed), path["folds"])
    return path
