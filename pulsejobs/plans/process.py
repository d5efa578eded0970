"""One job a data set: records to clean windows, windows to features, features to folds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, extrema, features, joins, quality, segment, signals, splits
from ..sources import files


@dataclass(frozen=True)
class CleanConfig:
    """Parameters of the cleaning of windows."""

    fs: int = 125
    window: segment.WindowSpec = field(default_factory=lambda: segment.WindowSpec.of(125, win_sec=5))
    align: bool = True
    low: float | None = 0.5
    high: float | None = 8.0
    rate: tuple[float, float] = (35, 140)
    skew_over: float = 0.0


def segmented(records: DataFrame, c: CleanConfig) -> DataFrame:
    """Aligned records cut into windows, duplicates gone."""
    rows = segment.aligned(records, c.fs) if c.align else records
    cut = segment.windows(rows, c.window, ["signal", "abp_signal"], "record")
    return dedupe.drop_duplicate_windows(cut, ["record", "j"])


def with_extrema(df: DataFrame, wave: str, prefix: str, fs: int, remove_ends: bool = True) -> DataFrame:
    found = df.withColumns({f"{prefix}_pks": extrema.find_peaks(wave, fs), f"{prefix}_vlys": extrema.find_valleys(wave, fs)})
    out = extrema.beats(found, wave, f"{prefix}_pks", f"{prefix}_vlys", remove_ends=remove_ends)
    return out.withColumnsRenamed({"flag1": f"{prefix}_f1", "flag2": f"{prefix}_f2"})


def written(df: DataFrame, audit: quality.Audit, path: str) -> tuple[DataFrame, list[DataFrame]]:
    """The clean windows, written once and read again, and the audit of the rules on the way, a table a step."""
    files.write_windows(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), audit.tables(df.sparkSession)


def cleaned(windows: DataFrame, c: CleanConfig, path: str) -> tuple[DataFrame, list[DataFrame]]:
    """Clean labelled windows with extrema, cycles and statistics, and the audit tables of the rules, in order.

    All of it stays in the window's row and in one pass: no shuffle, and one
    write, of the clean windows under ``path``; the audit counts rows as they
    pass. Between two steps the plan cannot be merged, so extrema are computed
    once and expressions stay short.
    """
    audit, df = quality.Audit(), windows.withColumns(quality.naive_labels())
    step = audit.step
    df = step(df, "pressure", quality.pressure_rules())
    df = with_extrema(df, "abp_signal", "abp", c.fs, remove_ends=False)
    df = df.withColumn("abp_vlys", F.when(F.col("abp_f2") & (F.size("abp_pks") > 0), extrema.valleys_before_peaks("abp_pks", "abp_vlys")).otherwise(F.col("abp_vlys")))
    df = step(df, "abp beats", quality.beat_count_rules("abp_pks", "abp_vlys"))
    df = df.withColumns(quality.interval_stats("abp_pks", c.fs, "abp_p2p", "pks_bpm") | quality.interval_stats("abp_vlys", c.fs, "abp_v2v", "vlys_bpm"))
    df = step(df, "abp rate", quality.rate_rules(*c.rate))
    df = df.withColumns(extrema.pressure_from_wave("abp_signal", "abp_pks", "abp_vlys") | {"p2v": quality.peak_to_valley("abp_signal", "abp_pks", "abp_vlys")})
    df = step(df, "pulse pressure", quality.pulse_rules()).drop("pks_bpm", "vlys_bpm")
    df = df.withColumn("fsignal", signals.filtered_or_scaled("signal", c.low, c.high, c.fs))
    df = df.withColumns({"pks": extrema.find_peaks("fsignal", c.fs), "vlys": extrema.find_valleys("fsignal", c.fs)})
    df = step(df, "few extrema", quality.enough_extrema_rule())
    df = ppg_stats(df, c.fs)
    df = step(df, "ppg rate", quality.rate_rules(*c.rate))
    df = step(df, "distorted", quality.distortion_rules())
    df = signals.without_baseline(df, "signal", "vlys")
    df = df.withColumn("fsignal", signals.filtered_or_scaled("signal", c.low, c.high, c.fs))
    df = df.withColumns({"pks": extrema.find_peaks("fsignal", c.fs), "vlys": extrema.find_valleys("fsignal", c.fs)})
    df = extrema.beats(df, "fsignal", "pks", "vlys")
    df = step(df, "no cycles", {"cycles": (F.size("pks") > 0) & ~F.col("flag2")})
    df = ppg_stats(df, c.fs)
    df = step(df, "refined rate", quality.rate_rules(*c.rate))
    df = step(df, "refined distorted", quality.distortion_rules(first=False))
    return written(df.withColumns({"cs": extrema.cycles("fsignal", "vlys"), "pks_norm": extrema.peaks_in_cycles("pks", "vlys")}), audit, path)


def cleaned_short(windows: DataFrame, c: CleanConfig, path: str, denied: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Cleaning of labelled recordings of a beat or two (patient, trial, SP, DP, signal), without a pressure wave.

    Pressure limits, beats, baseline, beats again, rates: a window of one beat
    has no peak rate and stays, one without a valley rate goes. First and last
    extrema count, as there are few. ``denied`` (one column, trial) names
    windows that were seen to be bad; null trials are no match and stay. As
    in cleaned(), one pass and one write; the denied windows go after the
    last rule.
    """
    audit = quality.Audit()
    step = audit.step

    def with_beats(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("fsignal", signals.filtered_or_scaled("signal", c.low, c.high, c.fs))
        df = df.withColumns({"pks": extrema.find_peaks("fsignal", c.fs), "vlys": extrema.find_valleys("fsignal", c.fs)})
        return step(extrema.beats(df, "fsignal", "pks", "vlys", remove_ends=False), name, {"cycles": (F.size("pks") >= 1) & (F.size("vlys") >= 2) & ~F.col("flag2")})

    df = step(windows, "pressure", quality.pressure_rules())
    df = with_beats(df, "no cycles")
    df = signals.without_baseline(df, "signal", "vlys")
    df = ppg_stats(with_beats(df, "no cycles refined"), c.fs)
    df = step(df, "rate", quality.rate_rules(*c.rate, keep_single=True))
    if denied is not None:
        df = joins.without(df, denied, ["trial"])
    return written(df.withColumns({"cs": extrema.cycles("fsignal", "vlys"), "pks_norm": extrema.peaks_in_cycles("pks", "vlys")}), audit, path)


def ppg_stats(df: DataFrame, fs: int) -> DataFrame:
    return df.withColumns(
        quality.interval_stats("pks", fs, "p2p", "pks_bpm") | quality.interval_stats("vlys", fs, "v2v", "vlys_bpm") | quality.amplitude_stats("signal", "pks", "pks") | quality.amplitude_stats("signal", "vlys", "vlys")
    )


def featured(clean: DataFrame, c: CleanConfig, keys: tuple[str, ...] = ("patient", "trial")) -> DataFrame:
    """Ids, labels and the 218 features of the template, those of the window before those of its cycles.

    Windows without a usable cycle go, by the rules of cleaning. No
    array takes part in the join of the two families.
    """
    k = list(keys)
    waves = signals.derivatives("signal")
    held = clean.select(*k, "SP", "DP", "signal", "pks", F.col("fsignal").alias("ppg"), *[v.alias(n) for n, v in waves.items()])
    held = held.withColumns({n: signals.filtered(n, 0.75, 10, c.fs) for n in waves})
    window = features.window_features(held, c.fs).drop("signal", "pks", *features.WAVES)
    window = features.spread(window, features.template_lists()).withColumnsRenamed({x: f"{x}_0" for x in features.SINGLE})
    cycle = features.mean_over_cycles(features.cycle_features(features.cycle_rows(clean, k, "cs", "pks_norm"), c.fs), k)
    names = [*features.window_template(), *[x for x in cycle.columns if x not in k]]
    both = features.allowed(window.where("NOT no_cycle").join(cycle, k), [*k, "SP", "DP", *names])
    both = both.withColumns({n: F.col(n).cast("double") for n in names})
    return quality.clean_features(both, names).where(F.col("SQI_skew") > c.skew_over)


def run(spark: SparkSession, records: DataFrame, out: str, c: CleanConfig, feature_folds: int | None, signal_folds: int | None, seed: int = 0) -> dict[str, str]:
    """Runs all stages, each written as a Parquet table under ``out``; returns the paths.

    Without ``feature_folds`` or ``signal_folds`` that output is skipped;
    without both there is nothing to do, which is an error.
    """
    if not feature_folds and not signal_folds:
        raise ValueError("give a split of features or of signals")
    path = {n: f"{out}/{n}" for n in ("segmented", "cleaned", "audit", "features", "feature_folds", "signal_folds")}
    files.write_windows(segmented(records, c), path["segmented"])
    clean, audits = cleaned(spark.read.parquet(path["segmented"]), c, path["cleaned"])
    files.append_audit(reduce(DataFrame.union, audits), path["audit"])
    files.write_windows(featured(clean, c), path["features"])
    rows = spark.read.parquet(path["features"])
    if feature_folds:
        files.write_folds(splits.with_folds(rows, feature_folds, seed), path["feature_folds"])
    if signal_folds:
        kept = joins.keep_in_step(clean.select("patient", "trial", "SP", "DP", "signal", "abp_signal"), rows)
        files.write_folds(splits.with_folds(kept, signal_folds, seed), path["signal_folds"])
    return path
