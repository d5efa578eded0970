"""Features of windows and of their cycles. Positions come from small kernels; all features are Spark expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.points import cycle_points
from ..functions.vec import median_normed, median_of_each, resample_each, slope_curves, spectrum
from . import quality

WAVES = ("ppg", "vpg", "apg", "ppg3", "ppg4")
UP, DOWN, MEAN_LENGTH = 5, 10, 80
POINTS = ("a", "b", "c", "d", "e")


def _safe(x: Column, y: Column | int) -> Column:
    """x / y; an infinite quotient is 0 and 0 / 0 missing, as the cleaning of features would have it."""
    y = F.lit(y) if isinstance(y, int | float) else y
    return F.when(y != 0, x / y).when(x != 0, 0.0)


# ------------------------------------------------------------------ spectrum


def spaced_maxima(a: str | Column, distance: int) -> Column:
    """Local maxima at least ``distance`` apart: the highest stay, later ones of equals first."""
    a = A.col(a)
    order = F.array_sort(F.transform(A.maxima(a), lambda i: F.struct((-A.at(a, i)).alias("h"), (-i).alias("i"))))
    kept = F.aggregate(order, F.array().cast("array<int>"), lambda s, x: F.when(F.exists(s, lambda j: F.abs(j + x["i"]) < distance), s).otherwise(F.array_append(s, (-x["i"]).cast("int"))))
    return F.array_sort(kept)


def spectrum_peaks(df: DataFrame, wave: str, distance: int = 28, first: int = 5, around: int = 6, held: str | None = None) -> DataFrame:
    """Adds {wave}_fft_peaks, _fft_peaks_heights and _fft_peaks_neighbor_avgs: maxima in the first sixth of the spectrum beyond ``distance``. ``held`` is a column that has the spectrum already."""
    df = df.withColumn("_s", F.col(held) if held else spectrum(wave))
    places = F.slice(F.filter(spaced_maxima(A.cut("_s", 0, F.floor(F.size("_s") / 6)), distance), lambda i: i > distance), 1, first)
    df = df.withColumn(f"{wave}_fft_peaks", places)
    return df.withColumns({f"{wave}_fft_peaks_heights": A.pick("_s", f"{wave}_fft_peaks"), f"{wave}_fft_peaks_neighbor_avgs": F.transform(f"{wave}_fft_peaks", lambda i: A.mean(A.cut("_s", i - around, i + around)))}).drop("_s")


# ------------------------------------------------------------------ aligned cycles


def beat_distance(pks: str) -> Column:
    return A.median(F.transform(A.diff(pks), lambda x: x.cast("double")))


def aligned_cycles(ppg: str, waves: list[str], pks: str, match: str, remove_first: bool = True) -> Column:
    """struct(wave -> list of cycles) cut around each peak p, o being the rounded median beat distance.

    ``sys_peak``: from p - o/4 to p + 3o/4. ``dia_notches``: from the lowest
    pulse sample in [p - 0.35 o, p) to the lowest in [p + 0.65 o, p + 0.85 o).
    Cycles that reach out of the window go. Halves are rounded to even.
    """
    used = A.cut(pks, 1, F.size(pks) - 1) if remove_first else F.filter(pks, lambda p: (p > 0) & (p < F.size(ppg) - 1))
    whole = lambda x: F.bround(x).cast("int")

    def bounds(o: Column) -> Column:
        if match == "sys_peak":
            return F.transform(used, lambda p: F.struct(whole(p - o * 0.25).alias("s"), whole(p + o * 0.75).alias("e")))
        raw = F.transform(used, lambda p: F.struct(p.alias("p"), whole(p - o * 0.35).alias("s"), F.floor(p + o * 0.65).cast("int").alias("m"), whole(p + o * 0.85).alias("e")))
        raw = F.filter(raw, lambda r: (r["s"] >= 0) & (r["s"] < r["p"]) & (r["m"] < r["e"]) & (r["m"] < F.size(ppg)))
        low = lambda lo, hi: lo + A.argmin(F.slice(ppg, lo + 1, F.least(hi, F.size(ppg)) - lo))
        return F.transform(raw, lambda r: F.struct(low(r["s"], r["p"]).alias("s"), low(r["m"], r["e"]).alias("e")))

    def cuts(b: Column, wave: str) -> Column:
        return F.transform(b, lambda x: F.slice(wave, x["s"] + 1, x["e"] - x["s"]))

    def inside(b: Column) -> Column:
        return F.filter(b, lambda x: (x["s"] >= 0) & (x["e"] <= F.size(ppg)) & (x["s"] < x["e"]))

    # the distance is computed once, outside all other lambdas
    found = A.let(F.coalesce(F.bround(beat_distance(pks)), F.lit(0.0)), lambda o: inside(bounds(o)))
    return A.kept(A.let(found, lambda b: F.struct(*[cuts(b, w).alias(w) for w in waves])))


def normed_cycles(cycles: Column, length: int = MEAN_LENGTH) -> Column:
    """Each cycle at ``length`` samples, scaled to [0, 1]."""
    return F.transform(resample_each(cycles, F.lit(length)), lambda c: A.min_max(c, 1e-6))


def median_cycle(cycles: str | Column, raw: bool = False) -> Column:
    """Median over the cycles, position by position; null without a cycle. ``raw`` cycles are resampled and scaled by the same kernel."""
    return (median_normed(MEAN_LENGTH) if raw else median_of_each)(A.col(cycles))


def mean_near_max(a: str, around: int = 5) -> Column:
    """Mean of the samples up to ``around`` before and fewer than ``around`` after the largest."""
    at = A.argmax(a)
    return A.mean(A.cut(a, at - around, at + around))


def density(a: str | Column, bins: int) -> Column:
    """Histogram on [0, 1] as densities: counts / (samples inside * bin width). No sample inside: null in every bin."""
    at = F.transform(F.filter(A.col(a), lambda x: (x >= 0) & (x <= 1)), lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)))
    share = lambda v: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.try_divide(F.size(F.filter(v, lambda x: x == b)) * F.lit(float(bins)), F.size(v)))
    return A.let(at, share)


def slope_deviation(df: DataFrame, cycles: str, length: int = MEAN_LENGTH, raw: bool = False) -> DataFrame:
    """Adds usdc (6 values: rise up to the largest sample, at length/4) and dsdc (19: fall from it, at 3 length/4), means over the cycles.

    ``raw`` cycles are brought to ``length`` samples in [0, 1] by the same kernel.
    """
    return df.withColumn("_curves", slope_curves(length, raw)(F.col(cycles))).withColumns({c: F.get("_curves", F.lit(i)) for i, c in enumerate(("usdc", "dsdc"))}).drop("_curves")


def window_features(df: DataFrame, fs: float, pks: str = "pks", waves: tuple[str, ...] = WAVES, distance: int = 28, around: int = 6) -> DataFrame:
    """Spectrum, rate, aligned-cycle, histogram and slope features of the five waves (columns named as in WAVES); lists stay lists.

    A window without an aligned cycle keeps its row, with missing features and
    ``no_cycle`` true. ``distance`` and ``around`` are those of spectrum_peaks():
    windows of fewer than 373 samples have no peak beyond the usual distance.
    """
    df = df.withColumn("p2p", beat_distance(pks)).withColumn("hr", F.try_divide(F.lit(60.0 * fs), F.col("p2p")))
    df = df.withColumns({"_peak": aligned_cycles(waves[0], list(waves), pks, "sys_peak"), "_notch": aligned_cycles(waves[0], list(waves), pks, "dia_notches")})
    df = df.withColumn("no_cycle", F.coalesce((F.size(F.col("_peak")[waves[0]]) == 0) | (F.size(F.col("_notch")[waves[0]]) == 0), F.lit(True)))
    # all kernels side by side: one worker a task has them all
    shape = median_normed(MEAN_LENGTH)
    medians = {f"_m{k}_{w}": shape(F.col(f"_{k}")[w]) for k in ("peak", "notch") for w in waves}
    df = df.withColumns({f"_s_{w}": spectrum(w) for w in waves} | medians | {"_curves": slope_curves(MEAN_LENGTH, True)(F.col("_notch")[waves[0]])})
    for w in waves:
        df = spectrum_peaks(df, w, distance, around=around, held=f"_s_{w}")
    top = A.argmax(f"_mnotch_{waves[0]}")
    new = {f"{waves[0]}_mean_cycles_match_peak": F.col(f"_mpeak_{waves[0]}")}
    for w in waves:
        new |= {
            f"{w}_max_neighbor_mean": mean_near_max(f"_mpeak_{w}"),
            f"{w}_min": A.argmin(f"_mpeak_{w}"),
            f"{w}_max": A.argmax(f"_mnotch_{w}"),
            f"{w}_histogram_up": density(A.cut(f"_mnotch_{w}", 0, top), UP),
            f"{w}_histogram_down": density(A.cut(f"_mnotch_{w}", top, MEAN_LENGTH), DOWN),
        }
    df = df.withColumns(new | {c: F.get("_curves", F.lit(i)) for i, c in enumerate(("usdc", "dsdc"))})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def spread(df: DataFrame, lists: dict[str, int]) -> DataFrame:
    """List features to scalar columns name_0, name_1, ...; short lists give null."""
    return df.withColumns({f"{c}_{i}": F.get(c, F.lit(i)) for c, n in lists.items() for i in range(n)}).drop(*lists)


def allowed(df: DataFrame, template: list[str]) -> DataFrame:
    """The columns of a template that exist, in its order."""
    return df.select(*[c for c in template if c in df.columns])


#: Columns of window_features() that hold one value; as features they carry the place 0 of a list.
SINGLE = ("hr", "p2p", *[f"{w}_{x}" for w in WAVES for x in ("max_neighbor_mean", "min", "max")])
#: The one sample of the mean cycle that is a feature.
MEAN_SAMPLE = 59


def window_template() -> list[str]:
    """The 121 window features that a feature table holds, in its order."""
    spectrum_of = [f"{WAVES[0]}_fft_{x}_0" for x in ("peaks", "peaks_heights", "peaks_neighbor_avgs")]
    levels = [f"{w}_{x}_0" for w in WAVES for x in ("max_neighbor_mean", "min")]
    shapes = []
    for w in WAVES:
        shapes += [f"{w}_histogram_{x}_{i}" for x, n in (("up", UP), ("down", DOWN)) for i in range(n)] + [f"{w}_max_0"]
    slopes = [f"{x}_{i}" for x, n in (("usdc", 6), ("dsdc", 19)) for i in range(n)]
    return [*spectrum_of, "hr_0", "p2p_0", *levels, *shapes, *slopes, f"{WAVES[0]}_mean_cycles_match_peak_{MEAN_SAMPLE}"]


def template_lists() -> dict[str, int]:
    """List columns of window_features() and how many of their values are spread."""
    few = {f"{w}_fft_{x}": 1 for w in WAVES for x in ("peaks", "peaks_heights", "peaks_neighbor_avgs")}
    bins = {f"{w}_histogram_{x}": n for w in WAVES for x, n in (("up", UP), ("down", DOWN))}
    return few | bins | {"usdc": 6, "dsdc": 19, f"{WAVES[0]}_mean_cycles_match_peak": MEAN_LENGTH}


# ------------------------------------------------------------------ features of one cycle


def durations(cycle: Column, peak: Column, p: Column, fs: float, v: Column | None = None) -> dict[str, Column]:
    """Times, slopes and ratio; ``v`` are the differences of the cycle where a column has them already."""
    v = A.diff(cycle) if v is None else v
    n = F.size(cycle)
    out = {
        "Tc": n / fs,
        "Ts": peak / fs,
        "Td": (n - peak) / fs,
        "Tsteepest": p["w"] / fs,
        "Steepest": A.at(v, p["w"]),
        "TNegSteepest": p["y"] / fs,
        "NegSteepest": A.at(v, p["y"]),
        "TdiaRise": p["z"] / fs,
        "DiaRise": A.at(cycle, p["z"]),
        "SteepDiaRise": A.at(v, p["z"]),
        "TSystoDiaRise": (p["z"] - peak) / fs,
        "TdiaToEnd": (n - p["z"]) / fs,
        "Ratio": _safe(A.at(cycle, peak), A.at(cycle, p["z"])),
    }
    whole = {"Ts": peak, "Td": n - peak, "Tsteepest": p["w"], "TNegSteepest": p["y"], "TdiaRise": p["z"], "TSystoDiaRise": p["z"] - peak, "TdiaToEnd": n - p["z"]}
    return out | {f"{k}_norm": x / n for k, x in whole.items()}


def widths(cycle: Column, peak: Column, fs: float, shares: tuple[int, ...] = (25, 50, 75)) -> dict[str, Column]:
    """Widths left and right of the peak at a share of its height: up to the first sample that reaches it, and to the last before one at or below it."""
    n, out = F.size(cycle), {}
    for s in shares:
        h = A.at(cycle, peak) * (s / 100)
        left = peak - F.least(F.coalesce(A.first_where(cycle, lambda x, _, h=h: x >= h), peak), peak)
        right = F.coalesce(A.first_where(cycle, lambda x, i, h=h: (i >= peak) & (x <= h)), n) - 1 - peak
        out |= {f"SW{s}": left / fs, f"SW{s}_norm": left / n, f"DW{s}": right / fs, f"DW{s}_norm": right / n, f"SWaddDW{s}": (left + right) / fs, f"SWaddDW{s}_norm": (left + right) / n, f"DWdivSW{s}": _safe(right, left)}
    return out


def areas(cycle: Column, peak: Column, p: Column) -> dict[str, Column]:
    """Areas over the lowest sample up to w, w to peak, peak to z, z to the end; of systole and diastole; and shares."""
    low = F.array_min(cycle)
    over = F.transform(cycle, lambda x: x - low)
    s = [A.trapezoid(A.cut(over, *b)) for b in ((0, p["w"]), (p["w"], peak), (peak, p["z"]), (p["z"], F.size(cycle)))]
    sys, dia = s[0] + s[1], s[2] + s[3]
    out = {f"S{i + 1}": x for i, x in enumerate(s)} | {"AUCsys": sys, "AUCdia": dia}
    return out | {f"S{i + 1}_norm": _safe(x, sys if i < 2 else dia) for i, x in enumerate(s)} | {"AUCsys_norm": _safe(sys, sys + dia), "AUCdia_norm": _safe(dia, sys + dia)}


def acceleration_features(cycle: Column, peak: Column, p: Column, fs: float, v: Column | None = None, q: Column | None = None) -> dict[str, Column]:
    """Heights at a to e, their ratios to a, times between them and to the peak, and the indices AI, bd, bcda, sdoo.

    ``v`` and ``q`` are the first and second differences where columns have them already.
    """
    v = A.diff(cycle) if v is None else v
    q = A.diff(v) if q is None else q
    n = F.size(cycle)
    at = {k: A.at(q, p[k]) for k in POINTS}
    height = {k: A.at(cycle, p[k] + 2) for k in POINTS}
    out = {f"apg_{k}": at[k] for k in POINTS} | {f"ppg_{k}": height[k] for k in POINTS}
    out |= {f"ratio_apg_{k}": _safe(at[k], at["a"]) for k in POINTS[1:]} | {f"ratio_ppg_{k}": _safe(height[k], height["a"]) for k in POINTS[1:]}
    steps = {k: p[k] - p[POINTS[i - 1]] if i else p["a"] for i, k in enumerate(POINTS)}
    to_peak = {k: peak - p[k] if k in "ab" else p[k] - peak for k in POINTS}
    for name, times in (("T_", steps), ("T_peak_", to_peak)):
        out |= {f"{name}{k}": x / fs for k, x in times.items()} | {f"{name}{k}_norm": x / n for k, x in times.items()}
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return out | {
        "AI": _safe(at["b"] - at["c"] - at["d"] - at["e"], at["a"]),
        "bd": _safe(A.at(v, p["d"] + 1) - A.at(v, p["b"] + 1), p["d"] - p["b"]),
        "bcda": _safe(at["b"] - at["c"] - at["d"], at["a"]),
        "sdoo": _safe(squares(A.cut(v, peak, p["d"] + 1)), squares(v)),
    }


def cycle_rows(df: DataFrame, keys: list[str], cycles: str, peaks: str) -> DataFrame:
    """One row a cycle: keys, cyc, cycle, peak and its points p; cycles without points go."""
    found = df.select(*keys, F.posexplode(F.arrays_zip(F.col(cycles).alias("c"), F.col(peaks).alias("k"), cycle_points(cycles, peaks).alias("p"))).alias("cyc", "z"))
    return found.select(*keys, "cyc", F.col("z.c").alias("cycle"), F.col("z.k").alias("peak"), F.col("z.p").alias("p")).where("p IS NOT NULL AND peak IS NOT NULL")


def cycle_features(rows: DataFrame, fs: float) -> DataFrame:
    """cycle_rows() and the 97 features of each cycle; they stay in their row.

    The differences, which most features share, are bound to columns first, so
    that they are computed once and the plan stays small.
    """
    c, k, p, v, q = F.col("cycle"), F.col("peak"), F.col("p"), F.col("_v"), F.col("_q")
    held = rows.withColumn("_v", A.diff("cycle")).withColumn("_q", A.diff("_v"))
    new = durations(c, k, p, fs, v) | widths(c, k, fs) | areas(c, k, p) | {"SQI_skew": A.skewness("cycle"), "SQI_kurtosis": quality.kurtosis_index("cycle")} | acceleration_features(c, k, p, fs, v, q)
    return held.withColumns(new).drop("_v", "_q")


def mean_over_cycles(features: DataFrame, keys: list[str]) -> DataFrame:
    """One row a window: the mean of every feature over its cycles, null if it is missing in one of them."""
    names = [f.name for f in features.schema if f.name not in (*keys, "cyc", "cycle", "peak", "p")]
    return features.groupBy(*keys).agg(*[F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in names])
