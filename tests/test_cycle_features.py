"""The 97 features of a cycle against plain loops, and the order of all 218 columns."""

import math

import numpy as np
from pyspark.sql import functions as F

from pulsejobs.operators import features
from tests.test_points import cycles_of_all_kinds, expected

FS = 125.0


def over(x, y):
    """A quotient as the cleaning of features leaves it: infinite is 0, undefined is missing."""
    return x / y if y else 0.0 if x else None


def area(x):
    return sum((a + b) / 2 for a, b in zip(x, x[1:], strict=False))


def plain_features(cycle, peak, points):
    w, y, z, a, b, c, d, e = points
    n = len(cycle)
    v = [q - p for p, q in zip(cycle, cycle[1:], strict=False)]
    acc = [q - p for p, q in zip(v, v[1:], strict=False)]
    out = {"Tc": n / FS, "Steepest": v[w], "NegSteepest": v[y], "DiaRise": cycle[z], "SteepDiaRise": v[z], "Ratio": over(cycle[peak], cycle[z])}
    for name, t in (("Ts", peak), ("Td", n - peak), ("Tsteepest", w), ("TNegSteepest", y), ("TdiaRise", z), ("TSystoDiaRise", z - peak), ("TdiaToEnd", n - z)):
        out |= {name: t / FS, f"{name}_norm": t / n}
    for share in (25, 50, 75):
        height = cycle[peak] * (share / 100)
        i = 0
        while i < peak and cycle[i] < height:
            i += 1
        left, j = peak - i, peak
        while j < n and cycle[j] > height:
            j += 1
        right = j - 1 - peak
        for name, t in (("SW", left), ("DW", right), ("SWaddDW", left + right)):
            out |= {f"{name}{share}": t / FS, f"{name}{share}_norm": t / n}
        out[f"DWdivSW{share}"] = over(right, left)
    low = [x - min(cycle) for x in cycle]
    s = [area(low[:w]), area(low[w:peak]), area(low[peak:z]), area(low[z:])]
    both = [s[0] + s[1], s[2] + s[3]]
    out |= {f"S{k + 1}": x for k, x in enumerate(s)} | {f"S{k + 1}_norm": over(x, both[k // 2]) for k, x in enumerate(s)}
    for name, x in zip(("AUCsys", "AUCdia"), both, strict=True):
        out |= {name: x, f"{name}_norm": over(x, sum(both))}
    mean = sum(cycle) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in cycle) / n)
    score = [(x - mean) / (sd + 1e-6) for x in cycle]
    flat = sum(abs(t) < 1e-5 for t in v) / n
    out |= {"SQI_skew": 0.0 if flat > 0.3 else sum(t**3 for t in score) / n, "SQI_kurtosis": 1 / (sum(t**4 for t in score) / (n + 1e-6) + 1e-6)}
    last = None
    for name, k in zip("abcde", (a, b, c, d, e), strict=True):
        t, p = (k if last is None else k - last), (peak - k if name in "ab" else k - peak)
        out |= {f"apg_{name}": acc[k], f"ppg_{name}": cycle[k + 2], f"T_{name}": t / FS, f"T_{name}_norm": t / n, f"T_peak_{name}": p / FS, f"T_peak_{name}_norm": p / n}
        if name != "a":
            out |= {f"ratio_apg_{name}": over(acc[k], acc[a]), f"ratio_ppg_{name}": over(cycle[k + 2], cycle[a + 2])}
        last = k
    return out | {
        "AI": over(acc[b] - acc[c] - acc[d] - acc[e], acc[a]), "bcda": over(acc[b] - acc[c] - acc[d], acc[a]), "bd": over(v[d + 1] - v[b + 1], d - b),
        "sdoo": over(sum(x * x for x in v[peak : d + 1]), sum(x * x for x in v)),
    }


def test_all_features_of_cycles(spark):
    every = [(i, c.tolist(), k) for i, (c, k) in enumerate(cycles_of_all_kinds()[:700])]
    df = spark.createDataFrame([(i, [c], [k]) for i, c, k in every], "trial int, cs array<array<double>>, ks array<int>")
    rows = features.cycle_features(features.cycle_rows(df, ["trial"], "cs", "ks"), FS)
    names = rows.columns[5:]
    assert len(names) == 97
    found = {r.trial: r for r in rows.collect()}
    zeros, whole = 0, 0
    for i, cycle, peak in every:
        points = expected(np.array(cycle), peak)
        assert (points is None) == (i not in found)
        if points is None:
            continue
        want = plain_features(cycle, peak, points)
        assert set(want) == set(names)
        zeros, whole = zeros + (points[4] == 0), whole + (points[4] > 0)
        for n in names:
            x, y = found[i][n], want[n]
            # a flat cycle has scores of 0 over 0 by rounding
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7)), (i, n, x, y)
    assert whole > 200 and zeros > 50


def test_means_over_the_cycles_of_a_window(spark):
    rows = [(1, 0, 1.0, 2.0), (1, 1, 3.0, None), (2, 0, None, 5.0), (2, 1, None, 7.0)]
    out = features.mean_over_cycles(spark.createDataFrame(rows, "trial int, cyc int, f double, g double"), ["trial"]).orderBy("trial").collect()
    assert [tuple(r) for r in out] == [(1, 2.0, None), (2, None, 6.0)]


def test_order_of_the_columns(spark):
    """The names that a feature table has, in its order."""
    waves = ("ppg", "vpg", "apg", "ppg3", "ppg4")
    window = ["ppg_fft_peaks_0", "ppg_fft_peaks_heights_0", "ppg_fft_peaks_neighbor_avgs_0", "hr_0", "p2p_0"]
    for w in waves:
        window += [f"{w}_max_neighbor_mean_0", f"{w}_min_0"]
    for w in waves:
        window += [f"{w}_histogram_up_{i}" for i in range(5)] + [f"{w}_histogram_down_{i}" for i in range(10)] + [f"{w}_max_0"]
    window += [f"usdc_{i}" for i in range(6)] + [f"dsdc_{i}" for i in range(19)] + ["ppg_mean_cycles_match_peak_59"]
    assert features.window_template() == window and len(window) == 121
    cycle = "Tc Ts Td Tsteepest Steepest TNegSteepest NegSteepest TdiaRise DiaRise SteepDiaRise TSystoDiaRise TdiaToEnd Ratio Ts_norm Td_norm Tsteepest_norm TNegSteepest_norm TdiaRise_norm TSystoDiaRise_norm TdiaToEnd_norm".split()
    for p in (25, 50, 75):
        cycle += [f"SW{p}", f"SW{p}_norm", f"DW{p}", f"DW{p}_norm", f"SWaddDW{p}", f"SWaddDW{p}_norm", f"DWdivSW{p}"]
    cycle += "S1 S2 S3 S4 AUCsys AUCdia S1_norm S2_norm S3_norm S4_norm AUCsys_norm AUCdia_norm SQI_skew SQI_kurtosis".split()
    for prefix, suffix, points in (("apg_", "", "abcde"), ("ppg_", "", "abcde"), ("ratio_apg_", "", "bcde"), ("ratio_ppg_", "", "bcde"), ("T_", "", "abcde"), ("T_", "_norm", "abcde"), ("T_peak_", "", "abcde"), ("T_peak_", "_norm", "abcde")):
        cycle += [f"{prefix}{k}{suffix}" for k in points]
    cycle += ["AI", "bd", "bcda", "sdoo"]
    rows = spark.createDataFrame([], "trial int, cyc int, cycle array<double>, peak int, p struct<w:int,y:int,z:int,a:int,b:int,c:int,d:int,e:int>")
    assert features.cycle_features(rows, FS).columns[5:] == cycle and len(cycle) == 97
    df = spark.createDataFrame([], ", ".join(f"{n} double" for n in [*reversed(cycle), *window, "other"]))
    assert features.allowed(df, [*window, *cycle]).columns == [*window, *cycle]
    assert df.select(F.count("*")).first()[0] == 0
