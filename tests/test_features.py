"""Window features and filters against loops written from their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsejobs.functions import arrays as A
from pulsejobs.functions import vec
from pulsejobs.operators import features, signals

N = 240


def peaks_of(x):
    return [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1]]


def bin_of(x, k):
    return sum(v * complex(math.cos(2 * math.pi * k * i / len(x)), -math.sin(2 * math.pi * k * i / len(x))) for i, v in enumerate(x))


def resampled(x, m):
    """Samples of the trigonometric sum with the bins that both lengths have."""
    n, k = len(x), min(len(x), m)
    bins = {f: bin_of(x, f) for f in range(-((k - 1) // 2), (k - 1) // 2 + 1)}
    if k % 2 == 0:
        half = k // 2
        if m < n:  # both sides fold onto one bin
            bins[half] = bin_of(x, half) + bin_of(x, -half)
        elif m > n:  # the one bin is shared by both sides
            bins[half] = bins[-half] = bin_of(x, half) / 2
        else:
            bins[half] = bin_of(x, half)
    return [sum((c * complex(math.cos(2 * math.pi * f * j / m), math.sin(2 * math.pi * f * j / m))).real for f, c in bins.items()) / n for j in range(m)]


def plain_cycles(x, pks, match):
    gaps = [b - a for a, b in zip(pks, pks[1:], strict=False)]
    if not gaps:
        return []
    o, out = round(float(np.median(gaps))), []
    for p in pks[1:-1]:
        if match == "sys_peak":
            s, e = round(p - o * 0.25), round(p + o * 0.75)
        else:
            s, m, e = round(p - o * 0.35), int(p + o * 0.65), round(p + o * 0.85)
            if not (0 <= s < p and m < e and m < len(x)):
                continue
            s = min(range(s, p), key=lambda i: x[i])
            e = min(range(m, min(e, len(x))), key=lambda i: x[i])
        if 0 <= s < e <= len(x):
            out.append(list(x[s:e]))
    return out


def normed(cycle):
    y = resampled(cycle, 80)
    return [(v - min(y)) / (max(y) - min(y) + 1e-6) for v in y]


def curve(y):
    last, rise = len(y) - 1, y[-1] - y[0]
    return [(v * rise * i - v * last + y[0] * last) / math.hypot(rise, last) for i, v in enumerate(y)]


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(11), []
    for i in range(24):
        t = np.arange(N)
        out.append((i, (np.sin(2 * np.pi * t / (34 + i % 7)) + 0.4 * np.sin(4 * np.pi * t / (34 + i % 7) + 1) + rng.normal(0, 0.01, N)).tolist()))
    return out


@pytest.fixture(scope="module")
def found(spark, rows):
    df = spark.createDataFrame(rows, "id int, ppg array<double>").withColumn("pks", F.transform(F.filter(A.maxima("ppg"), lambda i: A.at("ppg", i) > 0.8), lambda i: i.cast("int")))
    df = features.spectrum_peaks(df, "ppg", distance=3, around=4)
    for k in ("sys_peak", "dia_notches"):
        df = df.withColumn(k, features.aligned_cycles("ppg", ["ppg"], "pks", k)["ppg"])
    df = df.withColumn("normed", features.normed_cycles(F.col("dia_notches"))).withColumn("median", features.median_cycle("normed"))
    return features.slope_deviation(df, "normed").collect()


def test_spectrum_peaks(found):
    seen = 0
    for r in found:
        m = [abs(bin_of(r.ppg, k)) for k in range(1, (N + 1) // 2)]
        s = [v / math.sqrt(sum(w * w for w in m)) for v in m]
        kept = []
        for i in sorted(peaks_of(s[: len(s) // 6]), key=lambda i: -s[i]):
            if all(abs(i - j) >= 3 for j in kept):
                kept.append(i)
        kept = sorted(i for i in kept if i > 3)[:5]
        assert r.ppg_fft_peaks == kept
        assert np.allclose(r.ppg_fft_peaks_heights, [s[i] for i in kept])
        assert np.allclose(r.ppg_fft_peaks_neighbor_avgs, [np.mean(s[max(i - 4, 0) : i + 4]) for i in kept])
        seen += len(kept)
    assert seen > 24


def test_aligned_and_median_cycles(found):
    for r in found:
        for k in ("sys_peak", "dia_notches"):
            assert r[k] == plain_cycles(r.ppg, r.pks, k), (r.id, k)
        each = [normed(c) for c in r.dia_notches]
        assert np.allclose(r.normed, each, atol=1e-9)
        assert np.allclose(r.median, np.median(each, axis=0), atol=1e-9)
    assert sum(len(r.dia_notches) for r in found) > 24


def test_slope_deviation(found):
    for r in found:
        up, down = [], []
        for c in r.normed:
            top = max(range(80), key=lambda i: c[i])
            u, d = curve(resampled(c[: top + 1], 20)), curve(resampled(c[top:], 60))
            up.append([np.mean(u[i : i + 3]) for i in range(0, 17, 3)])
            down.append([np.mean(d[i : i + 3]) for i in range(0, 57, 3)])
        assert len(r.usdc) == 6 and len(r.dsdc) == 19
        assert np.allclose(r.usdc, np.mean(up, axis=0), atol=1e-8) and np.allclose(r.dsdc, np.mean(down, axis=0), atol=1e-8)


def test_band_pass_against_a_recursion():
    """One sample after the other, with the steady state found by running a constant in for long."""
    n, low, high, fs = 120, 0.5, 8.0, 125.0
    x = np.random.default_rng(2).normal(size=n)
    # poles and zeros of the analog band-pass, carried over by the bilinear transform
    w = [2 * fs * math.tan(math.pi * f / fs) for f in (low, high)]
    poles = np.roots([1, w[1] - w[0], w[0] * w[1]])
    a = np.poly([(2 * fs + p) / (2 * fs - p) for p in poles]).real
    b = np.array([1.0, 0.0, -1.0])
    mid = np.exp(1j * 2 * math.atan(math.sqrt(w[0] * w[1]) / (2 * fs)))
    b /= abs(np.polyval(b, mid) / np.polyval(a, mid))  # the gain is 1 in the middle of the band

    def once(s):
        y, run = [], [s[0]] * 6000 + list(s)
        for i, v in enumerate(run):
            past = lambda q, k, i=i: q[i - k] if i >= k else 0.0
            y.append(b[0] * v + b[1] * past(run, 1) + b[2] * past(run, 2) - a[1] * past(y, 1) - a[2] * past(y, 2))
        return y[6000:]

    held = np.concatenate([2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]])
    plain = once(once(list(held))[::-1])[::-1][9:-9]
    assert np.allclose(vec.band_pass_matrix(n, low, high, fs) @ x, plain, atol=1e-6)


def test_baseline_is_a_spline_through_the_valleys(spark):
    x = [math.sin(i / 3) + 0.01 * i for i in range(100)]
    vlys = [i for i in range(1, 99) if x[i - 1] > x[i] < x[i + 1]]
    r = signals.without_baseline(spark.createDataFrame([(x, vlys), (x, [5])], "s array<double>, v array<int>"), "s", "v").collect()
    gap, mid = float(np.median(np.diff(vlys))), float(np.median([x[i] for i in vlys]))
    knots, k = {float(i): x[i] for i in vlys}, 1
    while (k - 1) * gap < vlys[0]:
        knots[vlys[0] - k * gap] = mid
        k += 1
    k = 1
    while (k - 1) * gap < 100 - vlys[-1]:
        knots[vlys[-1] + k * gap] = mid
        k += 1
    at = np.array(sorted(knots))
    # a cubic on each stretch: equal values, slopes and bends at inner knots, equal third derivatives beside the outer ones
    n, rows, right = len(at) - 1, [], []
    for j in range(n):
        h = at[j + 1] - at[j]
        cell = lambda v, j=j: [v[i - 4 * j] if 4 * j <= i < 4 * j + 4 else 0.0 for i in range(4 * n)]
        rows += [cell([1, 0, 0, 0]), cell([1, h, h**2, h**3])]
        right += [knots[at[j]], knots[at[j + 1]]]
        if j + 1 < n:
            pair = lambda v, w, j=j: [v[i - 4 * j] if 4 * j <= i < 4 * j + 4 else w[i - 4 * j - 4] if 4 * j + 4 <= i < 4 * j + 8 else 0.0 for i in range(4 * n)]
            rows += [pair([0, 1, 2 * h, 3 * h**2], [0, -1, 0, 0]), pair([0, 0, 2, 6 * h], [0, 0, -2, 0])]
            right += [0.0, 0.0]
            if j in (0, n - 2):
                rows.append(pair([0, 0, 0, 1], [0, 0, 0, -1]))
                right.append(0.0)
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(n, 4)
    base = [sum(c[j][q] * (i - at[j]) ** q for q in range(4)) for i in range(100) for j in [max(0, min(int(np.searchsorted(at, i, "right")) - 1, n - 1))]]
    level = np.mean([x[i] for i in vlys])
    assert np.allclose(r[0].baseline, base, atol=1e-7)
    assert np.allclose(r[0].s, [v - (w - level) for v, w in zip(x, base, strict=True)], atol=1e-7)
    assert r[1].baseline is None


def test_window_features_query_hands_on_spectra_and_mean_cycle(spark):
    from pulsejobs.catalog import QUERIES

    data = "/root/testdata/sf0.001"
    rows = QUERIES["fea_window_features"](spark, data).collect()
    names = ("peaks", "peaks_heights", "peaks_neighbor_avgs")
    at = lambda r, w, i: tuple(r[f"{w}_fft_{n}_{i}"] for n in names)
    want = {(r.trial, r.i): (r.ppg_fft_peaks, pytest.approx(r.ppg_fft_peaks_heights, abs=2e-6), pytest.approx(r.ppg_fft_peaks_neighbor_avgs, abs=2e-6)) for r in QUERIES["fea1_spectrum_peaks"](spark, data).collect()}
    assert want and {(r.trial, i): at(r, "ppg", i) for r in rows for i in range(5) if at(r, "ppg", i)[0] is not None} == want
    assert all(any(at(r, w, 0)[0] is not None for r in rows) for w in features.WAVES)
    whole = [r for r in rows if not r.no_cycle]
    assert whole
    for r in whole:
        mean = [r[f"ppg_mean_cycles_match_peak_{i}"] for i in range(features.MEAN_LENGTH)]
        assert mean[r.ppg_min] == pytest.approx(min(mean), abs=2e-6)
