"""Readers, exports and the whole job on small synthetic recordings."""

import numpy as np
import pytest

from pulsejobs.functions import arrays as A
from pulsejobs.operators import extrema
from pulsejobs.operators.segment import WindowSpec, aligned
from pulsejobs.plans import process
from pulsejobs.sources import files


def test_column_csv_and_tab_lines(spark, tmp_path):
    (tmp_path / "pats").mkdir()
    (tmp_path / "pats/pat7pred.csv").write_text("PPG,reBAP\n1.5,0.9\n2.5,nan\n3,1.25\n")
    r = files.read_column_csv(spark, f"{tmp_path}/pats/*.csv", {"PPG": "signal", "reBAP": "abp_signal"}).first()
    assert r.id == 7 and r.signal == [1.5, 2.5, 3.0] and r.abp_signal[0] == 0.9
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/12_3.txt").write_text("10\t20\t30.5\t")
    r = files.read_tab_lines(spark, f"{tmp_path}/txt/*.txt").first()
    assert (r.patient, r.trial, r.signal) == (12, "12_3", [10.0, 20.0, 30.5])


def test_fold_export_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 1 / 3, 1)], "patient int, f double, fold int")
    files.write_folds(df, f"{tmp_path}/folds")
    assert files.round_trip_differences(df, f"{tmp_path}/folds").count() == 0
    files.export_folds_csv(df, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, inferSchema=True)
    assert sorted(r.f for r in back.collect()) == [0.1, 1 / 3]


def plain_maxima(x):
    return [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1]]


def test_beats_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 40).tolist()) for i in range(60)] + [(99, [1.0, 2.0, 1.0])]

    def plain(x):
        p, v = plain_maxima(x), plain_maxima([-t for t in x])
        if not p or not v:
            return True, True, [], []
        if p[0] < v[0]:
            p = p[1:]
        else:
            v = v[1:]
        if not p or not v:
            return True, True, [], []
        if p[-1] > v[-1]:
            p = p[:-1]
        else:
            v = v[:-1]
        p = [i for i in p if v and v[0] <= i <= v[-1]]
        if not p or not v:
            return True, True, [], []
        base = np.mean([x[i] for i in v])
        h = [x[i] - base for i in p]
        start = 0 if len(p) == 1 else next((i for i in range(len(p) - 1) if h[i] > h[i + 1] * 0.6), None)
        if start is None:
            return True, True, [], []
        took = [start]
        for i in range(start + 1, len(p)):
            if h[i] > h[took[-1]] * 0.6:
                took.append(i)
        new = [p[i] for i in took]
        ordered = len(v) - 1 == len(new) and all(a < b < c for a, b, c in zip(v, new, v[1:], strict=False))
        return new != p, not ordered, new, v

    df = spark.createDataFrame(rows, "id int, s array<double>").withColumns({"pks": A.maxima("s"), "vlys": A.minima("s")})
    for r in extrema.beats(df, "s", "pks", "vlys").collect():
        assert (r.flag1, r.flag2, r.pks, r.vlys) == plain(r.s), r.id


def waves(seconds, rate=1.2, fs=125, lag=0, seed=0):
    t = (np.arange(seconds * fs) - lag) / fs
    x = np.sin(2 * np.pi * rate * t) + 0.3 * np.sin(4 * np.pi * rate * t + 0.6) + np.random.default_rng(seed).normal(0, 0.002, len(t))
    return x


def test_alignment_finds_a_planted_lag(spark):
    df = spark.createDataFrame([(waves(8, lag=30).tolist(), waves(8).tolist())], "signal array<double>, abp_signal array<double>")
    exact = aligned(df, 125, "exact").first()
    assert np.corrcoef(exact.signal, exact.abp_signal)[0, 1] > 0.99
    assert len(exact.signal) == 7 * 125


def test_whole_job(spark, tmp_path):
    rows = [(f"r{i}", f"p{i % 4}", "Part_1", 125, (waves(22, 1.1 + i / 20, seed=i) * 0.5).tolist(), (100 + 30 * waves(22, 1.1 + i / 20, seed=i + 50)).tolist()) for i in range(8)]
    records = spark.createDataFrame(rows, "record string, patient string, part string, fs int, signal array<double>, abp_signal array<double>")
    c = process.CleanConfig(window=WindowSpec.of(125, win_sec=5), align=False, skew_over=-9)
    windows = process.segmented(records, c)
    assert windows.count() == 32
    clean, audits = process.cleaned(windows, c, f"{tmp_path}/steps")
    assert clean.count() > 0 and len(audits) == 10
    with pytest.raises(ValueError):
        process.run(spark, records, str(tmp_path), c, None, None)
