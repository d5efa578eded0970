"""Whole jobs to their last table, model searches, and the smaller readers."""

import numpy as np
import pytest

from pulsejobs.functions import vec
from pulsejobs.operators import features, models
from pulsejobs.operators.segment import WindowSpec
from pulsejobs.plans import pressure, process
from pulsejobs.sources import files

RECORD = "record string, patient string, part string, fs int, signal array<double>, abp_signal array<double>"


def pulse(seconds, rate, seed, fs=125):
    """Beats with a steep rise and a second wave, which show a notch."""
    at = (np.arange(int(seconds * fs)) / fs * rate) % 1
    x = np.exp(-(((at - 0.25) / 0.09) ** 2)) + 0.45 * np.exp(-(((at - 0.6) / 0.12) ** 2))
    return x + np.random.default_rng(seed).normal(0, 1e-3, len(x))


def test_feature_job_to_the_end(spark, tmp_path):
    rows = [(f"p{i}_r", f"p{i}", "Part_1", 125, pulse(16, 1.1 + i / 20, i).tolist(), (80 + 40 * pulse(16, 1.1 + i / 20, i + 50)).tolist()) for i in range(4)]
    c = process.CleanConfig(window=WindowSpec.of(125, win_sec=5), skew_over=-9)
    path = process.run(spark, spark.createDataFrame(rows, RECORD), str(tmp_path), c, 2, 2)
    found = spark.read.parquet(path["features"])
    assert found.count() > 0
    assert found.columns[:4] == ["patient", "trial", "SP", "DP"]
    assert len(found.columns) == 4 + 218 and found.columns[4:125] == features.window_template() and found.columns[-4:] == ["AI", "bd", "bcda", "sdoo"]
    assert {f.dataType.typeName() for f in found.schema[4:]} == {"double"}
    r = found.first()
    assert 60 < r.hr_0 < 85 and 0 < r.ppg_max_0 < 80 and abs(r.Ts + r.Td - r.Tc) < 1e-9
    keys = lambda df: sorted((x.patient, x.trial) for x in df.select("patient", "trial").collect())
    folds = spark.read.parquet(path["feature_folds"])
    assert keys(folds) == keys(spark.read.parquet(path["signal_folds"])) == keys(found)
    assert folds.groupBy("patient").agg({"fold": "max"}).count() == folds.select("patient", "fold").distinct().count()


def test_short_recordings(spark, tmp_path):
    t = np.arange(260) / 125
    wave = lambda rate: (np.cos(2 * np.pi * rate * (t - 0.15)) * -1.0).tolist()  # noqa: E731 -- a valley 0.15 s in
    rows = [("p1", "1_1", 120.0, 80.0, wave(0.7)), ("p2", "2_1", 120.0, 80.0, wave(1.3)), ("p3", "3_1", 240.0, 80.0, wave(1.3)), ("p4", "4_1", 120.0, 80.0, [1.0] * 260), ("p5", "203_3", 120.0, 80.0, wave(1.3)), ("p6", "6_1", 120.0, 80.0, wave(3.0))]
    windows = spark.createDataFrame(rows, "patient string, trial string, SP double, DP double, signal array<double>")
    denied = spark.createDataFrame([("203_3",)], "trial string")
    clean, audits = process.cleaned_short(windows, process.CleanConfig(), str(tmp_path), denied)
    kept = {r.trial: r for r in clean.collect()}
    assert set(kept) == {"1_1", "2_1"}
    assert kept["1_1"].pks_bpm is None and len(kept["1_1"].pks) == 1 and abs(kept["1_1"].vlys_bpm - 42) < 3
    assert all(len(r.cs) == len(r.pks_norm) == len(r.pks) for r in kept.values())
    removed = {(a.step, a.rule): a.removed for t in audits for a in t.collect()}
    assert removed == {("pressure", "sp_high"): 1, ("pressure", "dp_low"): 0, ("pressure", "pulse_low"): 0, ("no cycles", "cycles"): 1, ("no cycles refined", "cycles"): 0, ("rate", "peak_rate"): 1, ("rate", "valley_rate"): 1}


def test_pressure_job(spark, tmp_path):
    wave = lambda i: (80 + 40 * pulse(6, 1.0 + i / 10, i)).tolist()
    rows = [(f"Part_{1 + i % 4}_{i}", f"Part_{1 + i % 4}_{i}_0", 120.0, 80.0, [0.0, 1.0], wave(i)) for i in range(8)] + [("Part_1_9", "Part_1_9_0", 1.0, 1.0, [0.0], [5.0] * 750)]
    windows = spark.createDataFrame(rows, "patient string, trial string, SP double, DP double, signal array<double>, abp_signal array<double>")
    path = pressure.run(windows, str(tmp_path), 125, (["Part_1", "Part_2"], ["Part_3"], ["Part_4"]))
    flags = spark.read.parquet(path["flags"]).first()
    assert flags.nocy == 1 and abs(flags.nocy_pct - 100 / 9) < 1e-9
    mean = {r.trial: r for r in spark.read.parquet(path["mean"]).collect()}
    held = {r.trial: [c[:149] for c in r.cs] for r in spark.read.parquet(path["cycles"]).collect()}
    assert len(mean) == 8
    for t, r in mean.items():
        n = max(map(len, held[t]))
        at = [np.array([c[i] for c in held[t] if len(c) > i]) for i in range(n)]
        plain = [x[np.abs(x - x.mean()) <= 1.25 * x.std() * (1 + 1e-9) + 1e-12].mean() for x in at]
        assert np.allclose(r.abp_signal, [plain[i % n] for i in range(164)])
        peak, notch, end, long = r.class_limits
        assert peak == int(np.argmax(plain[: int(n * 0.45)])) and peak < notch < n and (end, long) == (n, n + 15)
    folds = {r.trial: r.fold for r in spark.read.parquet(path["folds"]).collect()}
    assert folds == {t: {"4": 0, "3": 1}.get(t.split("_")[1], 2) for t in mean}


def test_search_and_prediction_log(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, f"{i}_0", float(x), float(100 + 40 * x), i % 3) for i, x in enumerate(rng.random(60))]
    folded = spark.createDataFrame(rows, "patient int, trial string, f double, SP double, fold int")
    found = models.search(folded, 3, "SP", ["f"], "rf", {"maxDepth": [1, 4], "numTrees": [3], "seed": [1]})
    assert [p["maxDepth"] for _, p in found] == [4, 1] and found[0][0] < found[1][0]
    table = models.cross_validated(folded, 3, "SP", ["f"], "rf", maxDepth=4, numTrees=3, seed=1)
    errors = files.write_predictions(table, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log/rows").count() == table.count() == 180
    pooled = {r["mode"]: r.mae for r in errors.where("fold IS NULL").collect()}
    assert set(pooled) == {m + x for m in ("", "naive ") for x in ("tr", "val", "ts")} and pooled["ts"] < pooled["naive ts"]
    test = [(r.pred - r.label) for r in table.where("mode = 'ts'").collect()]
    assert abs(pooled["ts"] - np.mean(np.abs(test))) < 1e-3
    with pytest.raises(ValueError):
        models.pipeline("svm", ["f"])


def test_smaller_readers(spark, tmp_path):
    (tmp_path / "info.csv").write_text("A title\n\nrow,Age (years),Note\n1,41,x\n2,52,y\n")
    info = files.read_demographics(spark, f"{tmp_path}/info.csv", {"Age (years)": "age"}, 2, ("Note",))
    assert [tuple(r) for r in info.orderBy("row").collect()] == [(1, 41), (2, 52)]
    plain = tmp_path / "plain.csv"
    plain.write_text("row,age\n1,41\n")
    assert files.read_demographics(spark, str(plain), {}).first().age == 41
    signals = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "id int, signal array<double>")
    assert [tuple(r) for r in files.paired_by_row(signals, info).collect()] == [(1, [1.0], 41)]
    for k in range(2):
        (tmp_path / f"feats_{k}.csv").write_text(f"patient,f\n{k},0.{k + 1}\n")
    back = files.read_folds(spark, f"{tmp_path}/feats_*.csv", "patient int, f double").orderBy("fold").collect()
    assert [tuple(r) for r in back] == [(0, 0.1, 0), (1, 0.2, 1)]
    spark.createDataFrame([("r", "p", "Part_1", 125, [1.0], None, 7)], RECORD + ", other int").write.parquet(f"{tmp_path}/w")
    assert files.read_waveforms(spark, f"{tmp_path}/w").columns == ["record", "patient", "part", "fs", "signal", "abp_signal"]
    text = spark.createDataFrame([("a \t",), ("NaN",), ("1.5",), (None,), ("x",)], "v string")
    got = text.select(files.trailing_free("v").alias("t"), files.nan_text("v").alias("n")).collect()
    assert [r.t for r in got] == ["a", "NaN", "1.5", None, "x"] and [r.n for r in got] == [None, None, 1.5, None, None]


def test_lag_sums_against_dot_products():
    rng = np.random.default_rng(1)
    for n, m in ((300, 300), (300, 280), (40, 64)):
        a, p = rng.normal(size=n), rng.normal(size=m)
        ks = np.arange(m - 30, m + 10)
        plain = [sum(a[i] * p[i + d] for i in range(n) if 0 <= i + d < m) for d in (m - 1 - ks)]
        assert np.allclose(vec.lag_sums(a, p, ks[0], ks[-1] + 1), plain)
        assert np.allclose([vec.lag_sum(a, p, int(m - 1 - k)) for k in ks], plain)
