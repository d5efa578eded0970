"""Records and files that no row holds whole: alignment in blocks, readers over file splits. And rule audits in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsejobs.functions import vec
from pulsejobs.operators import quality, segment
from pulsejobs.operators.segment import WindowSpec
from pulsejobs.plans import process
from pulsejobs.sources import files


def sample_rows(df, channels=("signal", "abp_signal")):
    each = [df.select("patient", F.lit(c).alias("channel"), F.posexplode(c).alias("idx", "x"), F.size("signal").cast("long").alias("len")) for c in channels]
    return each[0].union(each[1]).withColumn("idx", F.col("idx").cast("long"))


@pytest.mark.parametrize("mode", ["literal", "exact"])
@pytest.mark.parametrize("block", [50, 64, 1000])
def test_alignment_in_blocks_is_that_of_whole_records(spark, mode, block):
    rng = np.random.default_rng(block)
    rows = []
    for i, n in enumerate([26, 50, 51, 75, 260, 611, 1000]):
        lag = int(rng.integers(0, 25))
        wave = np.cumsum(rng.normal(size=n + lag))
        rows.append((i, (wave[:n] + rng.normal(0, 0.01, n)).tolist(), wave[lag:].tolist()))
    rows.append((8, [0.0] * 80, [0.0] * 80))  # all lags equal
    df = spark.createDataFrame(rows, "patient int, signal array<double>, abp_signal array<double>")
    whole = {r.patient: r for r in segment.aligned(df, 25, mode).collect()}
    found = segment.aligned_samples(sample_rows(df), 25, block=block, lag_mode=mode)
    lists = found.groupBy("patient", "shift", "len", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("x")).collect()
    assert {(r.patient, r.channel) for r in lists} == {(p, c) for p in whole for c in ("signal", "abp_signal")}
    for r in lists:
        w = whole[r.patient]
        assert r["shift"] == w["shift"] and r.len == len(w.abp_signal) and r.x == w[r.channel]


def test_alignment_with_missing_samples(spark):
    rows = [(1, "signal", i, None if i % 7 == 0 else float(i % 9), 100) for i in range(100)] + [(1, "abp_signal", i, float("nan") if i == 3 else float(i % 9), 100) for i in range(100) if i != 20]
    rows += [(None, "signal", 0, 1.0, 100), (2, "signal", 0, 1.0, 5), (1, "other", 4, 1.0, 100)]
    out = segment.aligned_samples(spark.createDataFrame(rows, "patient int, channel string, idx long, x double, len long"), 10, block=20).collect()
    assert {r.patient for r in out} == {1} and len({r["shift"] for r in out}) == 1
    assert segment.aligned_samples(spark.createDataFrame([], "patient int, channel string, idx long, x double, len long"), 10).collect() == []
    with pytest.raises(ValueError):
        segment.aligned_samples(spark.createDataFrame(rows, "patient int, channel string, idx long, x double, len long"), 10, block=19)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_files_of_several_splits(small_splits, tmp_path, end):
    spark = small_splits
    rng = np.random.default_rng(1)
    for k, n in ((3, 400), (11, 37), (20, 0)):
        lines = ["PPG, reBAP"] + [f"{x:.6f},{'nan' if i % 50 == 7 else f'{x / 3:.3f}' if i % 31 else 'bad'}" for i, x in enumerate(rng.normal(size=n))]
        lines.insert(len(lines) // 2, "  ")
        (tmp_path / f"pat{k}pred.csv").write_text(end.join(lines) + (end if k == 3 else ""), newline="")
    glob, names = f"{tmp_path}/*.csv", {"PPG": "signal", "reBAP": "abp_signal"}
    assert spark.read.text(glob).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 6
    whole = {r.name: r for r in files.read_column_csv(spark, glob, names).collect()}
    rows = files.column_csv_samples(spark, glob, names)
    plain = lambda v: "nan" if v is not None and v != v else v
    for name in whole:
        for c in names.values():
            mine = rows.where((F.col("name") == name) & (F.col("channel") == c)).orderBy("idx").collect()
            assert [r.idx for r in mine] == list(range(len(mine))) and {r.len for r in mine} <= {len(mine)}
            assert [plain(r.x) for r in mine] == [plain(v) for v in whole[name][c]], (name, c)
    cut = segment.windows_of_samples(rows, WindowSpec(30, 30), ["signal", "abp_signal"], "name").collect()
    assert sorted((r.name, r.j) for r in cut) == sorted([("pat3pred", j) for j in range(13)] + [("pat11pred", 0)])
    for r in cut:
        assert r.signal == whole[r.name].signal[30 * r.j : 30 * r.j + 30]


def test_tab_lines_of_several_splits(small_splits, tmp_path):
    spark = small_splits
    rng = np.random.default_rng(2)
    long = "\t".join(f"{x:.5f}" for x in rng.normal(size=500))
    for name, text in (("7_1", long + "\t"), ("7_2", "1\tx\t3\t\n"), ("8_1", "1\t2"), ("9_1", "5"), ("10_1", "4\t")):
        (tmp_path / f"{name}.txt").write_text(text)
    glob = f"{tmp_path}/*.txt"
    whole = {r.trial: r for r in files.read_tab_lines(spark, glob).collect()}
    found: dict[str, list] = {}
    for r in files.tab_line_samples(spark, glob).orderBy("trial", "idx").collect():
        assert (r.patient, r.len, r.channel) == (whole[r.trial].patient, len(whole[r.trial].signal), "signal")
        found.setdefault(r.trial, []).append(r.x)
    assert found == {t: r.signal for t, r in whole.items() if r.signal}
    assert len(found["7_1"]) == 500 and found["7_2"] == [1.0, None, 3.0]


def test_splines_of_many_windows_against_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        n = int(rng.integers(2, 14))
        x = np.cumsum(rng.uniform(0.6, 40, n)) - 30
        rows.append((i, x.tolist(), rng.normal(size=n).tolist(), int(rng.choice([90, 120]))))
    rows += [(900, [1.0], [2.0], 5), (901, None, None, 5)]
    out = spark.createDataFrame(rows, "i int, k array<double>, v array<double>, n int").withColumn("b", vec.spline_baseline("k", "v", "n")).collect()
    for r in out:
        if r.i >= 900:
            assert r.b is None
            continue
        x, y, at = np.array(r.k), np.array(r.v), np.arange(r.n, dtype=float)
        n = len(x)
        if n < 4:
            assert np.allclose(r.b, np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0]), rtol=1e-6, atol=1e-6)
            continue
        h, s = np.diff(x), np.diff(y) / np.diff(x)
        m, right, i = np.zeros((n, n)), np.zeros(n), np.arange(1, n - 1)
        m[i, i - 1], m[i, i], m[i, i + 1], right[i] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * np.diff(s)
        m[0, :3], m[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
        d = np.linalg.solve(m, right)
        want = []
        for t in at:
            j = min(max(int(np.searchsorted(x, t, "right")) - 1, 0), n - 2)
            u, w = t - x[j], x[j + 1] - t
            want.append((d[j] * w**3 + d[j + 1] * u**3) / (6 * h[j]) + (y[j] / h[j] - d[j] * h[j] / 6) * w + (y[j + 1] / h[j] - d[j + 1] * h[j] / 6) * u)
        assert np.allclose(r.b, want, rtol=1e-8, atol=1e-8 * max(1, np.abs(want).max()))


def test_audit_counts_what_each_rule_removes(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(80, 260)), float(rng.integers(10, 120)), float(rng.integers(0, 60)) if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, SP double, DP double, p2v double")
    steps = [("pressure", quality.pressure_rules()), ("pulse", quality.pulse_rules(least=40))]
    audit, out, want = quality.Audit(), df, []
    for name, rules in steps:
        before = out
        out = audit.step(out, name, rules)
        plain = df if name == "pressure" else quality.keep(df, steps[0][1])
        want += [(name, rule, plain.count() - plain.where(test).count()) for rule, test in rules.items()]
        assert before.columns == out.columns
    out.write.parquet(f"{tmp_path}/kept")
    assert audit.rows() == want and all(n for *_, n in want)
    assert [t.collect()[0][:2] for t in audit.tables(spark)] == [("pressure", "sp_high"), ("pulse", "pulse")]
    empty = quality.Audit()
    empty.step(df.where("i < 0"), "pressure", quality.pressure_rules()).write.parquet(f"{tmp_path}/none")
    assert [n for *_, n in empty.rows()] == [0, 0, 0]


def test_cleaning_writes_once_and_does_not_shuffle(spark, tmp_path):
    t = np.arange(1250) / 125
    wave = lambda rate: (np.sin(2 * np.pi * rate * t) + 0.3 * np.sin(4 * np.pi * rate * t + 0.6)).tolist()
    rows = [("p1", "1_0", wave(1.2), [100 + 30 * x for x in wave(1.2)]), ("p2", "2_0", wave(1.4), [100 + 200 * x for x in wave(1.4)]), ("p3", "3_0", [0.0] * 1250, [100 + 30 * x for x in wave(1.1)])]
    spark.createDataFrame(rows, "patient string, trial string, signal array<double>, abp_signal array<double>").write.parquet(f"{tmp_path}/w")
    clean, audits = process.cleaned(spark.read.parquet(f"{tmp_path}/w"), process.CleanConfig(), f"{tmp_path}/clean")
    counts = {(r.step, r.rule): r.removed for a in audits for r in a.collect()}
    assert counts["pressure", "sp_high"] == 1 and counts["few extrema", "few_extrema"] == 1
    assert [r.trial for r in clean.collect()] == ["1_0"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["clean", "w"]
