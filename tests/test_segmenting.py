"""Plans that cut whole collections, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsejobs.functions.vec import fourier_resampled
from pulsejobs.operators.segment import WindowSpec
from pulsejobs.plans import segmenting
from pulsejobs.sources import files


def slow_resampled(x, m):
    """The trigonometric sum through the samples, with the bins that both lengths have, at m places."""
    n, k = len(x), min(len(x), m)
    t, out = np.arange(m) / m, np.zeros(m)
    for f in range(-((k - 1) // 2), (k - 1) // 2 + 1):
        out += (np.sum(x * np.exp(-2j * np.pi * f * np.arange(n) / n)) * np.exp(2j * np.pi * f * t)).real
    if k % 2 == 0:
        half = np.sum(x * np.exp(-1j * np.pi * k * np.arange(n) / n))
        # both sides fold onto one bin when the recording gets shorter, and share it when it gets longer
        out += half.real * np.cos(np.pi * k * t) * (2 if m < n else 1)
    return out / n


@pytest.mark.parametrize(("n", "m"), [(9, 4), (10, 5), (12, 12), (7, 11), (8, 13), (40, 30), (1, 3)])
def test_fourier_resampling(n, m):
    x = np.random.default_rng(n).normal(size=(3, n))
    assert np.allclose(fourier_resampled(x, m), [slow_resampled(r, m) for r in x], atol=1e-9)


def shifted(ppg, abp, fs):
    """Cut where the full correlation, counted from whole seconds, is largest within a second."""
    n = len(abp) // fs * fs
    best = max(range(n - fs, n), key=lambda k: (round(sum(abp[i] * ppg[i + len(ppg) - 1 - k] for i in range(len(abp)) if 0 <= i + len(ppg) - 1 - k < len(ppg)), 9), -k))
    start = n - best
    return ppg[start : start + n - fs], abp[: n - fs]


def test_long_recordings_from_their_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    (tmp_path / "pats").mkdir()
    plain = {}
    for k, n in ((1, 330), (2, 247), (3, 330)):
        wave = np.cumsum(rng.normal(size=n)) if k != 3 else None
        ppg, abp = (wave, np.roll(wave, 2) / 100) if k != 3 else plain[1]
        plain[k] = (ppg, abp)
        (tmp_path / f"pats/pat{k}pred.csv").write_text("t,PPG,reBAP\n" + "".join(f"{i},{p!r},{b!r}\n" for i, (p, b) in enumerate(zip(ppg.tolist(), abp.tolist(), strict=True))))
    info = spark.createDataFrame([(1, "X1", "F", 40), (2, "X2", "M", 50), (3, "X3", "M", 60), (9, "X9", "F", 1)], "row int, patient string, gender string, age int")
    records = segmenting.read_long_records(spark, f"{tmp_path}/pats/*.csv", info, {"PPG": "signal", "reBAP": "abp_signal"}).drop("id")
    out = segmenting.long_records(records, 20, win_sec=2, wait_sec=3, new=10, dropped=11, edge_sec=2)
    assert out.columns == ["patient", "trial", "gender", "age", "signal", "abp_signal"]
    want = {}
    for k in (1, 2):  # recording 3 repeats the first
        channels = [x[:-11] for x in plain[k]]
        channels = [slow_resampled(x, int(np.round(len(x) / 20 * 10)))[20:-20] for x in channels]
        ppg, abp = shifted(channels[0], channels[1] * 100, 10)
        want |= {f"X{k}_{j}": (ppg[30 * j : 30 * j + 20], abp[30 * j : 30 * j + 20]) for j in range(len(abp) // 30)}
    rows = {r.trial: r for r in out.collect()}
    assert set(rows) == set(want) and len(want) > 3
    for t, (ppg, abp) in want.items():
        assert np.allclose(rows[t].signal, ppg, atol=1e-8) and np.allclose(rows[t].abp_signal, abp, atol=1e-6), t
    with pytest.raises(ValueError):
        segmenting.long_records(records, 20)


def test_short_recordings_in_a_listed_order(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    wave = {}
    for name in ("2_1", "2_2", "7_1", "9_1"):
        wave[name] = np.sin(np.arange(40) / 3 + len(wave))
        (tmp_path / f"txt/{name}.txt").write_text("\t".join(map(repr, wave[name].tolist())) + "\t")
    (tmp_path / "order.csv").write_text("7_1.txt, 2_1.txt,5_5.txt,2_2.txt\n")
    (tmp_path / "info.csv").write_text("PPG data,,,\nNum.,subject_ID,Age,Systolic(mmHg),Diastolic(mmHg)\n1,2,40,120,80\n2,7,50,140,90\n")
    info = files.read_demographics(spark, f"{tmp_path}/info.csv", {"subject_ID": "patient", "Systolic(mmHg)": "SP", "Diastolic(mmHg)": "DP"}, 1, ("Num.",))
    recordings = files.read_tab_lines(spark, f"{tmp_path}/txt/*.txt")
    listed = files.read_listed_names(spark, f"{tmp_path}/order.csv")
    out = segmenting.short_records(recordings, info, 20, 10, listed, F.concat("trial", F.lit(".txt")))
    assert out.columns == ["patient", "trial", "SP", "DP", "pos", "Age", "signal"]
    rows = out.orderBy("pos").collect()
    assert [(r.trial, r.SP, r.Age, r.pos) for r in rows] == [("7_1", 140, 50, 0), ("2_1", 120, 40, 1), ("2_2", 120, 40, 3)]
    for r in rows:
        assert np.allclose(r.signal, slow_resampled(wave[r.trial], 20))
    assert {r.trial for r in segmenting.short_records(recordings, info, 20).collect()} == {"2_1", "2_2", "7_1"}


def test_parts_and_centres(spark):
    rng = np.random.default_rng(6)
    waves = [(np.cumsum(rng.normal(size=95)), np.cumsum(rng.normal(size=95))) for _ in range(4)]
    rows = [("Part_1", 0, *waves[0]), ("Part_1", 1, *waves[1]), ("Part_2", 0, *waves[0])]
    df = spark.createDataFrame([(p, i, a.tolist(), b.tolist()) for p, i, a, b in rows], "part string, i int, signal array<double>, abp_signal array<double>")
    out = {r.trial: r for r in segmenting.parts_of_records(df, 10, WindowSpec.of(10, win_sec=3)).collect()}
    assert set(out) == {f"Part_1_{i}_{j}" for i in (0, 1) for j in range(2)}
    for i in (0, 1):
        ppg, abp = shifted(*waves[i], 10)
        for j in range(2):
            r = out[f"Part_1_{i}_{j}"]
            assert r.patient == f"Part_1_{i}" and np.allclose(r.signal, ppg[30 * j : 30 * j + 30]) and np.allclose(r.abp_signal, abp[30 * j : 30 * j + 30])
    files_of = [("a.mat", 0, *waves[2]), ("a.mat", 1, *waves[3]), ("b.mat", 0, *waves[2]), ("c.mat", 0, *waves[0])]
    df = spark.createDataFrame([(f, s, a.tolist(), b.tolist()) for f, s, a, b in files_of], "file_name string, segment int, signal array<double>, abp_signal array<double>")
    who = spark.createDataFrame([("a.mat", 5, "F"), ("a.mat", 6, "M"), ("b.mat", 8, "M")], "file_name string, patient int, gender string")
    rows = {r.trial: r for r in segmenting.centres_of_records(df, who, 10, WindowSpec.of(10, win_sam=21)).collect()}
    assert set(rows) == {"a_0", "a_1"} and rows["a_0"].patient == 5 and rows["a_0"].gender == "F"
    ppg, abp = shifted(*waves[3], 10)
    start = (len(abp) - 21) // 2
    assert np.allclose(rows["a_1"].signal, ppg[start : start + 21]) and np.allclose(rows["a_1"].abp_signal, abp[start : start + 21])
