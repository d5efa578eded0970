"""Operators on hot keys and copies: places in an order, duplicates, trimmed means, fold statistics, listed names."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsejobs.catalog.model_jobs import FEATURES
from pulsejobs.catalog.tables import K, folded
from pulsejobs.operators import dedupe, joins, mabp, metrics, models, ranking, scaling, splits
from pulsejobs.sources import files


@pytest.mark.parametrize("parts", [1, 7])
def test_places_with_a_hot_first_key(spark, parts):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 2 else f"k{rng.integers(0, 40):02d}", int(rng.integers(0, 10**6)), i) for i in range(3000)] + [(None, 1, -1), ("é", 2, -2), ("z", None, -3)]
    df = spark.createDataFrame(rows, "k string, n int, i int")
    out = ranking.with_place(df, ["k", "n", "i"], parts=parts)
    want = sorted(rows, key=lambda r: tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in r))
    assert [(r.k, r.n, r.i) for r in out.orderBy("place").collect()] == want
    assert sorted(r.place for r in out.collect()) == list(range(1, len(rows) + 1))
    bounds = ranking.range_bounds(df, ["k", "n", "i"], 7)
    sizes = df.groupBy(ranking.range_of(bounds, ["k", "n", "i"], df)).count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) < 900  # half of the rows share k
    assert ranking.with_place(df.limit(0), ["k"]).collect() == []
    same = ranking.with_place(spark.createDataFrame([("x",)] * 50, "k string"), ["k"], parts=4)
    assert sorted(r.place for r in same.collect()) == list(range(1, 51))


#: The sample arrays in a plan; the digests of them are called _signal and _abp_signal.
WAVES = r"(?<!\w)(?:abp_)?signal#"


def copies(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        kind = i % 3
        signal = [1.0, 2.0] if kind == 0 else [float(rng.integers(0, 12))] * 2
        rows.append((i, f"t{i % 40}", signal, [float(rng.integers(0, 30)), float(i % 2)]))
    rows += [(600, "n", None, [0.0]), (601, "n", None, [5.0]), (602, None, [None, 1.0], [6.0]), (603, None, [1.0, None], [7.0]), (604, None, [1.0], [8.0]), (605, "z", [0.5], None), (606, "z", [0.25], None)]
    return rows, spark.createDataFrame(rows, "i int, t string, signal array<double>, abp_signal array<double>")


def first_of_each(rows):
    left = sorted(rows, key=lambda r: (r[0],))
    for place in (2, 3):
        seen, kept = set(), []
        for r in left:
            value = None if r[place] is None else tuple(r[place])
            if value not in seen:
                seen.add(value)
                kept.append(r)
        left = kept
    return left


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_duplicates_by_removed_keys(spark, most):
    rows, df = copies(spark)
    want = [r[0] for r in first_of_each(rows)]
    out = dedupe.drop_duplicate_windows(df, ["i", "t"], most=most)
    assert sorted(r.i for r in out.collect()) == want
    assert tuple(dedupe.duplicate_counts(df, ["i", "t"]).first()) == (len(rows), len(rows) - len(want))


def test_no_window_is_shuffled_by_the_removal_of_duplicates(spark, tmp_path):
    _, df = copies(spark)
    df.write.parquet(f"{tmp_path}/w")
    out = dedupe.drop_duplicate_windows(spark.read.parquet(f"{tmp_path}/w"), ["i", "t"])
    plan = out._jdf.queryExecution().toString()
    moved = [x for x in plan.split("== Physical Plan ==")[1].split("\n") if re.search(r"\bExchange\b", x)]
    assert moved and not any(re.search(WAVES, x) for x in moved)
    text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    exchanges = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: (.*)", text)
    assert exchanges and not any(re.search(WAVES, x) for x in exchanges)


@pytest.mark.parametrize("hot", [5, 1_000_000])
def test_trimmed_means_of_hot_positions(spark, hot):
    rng = np.random.default_rng(3)
    rows = [(w, c, p, float(rng.normal()) if rng.random() > 0.05 else None) for w in (1, 2, None) for c in range(40 if w == 1 else 3) for p in range(4)]
    rows += [(9, 0, 0, None), (9, 1, 1, 4.0)]
    out = {(r.win, r.pos): r.x for r in mabp.trimmed_mean(spark.createDataFrame(rows, "win int, cyc int, pos int, x double"), ["win"], hot=hot, salts=4).collect()}
    for key in {(w, p) for w, _, p, _ in rows}:
        x = np.array([v for w, _, p, v in rows if (w, p) == key and v is not None])
        if not len(x):
            assert out[key] is None
            continue
        near = x[np.abs(x - x.mean()) <= 1.25 * x.std()]
        assert out[key] == pytest.approx((near if len(near) else x).mean())
    assert len(out) == len({(w, p) for w, _, p, _ in rows})
    plan = mabp.trimmed_mean(spark.createDataFrame(rows, "win int, cyc int, pos int, x double"), ["win"])._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]


def test_run_extremes_are_those_of_the_train_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, float(rng.normal()) if i % 11 else None, float("nan") if i % 13 == 0 else float(i), 2.0) for i in range(200)]
    df = spark.createDataFrame(rows, "patient int, fold int, a double, b double, c double")
    plain = splits.rotations(df, 5).where("mode = 'tr'").groupBy("run").agg(*[f(F.when(~F.isnan(x), F.col(x))).alias(f"{n}_{x}") for x in "abc" for n, f in (("lo", F.min), ("hi", F.max))])
    want = {r["run"]: tuple(r)[1:] for r in plain.collect()}
    assert {r["run"]: tuple(r)[1:] for r in scaling.run_extremes(df, 5, ["a", "b", "c"]).collect()} == want
    out = scaling.scaled_rotations(df, 5, ["a", "b", "c"])
    assert out.columns[-1] == "mode" or set(out.columns) == {"run", "patient", "fold", "a", "b", "c", "mode"}
    assert out.where("mode = 'tr' AND (a < 0 OR a > 1)").count() == 0 and out.where("c <> 0").count() == 0
    assert out.count() == 1000 and [r["run"] for r in scaling.scaled_rotations(df, 5, ["a"], True).select("run").distinct().collect()] == [0]


def test_boosted_trees_beat_the_naive_baseline(spark):
    # the labels of these rows have nothing to do with their features, so the test makes some that have
    rows = folded(spark, "/root/testdata/sf0.001").withColumn("SP", 90 + F.col("f2") / 1000 + 3 * F.col("f4"))
    found = models.cross_validated(rows, K, "SP", FEATURES, "gbt", maxIter=5, maxDepth=3, seed=1)
    tested = found.where("mode = 'ts'").persist()
    ours, naive = (metrics.summary(tested.withColumn("pred", F.col(c)), ["target"]).first().mae for c in ("pred", "naive"))
    assert ours < 0.7 * naive and tested.groupBy("trial").count().where("count > 1").count() == 0
    fit = found.where("mode = 'tr' AND fold = 2").select("naive", "label").collect()
    assert fit[0].naive == pytest.approx(np.mean([r.label for r in fit]))


def test_first_match_and_listed_names(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), (None, 5, "z")], "f string, s int, n string")
    assert sorted((tuple(r) for r in joins.first_match(df, "f", ["s"]).collect()), key=str) == sorted([("a", 1, "y"), ("b", 2, None), (None, 5, "z")], key=str)
    (tmp_path / "order.csv").write_text("c, a,b\n")
    assert sorted(tuple(r) for r in files.read_listed_names(spark, f"{tmp_path}/order.csv").collect()) == [(0, "c"), (1, "a"), (2, "b")]


def test_a_sample_at_the_edge_of_trimming_counts_in_any_order(spark):
    # mean 25, deviation 8: 15 is at exactly 1.25 deviations; summed in these orders the deviation comes out smaller
    orders = [(14, 32, 32, 33, 15, 24), (14, 33, 32, 32, 15, 24), (32, 32, 33, 24, 14, 15)]
    rows = [(w, c, 0, float(x)) for w, xs in enumerate(orders) for c, x in enumerate(xs)]
    out = mabp.trimmed_mean(spark.createDataFrame(rows, "win int, cyc int, pos int, x double").coalesce(1), ["win"]).collect()
    assert sorted((r.win, r.x) for r in out) == [(w, pytest.approx(27.2)) for w in range(len(orders))]
