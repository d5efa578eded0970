"""Splits, scaling, selection, metrics on feature rows."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics, scaling, splits
from ..sources import adapters
from . import FEATURES, WIDE, query, r6, r6s

K, SEED = 5, 7


def folds_sql(k=K, seed=SEED):
    """CTE p (patient, fold) after f: ntile over the seeded hash order."""
    return f"""{FEATURES}, p AS (SELECT patient, ntile({k}) OVER (ORDER BY md5('{seed}:' || patient), patient) - 1 AS fold FROM (SELECT DISTINCT patient FROM f)),
ff AS (SELECT f.*, fold FROM f JOIN p USING (patient))"""


def folded(spark, sf_dir, k=K):
    return splits.with_folds(adapters.feature_rows(spark, sf_dir), k, SEED)


_RUNS = f"""{folds_sql()}, r AS (SELECT *, CASE WHEN fold = run THEN 'ts' WHEN fold = (run + 1) % {K} THEN 'val' ELSE 'tr' END AS mode FROM ff, range({K}) t(run))"""
_TARGETS = "unnest(['SP', 'DP']) AS target"


@query("spl1_patient_folds", f"WITH {folds_sql()} SELECT patient, fold::BIGINT AS fold FROM p")
def spl1(spark, sf_dir):
    return splits.patient_folds(adapters.feature_rows(spark, sf_dir), K, SEED).select("patient", F.col("fold").cast("long").alias("fold"))


_PARTS = f"{FEATURES}, d AS (SELECT 'Part_' || (1 + patient % 4) || '_' || patient AS patient, trial FROM f), q AS (SELECT *, split_part(patient, '_', 1) || '_' || split_part(patient, '_', 2) AS part FROM d)"


def _parts(spark, sf_dir):
    return adapters.feature_rows(spark, sf_dir).select(F.concat(F.lit("Part_"), (1 + F.col("patient") % 4).cast("string"), F.lit("_"), F.col("patient").cast("string")).alias("patient"), "trial")


@query("spl2_hold_out", f"WITH {_PARTS} SELECT patient, trial, CASE part WHEN 'Part_4' THEN 0 WHEN 'Part_3' THEN 1 ELSE 2 END::BIGINT AS fold FROM q")
def spl2(spark, sf_dir):
    return splits.hold_out(_parts(spark, sf_dir), ["Part_1", "Part_2"], ["Part_3"], ["Part_4"]).withColumn("fold", F.col("fold").cast("long"))


@query("spl3_shared_part", f"""WITH {_PARTS}, s AS (SELECT patient, row_number() OVER (ORDER BY md5('{SEED}:' || patient), patient) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT patient FROM q WHERE part = 'Part_4'))
SELECT q.patient AS patient, trial, CASE WHEN r IS NULL THEN 2 WHEN r <= floor(n * 0.2) THEN 1 ELSE 0 END::BIGINT AS fold FROM q LEFT JOIN s ON s.patient = q.patient WHERE part IN ('Part_1', 'Part_2', 'Part_4')""")
def spl3(spark, sf_dir):
    out = splits.hold_out(_parts(spark, sf_dir), ["Part_1", "Part_2"], ["Part_4"], ["Part_4"], SEED)
    return out.withColumn("fold", F.col("fold").cast("long"))


@query("spl4_rotations", f"WITH {_RUNS} SELECT run, mode, fold::BIGINT AS fold, count(*) AS rows, count(DISTINCT patient) AS patients FROM r GROUP BY ALL")
def spl4(spark, sf_dir):
    out = splits.rotations(folded(spark, sf_dir), K).groupBy(F.col("run").cast("long").alias("run"), "mode", F.col("fold").cast("long").alias("fold"))
    return out.agg(F.count("*").alias("rows"), F.count_distinct("patient").alias("patients"))


@query("spl5_leaks", f"""WITH {folds_sql()} SELECT 'by patient' AS split, patient, count(DISTINCT fold) AS folds FROM ff GROUP BY patient HAVING count(DISTINCT fold) > 1
UNION ALL SELECT 'by row', patient, count(DISTINCT trial % {K}) FROM ff GROUP BY patient HAVING count(DISTINCT trial % {K}) > 1""")
def spl5(spark, sf_dir):
    """Patients in more than one fold: none of the split by patients, many of one that deals rows."""
    rows = folded(spark, sf_dir)
    of = lambda name, df: splits.leaks(df).select(F.lit(name).alias("split"), "patient", "folds")
    return of("by patient", rows).union(of("by row", rows.withColumn("fold", F.col("trial") % K)))


@query("spl6_fold_counts", f"WITH {folds_sql()} SELECT fold::BIGINT AS fold, count(*) AS rows FROM ff GROUP BY ROLLUP (fold)")
def spl6(spark, sf_dir):
    return splits.fold_counts(folded(spark, sf_dir)).select(F.col("fold").cast("long").alias("fold"), "rows")


_MM = ", ".join(f"(f{i} - lo{i}) / CASE WHEN hi{i} = lo{i} THEN 1 ELSE hi{i} - lo{i} END" for i in range(1, 5))


@query("scl1_min_max_by_rotation", f"""WITH {_RUNS}, m AS (SELECT run, {', '.join(f'min(f{i}) AS lo{i}, max(f{i}) AS hi{i}' for i in range(1, 5))} FROM r WHERE mode = 'tr' GROUP BY run)
SELECT run, mode, trial, {', '.join(f"{r6s(x)} AS f{i}" for i, x in enumerate(_MM.split(', '), 1))} FROM r JOIN m USING (run)""")
def scl1(spark, sf_dir):
    out = scaling.scaled_rotations(folded(spark, sf_dir), K, ["f1", "f2", "f3", "f4"])
    return out.select(F.col("run").cast("long").alias("run"), "mode", "trial", *[r6(f"f{i}").alias(f"f{i}") for i in range(1, 5)])


@query("scl2_label_ranges", f"WITH {FEATURES} SELECT trial, {r6s('(SP - 80) / 120')} AS sp, {r6s('(DP - 50) / 60')} AS dp, {r6s('(SP - 80) / 120 * 120 + 80')} AS sp_back FROM f")
def scl2(spark, sf_dir):
    sp = scaling.to_range(F.col("SP"), "SP")
    # values with a 5 in the seventh decimal are rounded by their binary value, not by how they are printed
    six = lambda c, name: (F.round(c * 1e6) / 1e6).alias(name)
    return adapters.feature_rows(spark, sf_dir).select("trial", six(sp, "sp"), six(scaling.to_range(F.col("DP"), "DP"), "dp"), six(scaling.from_range(sp, "SP"), "sp_back"))


def _labelled_windows(spark, sf_dir):
    return adapters.wide_windows(spark, sf_dir).withColumns({"SP": F.array_max("signal") * 100, "DP": F.array_min("signal") * 100, "abp_signal": F.transform("signal", lambda x: x * 2 + 1)})


_LW = f"{WIDE}, l AS (SELECT trial, max(x) * 100 AS SP, min(x) * 100 AS DP FROM e GROUP BY trial)"
_GS = f"""{_LW}, g AS (SELECT avg(SP) AS SP_mean, stddev_samp(SP) AS SP_std, min(SP) AS SP_min, max(SP) AS SP_max, avg(DP) AS DP_mean, stddev_samp(DP) AS DP_std, min(DP) AS DP_min, max(DP) AS DP_max FROM l),
h AS (SELECT avg(x) AS signal_mean, stddev_pop(x) AS signal_std, min(x) AS signal_min, max(x) AS signal_max, avg(x * 2 + 1) AS abp_signal_mean, stddev_pop(x * 2 + 1) AS abp_signal_std, min(x * 2 + 1) AS abp_signal_min, max(x * 2 + 1) AS abp_signal_max FROM e)"""
_GN = [f"{k}_{n}" for k in ("SP", "DP", "signal", "abp_signal") for n in ("mean", "std", "min", "max")]


@query("scl3_global_statistics", f"WITH {_GS} SELECT {', '.join(f'{r6s(c)} AS {c}' for c in _GN)} FROM g, h")
def scl3(spark, sf_dir):
    return scaling.global_statistics(_labelled_windows(spark, sf_dir)).select(*[r6(c).alias(c) for c in _GN])


@query("scl4_scl5_global_scales", f"""WITH {_GS} SELECT trial, {r6s('(SP - SP_min) / (SP_max - SP_min)')} AS mm, {r6s('(SP - SP_mean) / (SP_std + 1e-6)')} AS z, {r6s('SP')} AS mm_back, {r6s('SP')} AS z_back FROM l, g""")
def scl4(spark, sf_dir):
    df = _labelled_windows(spark, sf_dir)
    held = df.crossJoin(F.broadcast(scaling.global_statistics(df)))
    mm, z = scaling.global_min_max(F.col("SP"), "SP"), scaling.global_z(F.col("SP"), "SP")
    return held.select("trial", r6(mm).alias("mm"), r6(z).alias("z"), r6(scaling.global_min_max(mm, "SP", True)).alias("mm_back"), r6(scaling.global_z(z, "SP", True)).alias("z_back"))


@query("scl6_fill_missing", f"WITH {FEATURES} SELECT trial, coalesce(CASE WHEN f4 > 2 THEN f1 END, 0) AS f1 FROM f".replace("coalesce(CASE WHEN f4 > 2 THEN f1 END, 0)", r6s("coalesce(CASE WHEN f4 > 2 THEN f1 END, 0)")))
def scl6(spark, sf_dir):
    df = adapters.feature_rows(spark, sf_dir).withColumn("f1", F.when(F.col("f4") > 2, F.col("f1")))
    return scaling.filled(df, ["f1"]).select("trial", r6("f1").alias("f1"))


_IMP = """imp AS (SELECT a.features, (a.importance + b.importance) / 2 AS importance FROM (SELECT c_mktsegment || c_nationkey AS features, avg(c_acctbal) AS importance FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a
JOIN (SELECT c_mktsegment || c_nationkey AS features, avg(c_acctbal) AS importance FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1) b USING (features))"""


@query("jon3_sel1_top_features", f"WITH {_IMP}, o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, features) AS r, count(*) OVER () AS n FROM imp) SELECT features, {r6s('importance')} AS importance FROM o WHERE r <= floor(n * 0.25)")
def sel1(spark, sf_dir):
    """Importances of two targets, averaged; the top quarter."""
    people = adapters.read(spark, sf_dir, "customer").withColumn("features", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    half = lambda k: people.where(F.col("c_custkey") % 2 == k).groupBy("features").agg(F.avg("c_acctbal").alias("importance"))
    return scaling.top_features(scaling.mean_importance(half(0), half(1)), 0.25).select("features", r6("importance").alias("importance"))


_PRED = f"{_RUNS}, pr AS (SELECT run AS fold, mode, target, trial, CASE target WHEN 'SP' THEN SP ELSE DP END AS label, CASE target WHEN 'SP' THEN 100 + f1 ELSE 60 + f4 END AS pred FROM (SELECT *, {_TARGETS} FROM r))"


def predictions(spark, sf_dir):
    rows = splits.rotations(folded(spark, sf_dir), K)
    each = F.explode(F.array(F.struct(F.lit("SP").alias("target"), F.col("SP").alias("label"), (100 + F.col("f1")).alias("pred")), F.struct(F.lit("DP").alias("target"), F.col("DP").alias("label"), (60 + F.col("f4")).alias("pred"))))
    return rows.select(F.col("run").cast("long").alias("fold"), "mode", "trial", each.alias("r")).select("fold", "mode", "trial", "r.*")


_ERR = "round(avg(abs(pred - label)), 3) AS mae, round(stddev_pop(pred - label), 3) AS std, round(avg(pred - label), 3) AS me"


@query("agg3_error_summary", f"WITH {_PRED} SELECT mode, target, {_ERR} FROM pr GROUP BY mode, target")
def agg3(spark, sf_dir):
    return metrics.summary(predictions(spark, sf_dir), ["mode", "target"])


@query("agg6_errors_by_fold_and_pooled", f"WITH {_PRED} SELECT mode, target, fold, {_ERR} FROM pr GROUP BY GROUPING SETS ((mode, target, fold), (mode, target))")
def agg6(spark, sf_dir):
    return metrics.summary_with_folds(predictions(spark, sf_dir))


_NAIVE = f"{_RUNS}, nv AS (SELECT run, avg(SP) AS n_sp, avg(DP) AS n_dp FROM r WHERE mode = 'tr' GROUP BY run), er AS (SELECT target, CASE target WHEN 'SP' THEN n_sp - SP ELSE n_dp - DP END AS e FROM (SELECT *, {_TARGETS} FROM r JOIN nv USING (run) WHERE mode = 'ts'))"


@query("agg4_naive_by_rotation", f"WITH {_RUNS}, nv AS (SELECT run, avg(SP) AS n_sp, avg(DP) AS n_dp FROM r WHERE mode = 'tr' GROUP BY run) SELECT run, mode, target, count(*) AS rows, {r6s('avg(CASE target WHEN $$SP$$ THEN n_sp ELSE n_dp END)')} AS naive FROM (SELECT *, {_TARGETS} FROM r JOIN nv USING (run)) GROUP BY ALL")
def agg4(spark, sf_dir):
    out = metrics.with_naive(folded(spark, sf_dir), K, ["SP", "DP"])
    return out.groupBy(F.col("run").cast("long").alias("run"), "mode", "target").agg(F.count("*").alias("rows"), r6(F.avg("naive")).alias("naive"))


NAIVE_SQL = f"WITH {_NAIVE} SELECT target, round(avg(abs(e)), 3) AS mae, round(stddev_pop(e), 3) AS std, round(avg(e), 3) AS me FROM er GROUP BY target"


@query("agg5_naive_report", NAIVE_SQL)
def agg5(spark, sf_dir):
    return metrics.naive_report(folded(spark, sf_dir), K, ["SP", "DP"])


@query("agg7_scaled_error", f"""WITH {_PRED}, mo AS (SELECT target, round(avg(abs(pred - label)), 3) AS mae FROM pr WHERE mode = 'ts' GROUP BY target),
nv AS (SELECT run, avg(SP) AS n_sp, avg(DP) AS n_dp FROM r WHERE mode = 'tr' GROUP BY run), er AS (SELECT target, CASE target WHEN 'SP' THEN n_sp - SP ELSE n_dp - DP END AS e FROM (SELECT *, {_TARGETS} FROM r JOIN nv USING (run) WHERE mode = 'ts')),
ne AS (SELECT target, round(avg(abs(e)), 3) AS mae FROM er GROUP BY target)
SELECT target, round(mo.mae / ne.mae, 4) AS scaled_mae FROM mo JOIN ne USING (target)""")
def agg7(spark, sf_dir):
    rows = folded(spark, sf_dir)
    model = metrics.summary(predictions(spark, sf_dir).where("mode = 'ts'"), ["target"])
    return metrics.scaled_error(model, metrics.naive_report(rows, K, ["SP", "DP"]))


@query("agg8_pressure_shares", f"""WITH {FEATURES} SELECT {r6s('avg((SP >= 160)::INT)')} AS sp_ge_160, {r6s('avg((SP >= 140)::INT)')} AS sp_ge_140, {r6s('avg((SP <= 100)::INT)')} AS sp_le_100,
  {r6s('avg((DP >= 100)::INT)')} AS dp_ge_100, {r6s('avg((DP >= 85)::INT)')} AS dp_ge_85, {r6s('avg((DP <= 70)::INT)')} AS dp_le_70, {r6s('avg((DP <= 60)::INT)')} AS dp_le_60 FROM f""")
def agg8(spark, sf_dir):
    out = metrics.pressure_shares(adapters.feature_rows(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("agg9_waveform_error", f"""WITH {WIDE}, d AS (SELECT trial, x * 0.9 + 0.01 - x AS d FROM e), m AS (SELECT trial, avg(d) AS m FROM d GROUP BY trial)
SELECT {r6s('avg(d * d)')} AS mse, {r6s('avg(abs(d))')} AS mae, {r6s('avg(d)')} AS me, {r6s('(SELECT stddev_samp(m) FROM m)')} AS std FROM d""")
def agg9(spark, sf_dir):
    df = adapters.wide_windows(spark, sf_dir).withColumn("pred", F.transform("signal", lambda x: x * 0.9 + 0.01))
    return metrics.waveform_error(df, "pred", "signal").select(*[r6(c).alias(c) for c in ("mse", "mae", "me", "std")])


@query("agg10_masked_pressure", f"WITH {WIDE} SELECT trial, {r6s('max(x) FILTER (WHERE i < 40)')} AS SP, {r6s('min(x) FILTER (WHERE i < 40)')} AS DP FROM e GROUP BY trial")
def agg10(spark, sf_dir):
    df = adapters.wide_windows(spark, sf_dir).withColumn("mask", F.transform("signal", lambda _, i: (i < 40).cast("int")))
    return metrics.masked_pressure(df, "signal", "mask").select("trial", r6("SP").alias("SP"), r6("DP").alias("DP"))


@query("waveform_sizes", f"WITH {WIDE} SELECT patient, count(DISTINCT trial) AS windows, {r6s('sum(x)')} AS total FROM e GROUP BY patient")
def waveform_sizes(spark, sf_dir):
    return adapters.wide_windows(spark, sf_dir).groupBy("patient").agg(F.count("*").alias("windows"), r6(F.sum(A.total("signal"))).alias("total"))
