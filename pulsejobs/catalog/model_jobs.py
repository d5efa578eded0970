"""Model fits, whole jobs, exports. Rows only where SQL has no counterpart."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics, models, splits
from ..operators.segment import WindowSpec, windows
from ..sources import adapters, files
from . import WINDOWS, query, r6, r6s
from .tables import _RUNS, SEED, K

FEATURES = ["f1", "f2", "f3", "f4"]
_own: list[str] = []


def scratch(spark) -> str:
    """A folder for tables that a query writes: the session's shared one, a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/models-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-models-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _columns(label, features):
    return ["patient", "trial", label, *features]


def stored(spark, sf_dir, k, columns):
    """The feature rows with their folds as a table partitioned by fold.

    Orders and line items are joined once, into files: the patients that are
    dealt into folds, their counts and the rows of the folds are read from these.
    Fits and predictions read the table by fold.
    """
    path = f"{scratch(spark)}/rows-{uuid.uuid4().hex}"
    adapters.feature_rows(spark, sf_dir).select(*columns).write.parquet(f"{path}-joined")
    splits.with_folds(spark.read.parquet(f"{path}-joined"), k, SEED).write.partitionBy("fold").parquet(path)
    return spark.read.parquet(path)


@query("mdl1_boosted_trees")
def mdl1(spark, sf_dir):
    found = models.cross_validated(stored(spark, sf_dir, K, _columns("SP", FEATURES)), K, "SP", FEATURES, "gbt", maxIter=5, maxDepth=3, seed=1)
    return metrics.summary(found, ["target", "mode", "fold"])


_STUMP_FEATURES = {"lines": "f4", "discount": "round(f3 * 100)", "quantity": "floor(f1 / 5)"}
def _stump_sql(label):
    return f"""WITH {_RUNS}, x AS (SELECT run, mode, {label}, {', '.join(f'{e}::DOUBLE AS {n}' for n, e in _STUMP_FEATURES.items())} FROM r),
long AS (SELECT run, feature, v, count(*) AS n, sum({label}) AS s FROM (
  {' UNION ALL '.join(f"SELECT run, '{n}' AS feature, {n} AS v, {label} FROM x WHERE mode = 'tr'" for n in _STUMP_FEATURES)}) GROUP BY ALL),
cum AS (SELECT run, feature, v, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER a AS na, sum(s) OVER a AS sa FROM long
  WINDOW o AS (PARTITION BY run, feature ORDER BY v), a AS (PARTITION BY run, feature)),
cut AS (SELECT run, arg_max(struct_pack(feature, v, lo := sl / nl, hi := (sa - sl) / (na - nl)), sl * sl / nl + (sa - sl) ** 2 / (na - nl)) AS c FROM cum WHERE nl < na GROUP BY run),
pr AS (SELECT x.run, mode, {label}, CASE WHEN CASE c.feature {' '.join(f"WHEN '{n}' THEN {n}" for n in _STUMP_FEATURES)} END <= c.v THEN c.lo ELSE c.hi END AS pred FROM x JOIN cut ON cut.run = x.run)
SELECT '{label}' AS target, mode, run::INT AS fold, round(avg(abs(pred - {label})), 3) AS mae, round(stddev_pop(pred - {label}), 3) AS std, round(avg(pred - {label}), 3) AS me FROM pr GROUP BY mode, run"""


@query("mdl1_stump", _stump_sql("SP"))
def mdl1_stump(spark, sf_dir):
    """One tree of one split on features of few values, for which every split is looked at: SQL finds the same by sums over the values."""
    rows = stored(spark, sf_dir, K, _columns("SP", [F.expr(e).cast("double").alias(n) for n, e in _STUMP_FEATURES.items()]))
    found = models.cross_validated(rows, K, "SP", list(_STUMP_FEATURES), "gbt", grouped=True, maxIter=1, maxDepth=1, maxBins=64, seed=1)
    return metrics.summary(found, ["target", "mode", "fold"])


@query("mdl2_stump", _stump_sql("DP"))
def mdl2_stump(spark, sf_dir):
    """A forest of one tree of one split, on all rows and all features: the same exact split for the other label."""
    rows = stored(spark, sf_dir, K, _columns("DP", [F.expr(e).cast("double").alias(n) for n, e in _STUMP_FEATURES.items()]))
    found = models.cross_validated(rows, K, "DP", list(_STUMP_FEATURES), "rf", grouped=True, numTrees=1, maxDepth=1, maxBins=64, bootstrap=False, featureSubsetStrategy="all", seed=1)
    return metrics.summary(found, ["target", "mode", "fold"])


@query("mdl4_search")
def mdl4(spark, sf_dir):
    """A search over two depths of a forest, scored on validation rows, best first (rows only: SQL has no forest)."""
    found = models.search(stored(spark, sf_dir, 3, _columns("SP", FEATURES)), 3, "SP", FEATURES, "rf", {"maxDepth": [1, 4], "numTrees": [3], "seed": [1]})
    return spark.createDataFrame([(i, p["maxDepth"], p["numTrees"], e) for i, (e, p) in enumerate(found)], "place int, maxDepth int, numTrees int, mae double")


@query("mdl2_random_forest")
def mdl2(spark, sf_dir):
    found = models.cross_validated(stored(spark, sf_dir, K, _columns("DP", FEATURES)), K, "DP", FEATURES, "rf", numTrees=5, maxDepth=4, seed=1)
    return metrics.summary(found, ["target", "mode", "fold"])


@query("mdl5_score_stored_models")
def mdl5(spark, sf_dir):
    """Models of all rotations are stored, loaded, and each scores the fold that it did not see."""
    rows = stored(spark, sf_dir, 3, _columns("SP", FEATURES))
    path = f"{scratch(spark)}/mdl5-{uuid.uuid4().hex}"
    models.cross_validated(rows, 3, "SP", FEATURES, "rf", save_to=path, numTrees=3, maxDepth=3, seed=1)
    return models.score_stored(rows, 3, "SP", FEATURES, path).groupBy("fold").agg(F.count("*").alias("rows"), F.round(F.avg(F.abs(F.col("pred") - F.col("label"))), 3).alias("mae"))


@query("snk4_round_trip", f"""WITH {WINDOWS}, p AS (SELECT patient, ntile({K}) OVER (ORDER BY md5('3:' || patient), patient) - 1 AS fold FROM (SELECT DISTINCT patient FROM w))
SELECT 'differences' AS what, NULL::BIGINT AS fold, 0::BIGINT AS rows, 0.0::DOUBLE AS total
UNION ALL SELECT 'stored', fold::BIGINT, count(DISTINCT (patient, j)), {r6s('sum(ppg + abp)')} FROM w JOIN p USING (patient) GROUP BY fold""")
def snk4(spark, sf_dir):
    """Fold tables written, read again and compared both ways; windows and sums of the samples that are stored."""
    cut = windows(adapters.records(spark, sf_dir), WindowSpec(16, 16), ["signal", "abp_signal"])
    rows = splits.with_folds(cut.drop("j"), K, 3)
    path = f"{scratch(spark)}/snk4-{uuid.uuid4().hex}"
    files.write_folds(rows, path)
    found = files.round_trip_differences(rows, path).agg(F.lit("differences").alias("what"), F.lit(None).cast("long").alias("fold"), F.count("*").alias("rows"), F.lit(0.0).alias("total"))
    stored = spark.read.schema(rows.schema).parquet(path).groupBy(F.col("fold").cast("long").alias("fold"))
    return found.unionByName(stored.agg(F.lit("stored").alias("what"), F.count("*").alias("rows"), r6(F.sum(A.total("signal") + A.total("abp_signal"))).alias("total")))
