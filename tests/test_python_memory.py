"""What a Python worker holds: slices of a batch, and one worker a task for all kernels of a query."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsejobs.catalog import QUERIES
from pulsejobs.functions import vec
from pulsejobs.operators import features

DATA = "/root/testdata/sf0.001"


def python_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("EvalPython")


def test_kernels_see_slices_of_a_batch(spark):
    seen = vec.kernel_udf(T.IntegerType())(lambda a: pd.Series([len(a)] * len(a)))
    counts = [r.n for r in spark.range(1000).coalesce(1).select(seen(F.col("id")).alias("n")).collect()]
    assert len(counts) == 1000 and 0 < max(counts) <= 256


def test_median_cycle_in_one_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [rng.normal(size=int(n)).tolist() for n in rng.integers(2, 9, i)]) for i in range(5)] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>").withColumn("n", features.normed_cycles(F.col("c")))
    for r in df.select(features.median_cycle("c", raw=True).alias("a"), features.median_cycle("n").alias("b")).collect():
        assert (r.a is None) == (r.b is None) and (r.a is None or r.a == pytest.approx(r.b))
    assert python_nodes(QUERIES["fea4_median_cycle"](spark, DATA)) == 1


def test_slope_deviation_in_one_kernel(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [rng.normal(size=int(n)).tolist() for n in rng.integers(2, 9, i)]) for i in range(5)] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>").withColumn("n", features.normed_cycles(F.col("c")))
    raw, scaled = ({r.i: r for r in features.slope_deviation(df, c, raw=c == "c").collect()} for c in "cn")
    for i in raw:
        for k, n in (("usdc", 6), ("dsdc", 19)):
            assert raw[i][k] is scaled[i][k] is None if i in (0, 9) else raw[i][k] == pytest.approx(scaled[i][k]) and len(raw[i][k]) == n
    assert python_nodes(QUERIES["fea8_slope_deviation"](spark, DATA)) == 1


def test_window_features_need_one_worker_a_task(spark):
    assert python_nodes(QUERIES["fea_window_features"](spark, DATA)) == 1
