"""Fits on grouped rows: the trees of all rows, with every value of a feature as a split."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsejobs.catalog import ORACLE, QUERIES
from pulsejobs.operators import models


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory):
    """200,000 orders of one line item, ten of two: only these have other labels."""
    path = str(tmp_path_factory.mktemp("rare"))
    ids, special = spark.range(200_000), F.col("id") % 20_011 == 7
    price = F.when(special, 7_006_999.0).otherwise((F.col("id") % 1000).cast("double"))
    ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 997).alias("o_custkey"), price.alias("o_totalprice")).write.parquet(f"{path}/orders.parquet")
    lines = ids.select(F.col("id").alias("l_orderkey"), F.lit(10.0).alias("l_quantity"), F.lit(100.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"))
    lines.union(lines.where(F.col("l_orderkey") % 20_011 == 7)).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["mdl1_stump", "mdl2_stump"])
def test_a_stump_splits_at_a_rare_value(spark, rare, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{rare}/{t}.parquet/*.parquet'")
    wanted = {r[:3]: r[3:] for r in db.sql(ORACLE[name]).fetchall()}
    found = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES[name](spark, rare).collect()}
    assert found.keys() == wanted.keys() and len(found) == 15
    for key, errors in wanted.items():
        assert found[key] == pytest.approx(errors, abs=0.0011), key


@pytest.mark.parametrize("kind, params", [("gbt", {"maxIter": 3, "maxDepth": 3}), ("rf", {"numTrees": 1, "maxDepth": 3, "bootstrap": False, "featureSubsetStrategy": "all"})])
def test_grouped_rows_give_the_trees_of_all_rows(spark, kind, params):
    draw = random.Random(3)
    rows = []
    for i in range(900):
        a, b = draw.randrange(7), draw.randrange(5)
        rows.append((i % 45, i, (i % 45) % 3, 90.0 + 9 * a + (25 if b == 2 else 0) + draw.random() * 20, float(a), float(b)))
    table = spark.createDataFrame(rows, "patient int, trial int, fold int, SP double, a double, b double")
    plain, grouped = ({(r.fold, r.trial): r.pred for r in models.cross_validated(table, 3, "SP", ["a", "b"], kind, grouped=g, seed=1, **params).collect()} for g in (False, True))
    assert len(set(grouped.values())) > 10 and grouped == pytest.approx(plain, abs=1e-9)


@pytest.mark.parametrize("kind, params", [("rf", {}), ("gbt", {"subsamplingRate": 0.5}), ("gbt", {"minInstancesPerNode": 4}), ("gbt", {"lossType": "absolute"})])
def test_grouped_rows_are_not_drawn(spark, kind, params):
    with pytest.raises(ValueError, match="grouped"):
        models.cross_validated(spark.range(1), 3, "SP", ["id"], kind, grouped=True, **params)
