"""Model queries join their feature rows once: what fits and predictions read is a stored table."""

import pytest

from pulsejobs.catalog import QUERIES
from pulsejobs.operators import models, splits
from pulsejobs.sources import adapters

DATA = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, operator", [("mdl4_search", "search"), ("mdl5_score_stored_models", "cross_validated"), ("mdl2_random_forest", "cross_validated"), ("mdl2_stump", "cross_validated"), ("mdl1_stump", "cross_validated"), ("mdl1_boosted_trees", "cross_validated")])
def test_models_read_stored_rows(spark, monkeypatch, name, operator):
    def look(rows, *_, **__):
        raise Seen(rows._jdf.queryExecution().executedPlan().toString(), rows.count(), rows.select("fold").distinct().count())

    monkeypatch.setattr(models, operator, look)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, DATA)
    plan, rows, folds = found.value.args
    assert "Exchange" not in plan and "Join" not in plan and "FileScan" in plan
    assert rows == adapters.feature_rows(spark, DATA).count() and folds == (3 if name in ("mdl4_search", "mdl5_score_stored_models") else 5)


@pytest.mark.parametrize("name", ["mdl2_random_forest", "mdl2_stump", "mdl4_search"])
def test_folds_are_dealt_from_stored_rows(spark, monkeypatch, name):
    """Patients, their counts and the rows of the folds each read what they are dealt from: no join of orders and line items."""

    def look(rows, *_, **__):
        raise Seen(rows._jdf.queryExecution().executedPlan().toString(), rows.count())

    monkeypatch.setattr(splits, "with_folds", look)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, DATA)
    plan, rows = found.value.args
    assert "Exchange" not in plan and "Join" not in plan and "FileScan" in plan
    assert rows == adapters.feature_rows(spark, DATA).count()
