"""Tree models on feature tables, one for each rotation; every fit and every prediction is a Spark job."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .metrics import summary
from .scaling import from_range, min_max, run_extremes, to_range

ESTIMATORS = {"gbt": GBTRegressor, "rf": RandomForestRegressor}


def pipeline(kind: str, features: list[str], **params) -> Pipeline:
    """Assembler (missing values go on as NaN) and a tree ensemble."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model {kind}; known: {', '.join(ESTIMATORS)}")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), ESTIMATORS[kind](featuresCol="_x", labelCol="_y", predictionCol="_p", **params)])


def mode_of(run: int, k: int) -> Column:
    """Which part a row's fold has in a rotation."""
    return F.when(F.col("fold") == run, "ts").when(F.col("fold") == (run + 1) % k, "val").otherwise("tr")


def scaled_for(rows: DataFrame, fit: Row, features: list[str]) -> DataFrame:
    """Features scaled by the extremes of a rotation, which are constants here."""
    return rows.withColumns({c: min_max(c, F.lit(fit[f"_lo_{c}"]), F.lit(fit[f"_hi_{c}"])) for c in features})


def cross_validated(folded: DataFrame, k: int, target: str, features: list[str], kind: str = "gbt", first_only: bool = False, save_to: str | None = None, grouped: bool = False, **params) -> DataFrame:
    """Long prediction table (fold, mode, target, patient, trial, pred, label, naive).

    Each rotation scales the features by its train rows, fits on these, and
    predicts train, validation and test rows. Labels are fitted in their fixed
    range and turned back. ``save_to`` keeps the model of each rotation.
    Extremes and label sums come once by fold (k rows); a fit reads the rows of
    its train folds only, which a table partitioned by fold finds by folder.
    ``grouped`` is for features of few values: rows of equal features are one
    row of a fit, with their number as weight and their mean label. Squared
    errors differ by the same constant for every split, so the trees are those
    of all rows (not with bootstrap or subsamples, which draw rows), and fits
    see every value where Spark would look for splits in a sample of rows.
    """
    if grouped and (kind == "rf" and params.get("bootstrap", True) or any(params.get(p, v) != v for p, v in (("subsamplingRate", 1.0), ("minInstancesPerNode", 1), ("lossType", "squared")))):
        raise ValueError("grouped rows are not drawn or counted one by one, and have squared errors only")
    source = folded.groupBy("fold", *features).agg(F.sum(target).alias("_s"), F.count(target).alias("_n")).persist() if grouped else folded
    label_sum, label_count = ("_s", F.sum("_n")) if grouped else (target, F.count(target))
    fits = {r["run"]: r for r in run_extremes(source, k, features, first_only).collect()}
    sums = source.groupBy("fold").agg(F.sum(label_sum).alias("s"), label_count.alias("n")).collect()
    out = None
    for run in range(1 if first_only else k):
        if run not in fits:  # no train rows
            continue
        rows = scaled_for(folded, fits[run], features).withColumns({"_y": to_range(F.col(target), target), "mode": mode_of(run, k)})
        if grouped:
            held = source.where(~F.col("fold").isin(run, (run + 1) % k)).groupBy(*features).agg((F.sum("_s") / F.sum("_n")).alias("_m"), F.sum("_n").cast("double").alias("_w")).where("_w > 0")
            held = scaled_for(held, fits[run], features).select(to_range(F.col("_m"), target).alias("_y"), "_w", *features).persist()
        else:
            held = rows.where(~F.col("fold").isin(run, (run + 1) % k)).select("_y", *features).persist()  # a fit reads its rows many times
        model = pipeline(kind, features, **params, **({"weightCol": "_w"} if grouped else {})).fit(held)
        held.unpersist()
        if save_to:
            model.write().overwrite().save(f"{save_to}/fold={run}")
        train = [r for r in sums if r["fold"] not in (run, (run + 1) % k)]
        naive = sum(r["s"] or 0.0 for r in train) / max(1, sum(r["n"] for r in train))
        found = model.transform(rows).select(F.lit(run).alias("fold"), "mode", F.lit(target).alias("target"), "patient", "trial", from_range(F.col("_p"), target).alias("pred"), F.col(target).alias("label"), F.lit(naive).alias("naive"))
        out = found if out is None else out.unionByName(found)
    if grouped:
        source.unpersist()
    return out


def score_stored(folded: DataFrame, k: int, target: str, features: list[str], saved: str) -> DataFrame:
    """Each fold predicted by the stored model that did not see it."""
    fits = {r["run"]: r for r in run_extremes(folded, k, features).collect()}
    out = None
    for run in sorted(fits):
        rows = scaled_for(folded.where(F.col("fold") == run), fits[run], features)
        found = PipelineModel.load(f"{saved}/fold={run}").transform(rows).select(F.lit(run).alias("fold"), "patient", "trial", from_range(F.col("_p"), target).alias("pred"), F.col(target).alias("label"))
        out = found if out is None else out.unionByName(found)
    return out


def search(folded: DataFrame, k: int, target: str, features: list[str], kind: str, grid: dict[str, list], scored_on: str = "val") -> list[tuple[float, dict]]:
    """Parameter sets with their pooled error, best first. Scored on validation rows; ``ts`` scores on test rows."""
    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        errors = summary(cross_validated(folded, k, target, features, kind, **params).where(F.col("mode") == scored_on), ["target"])
        out.append((errors.first().mae, params))
    return sorted(out, key=lambda x: x[0])
