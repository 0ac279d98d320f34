"""Search over parameter grids with folds by group, and evaluation of the chosen model, on Spark's own classifiers.

The model is multinomial logistic regression, weighted by class; its place is that of any estimator with the same columns (see fit_with).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.operators.metrics import report_averages
from turnwright.operators.partitions import class_weights, group_folds
from turnwright.session import stage

#: Makes an unfitted estimator (columns features, label, weight; adds prediction) from the parameters of one combination.
Maker = Callable[[dict], object]


def logistic(parameters: dict) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="prediction", maxIter=30, **parameters)


def samples(df: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """(group, features, label): rows that have a group and a label; a missing feature counts as 0."""
    vector = array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]))
    return df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).select(F.col(group).alias("group"), vector.alias("features"), F.col(label).cast("double").alias("label"))


def fit_with(train: DataFrame, make: Maker, parameters: dict):
    """An estimator fitted to samples, each class weighing the same."""
    w = class_weights(train, "label").select("label", "weight")  # a row per class
    return make(parameters).fit(train.join(F.broadcast(w), "label"))


def scores(model, test: DataFrame) -> dict[str, float]:
    r = report_averages(model.transform(test), "label", "prediction").first()
    return {"macro_recall": r["macro_recall"] or 0.0, "macro_f1": r["macro_f1"] or 0.0}


def grid_search(df: DataFrame, features: list[str], label: str, group: str, grid: dict[str, list], folds: int = 10, seed: int = 42, make: Maker = logistic) -> DataFrame:
    """A row per combination of the grid, best macro_f1 first: its parameters, and macro_recall and macro_f1 averaged over folds that keep groups whole."""
    d = samples(df, features, label, group)
    d = stage(d.join(group_folds(d, "group", folds, seed), "group"), "folds")
    found = []
    for values in product(*grid.values()):
        parameters = dict(zip(grid, values, strict=True))
        each = []
        for k in range(folds):
            test = d.where(F.col("fold") == k)
            if test.limit(1).count():
                each.append(scores(fit_with(d.where(F.col("fold") != k), make, parameters), test))
        mean = {m: sum(x[m] for x in each) / max(len(each), 1) for m in ("macro_recall", "macro_f1")}
        found.append((*[float(v) for v in values], mean["macro_recall"], mean["macro_f1"]))
    schema = ", ".join(f"{n} double" for n in (*grid, "macro_recall", "macro_f1"))
    return df.sparkSession.createDataFrame(found, schema).orderBy(F.desc("macro_f1"), *grid)


def final_evaluation(train: DataFrame, test: DataFrame, features: list[str], label: str, group: str, parameters: dict, make: Maker = logistic) -> tuple[DataFrame, dict[str, float]]:
    """(group, label, prediction) of the test rows, and the scores, number of parameters and mean seconds a row that predicting took."""
    t = stage(samples(test, features, label, group), "test")
    model = fit_with(samples(train, features, label, group), make, parameters)
    began = time.time()
    told = stage(model.transform(t).select("group", "label", "prediction"), "told")
    took, n = time.time() - began, told.count()
    size = model.coefficientMatrix.numRows * (model.coefficientMatrix.numCols + 1) if hasattr(model, "coefficientMatrix") else None
    r = report_averages(told, "label", "prediction").first()
    return told, {"macro_recall": r["macro_recall"] or 0.0, "macro_f1": r["macro_f1"] or 0.0, "n_parameters": size, "seconds_per_row": took / max(n, 1)}
