"""Paired permutation tests and Holm's correction."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRIES = 4096
METRICS = ("f1", "recall")


def macro_scores(true: np.ndarray, pred: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Macro F1 and macro recall of counted cells; n is [..., cell], classes are those seen or predicted with a count above zero."""
    classes = np.union1d(true, pred)
    t = np.stack([(n * (true == c)).sum(-1) for c in classes], -1)
    p = np.stack([(n * (pred == c)).sum(-1) for c in classes], -1)
    h = np.stack([(n * ((true == c) & (pred == c))).sum(-1) for c in classes], -1)
    there = (t + p) > 0
    mean = lambda x: (x * there).sum(-1) / np.maximum(there.sum(-1), 1)
    return {"f1": mean(2 * h / np.maximum(t + p, 1)), "recall": mean(h / np.maximum(t, 1))}


def compare(df: DataFrame, true: str, a: str, b: str, tries: int = TRIES, seed: int = 41) -> dict[str, float]:
    """Scores of models a and b and the two-sided p-value of each metric's difference when a fair coin swaps the two predictions of each row.

    Rows are counted by (truth, a, b) in Spark; how many rows of a cell are swapped is then binomial, which is the same test without touching
    rows again. At most classes cubed counts come to the driver.
    """
    cells = df.where(F.col(true).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(true).cast("int").alias("t"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).count()
    c = cells.orderBy("t", "a", "b").toPandas()
    if c.empty:
        return {}
    t, x, y, n = (c[k].to_numpy() for k in ("t", "a", "b", "count"))
    both_t, pred = np.concatenate([t, t]), np.concatenate([x, y])

    def scores(kept: np.ndarray) -> tuple[dict, dict]:
        gone = n - kept
        return macro_scores(both_t, pred, np.concatenate([kept, gone], -1)), macro_scores(both_t, pred, np.concatenate([gone, kept], -1))

    rng = np.random.default_rng(seed)
    sa, sb = scores(n)
    ra, rb = scores(rng.binomial(n, 0.5, size=(tries, len(n))))
    out = {}
    for m in METRICS:
        seen = abs(float(sa[m]) - float(sb[m]))
        hits = int((np.abs(ra[m] - rb[m]) >= seen - 1e-12).sum())
        out |= {f"{m}_a": float(sa[m]), f"{m}_b": float(sb[m]), f"p_{m}": (hits + 1) / (tries + 1)}
    return out


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """df plus p_corrected (step-down, never falling, at most 1) and significant. df is a table of comparisons, a few rows."""
    w = Window.orderBy(p, key)
    m = Window.partitionBy()
    d = df.withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(m))
    d = d.withColumn("_q", (F.col("_m") - F.col("_k") + 1) * F.col(p))
    d = d.withColumn("p_corrected", F.least(F.max("_q").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    return d.withColumn("significant", F.col("p_corrected") <= alpha).drop("_k", "_m", "_q")


def pairwise(df: DataFrame, true: str, models: list[str], tries: int = TRIES, seed: int = 41, alpha: float = 0.05) -> DataFrame | None:
    """All pairs of models, p-values from F1, corrected and sorted by the corrected value; None where there is no pair."""
    rows = []
    for a, b in combinations(models, 2):
        r = compare(df, true, a, b, tries, seed)
        if r:
            rows.append((f"{a} vs {b}", r["f1_a"], r["f1_b"], r["recall_a"], r["recall_b"], r["p_f1"]))
    if not rows:
        return None
    f = pd.DataFrame(rows, columns=["comparison", "f1_model_a", "f1_model_b", "recall_model_a", "recall_model_b", "p_value"])
    return holm(df.sparkSession.createDataFrame(f), "p_value", "comparison", alpha).orderBy("p_corrected", "comparison")
