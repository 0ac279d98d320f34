"""Splits that keep related records together: components, then grouped iterative stratification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.operators.skew import hot_keys, salted_join
from turnwright.session import drop_stage, stage

#: Components that hold at least this share of all rows are placed first and one by one; there are at most 1 / LARGE of them.
LARGE = 1e-3
#: Components that one task places after that.
TOGETHER = 4000


def components(links: DataFrame, node: str, hub: str, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Connected components of the bipartite links (node, hub), both text: (node, component) and (hub, component).

    Nodes with one hub can't join components, so rounds run over the links of the others only. Each round a node takes the smallest component
    among all nodes with which it shares a hub, and then the component of that component, so distances halve; as many rounds run as are needed.
    All other nodes then follow their hub. A component is named by its smallest node. Links with a null end, and repeated ones, change nothing.
    The links of a hot hub, and the nodes of a hot component, are spread over many tasks.
    """
    e = stage(links.select(F.col(node).alias("n"), F.col(hub).alias("h")).where("n is not null and h is not null").distinct(), "p3-links")
    hot_n, hot_h = hot_keys(e, "n"), hot_keys(e, "h")
    several = e.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("n")
    core = stage(salted_join(e, several, "n", hot=hot_n), "p3-core")
    of_hub = _settled(core, hot_n, hot_h, most_rounds)
    e = salted_join(e, of_hub.withColumnRenamed("m", "g"), "h", "left", hot=hot_h)
    e = stage(e.select("n", "h", F.coalesce("g", F.concat(F.lit("\u0000"), "h")).alias("g")), "p3-grouped")  # a hub of its own is no node's name
    names = e.groupBy("g").agg(F.min("n").alias("component"))
    named = lambda c: salted_join(stage(e.groupBy(c).agg(F.min("g").alias("g")), "p3-named"), names, "g")
    return named("n").select(F.col("n").alias(node), "component"), named("h").select(F.col("h").alias(hub), "component")


def _settled(e: DataFrame, hot_n: DataFrame | None, hot_h: DataFrame | None, most_rounds: int) -> DataFrame:
    """(h, m): the smallest node of the component of each hub of the links e."""
    at = stage(e.groupBy("n").agg(F.min("n").alias("c")), "p3-at")
    for _ in range(most_rounds):
        of_hub = salted_join(e, at, "n", hot=hot_n).groupBy("h").agg(F.min("c").alias("m"))
        low = salted_join(e, of_hub, "h", hot=hot_h).groupBy("n").agg(F.min("m").alias("m"))
        near = stage(at.join(low, "n").select("n", F.least("c", "m").alias("c"), F.col("c").alias("was")), "p3-near")
        jump = near.select(F.col("n").alias("c"), F.col("c").alias("cc"))
        now = salted_join(near, jump, "c").select("n", F.col("cc").alias("c"), (F.col("cc") != F.col("was")).alias("moved"))
        now = stage(now, "p3-now")
        drop_stage(near)
        drop_stage(at)
        at = now.select("n", "c")
        if not now.where("moved").limit(1).count():
            return salted_join(e, at, "n", hot=hot_n).groupBy("h").agg(F.min("c").alias("m"))
    raise RuntimeError("components did not settle")


def place(vectors: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Grouped iterative stratification: the split of each row of vectors (label counts); need [split, label] is used up in place.

    Again and again the label with the fewest rows outstanding is taken; components that hold it, most of it first, go to the split that
    needs the largest part of its own share of it. Need is relative, or the largest split would take all components rich in the label and so
    too few components. Splits that the component itself would bring level count as equal: of them the one takes it that needs the largest
    part of its rows, else the first.
    """
    n, labels = vectors.shape
    share = np.maximum(need, 1e-9)
    part = share.sum(1)
    split = np.full(n, -1)
    out = vectors.sum(0).astype(float)
    while True:
        open_ = [j for j in range(labels) if out[j] > 0]
        if not open_:
            break
        j = min(open_, key=lambda x: (out[x], x))
        rows = np.flatnonzero((split < 0) & (vectors[:, j] > 0))
        for i in rows[np.argsort(-vectors[rows, j], kind="stable")]:
            want = need[:, j] / share[:, j]
            best = np.flatnonzero(want + vectors[i, j] / share[:, j] >= want.max())
            s = best[np.argmax(need[best].sum(1) / part[best])]
            split[i] = s
            need[s] -= vectors[i]
            out -= vectors[i]
        out[j] = 0
    split[split < 0] = 0
    return split


def stratify(groups: DataFrame, component: str, labels: list[str], shares: dict[str, float]) -> DataFrame:
    """(component, split): groups has one row per component with its label counts in columns labels.

    Components of at least LARGE of all rows are placed first, on the driver, being few. The others are dealt by hash to tasks of about TOGETHER
    components; each task places its own towards its part of what is still needed, so rounding errors don't add up in one direction.
    """
    names = list(shares)
    p = np.array([shares[s] for s in names], dtype=float)
    p = p / p.sum()
    g = groups.select(F.col(component).alias("c"), *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(f"v{i}") for i, x in enumerate(labels)])
    vs = [f"v{i}" for i in range(len(labels))]
    g = g.withColumn("size", sum((F.col(v) for v in vs), F.lit(0.0)))
    t = g.agg(*[F.sum(v).alias(v) for v in vs], F.count(F.lit(1)).alias("n")).first()
    total = np.array([t[v] or 0.0 for v in vs])
    if not t["n"]:
        return g.select(F.col("c").alias(component), F.lit(None).cast("string").alias("split"))
    least = max(1.0, total.sum() * LARGE)
    big = g.where(F.col("size") >= least).orderBy(F.desc("size"), "c").toPandas()  # at most 1 / LARGE rows
    need = p[:, None] * total[None]
    chosen = place(big[vs].to_numpy(float), need) if len(big) else np.zeros(0, int)
    rest = np.clip(need, 0, None)
    portion = np.where(rest.sum(0) > 0, rest / np.maximum(rest.sum(0), 1e-12), p[:, None])
    buckets = max(1, round(t["n"] / TOGETHER))

    def deal(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c")
        x = f[vs].to_numpy(float)
        s = place(x, portion * x.sum(0)[None])
        return pd.DataFrame({"c": f["c"].to_numpy(), "split": [names[i] for i in s]})

    small = g.where(F.col("size") < least).withColumn("b", F.pmod(F.xxhash64("c"), F.lit(buckets)))
    out = small.groupBy("b").applyInPandas(deal, "c string, split string")
    if len(big):
        spark = groups.sparkSession
        out = out.unionByName(spark.createDataFrame(pd.DataFrame({"c": big["c"].astype(str), "split": [names[i] for i in chosen]}), "c string, split string"))
    return out.select(F.col("c").alias(component), "split")
