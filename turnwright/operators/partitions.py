"""Train and test by group, folds by group, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.operators.ordered import place


def ranked_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, place, n): distinct groups in an order fixed by the seed, that of a hash."""
    d = df.select(F.col(group).cast("string").alias("g")).where("g is not null").distinct()
    d = place(d.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "g"))), [], ["h", "g"], "place")
    return d.select(F.col("g").alias(group), "place", F.lit(d.count()).cast("bigint").alias("n"))


def group_split(df: DataFrame, group: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(group, part): the first share of the groups is 'train', the rest 'test'."""
    if group not in df.columns:
        raise ValueError(f"no column {group}")
    r = ranked_groups(df, group, seed)
    return r.select(group, F.when(F.col("place") < F.floor(F.col("n") * share), "train").otherwise("test").alias("part"))


def group_folds(df: DataFrame, group: str, folds: int = 10, seed: int = 42) -> DataFrame:
    """(group, fold) from 0: folds differ by one group at most."""
    return ranked_groups(df, group, seed).select(group, F.floor(F.col("place") * folds / F.col("n")).alias("fold"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows over classes times rows of the class; null and negative labels don't count."""
    c = df.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("a"), F.count(F.lit(1)).alias("k")).first()
    return c.select(label, "n", (F.lit(float(t["a"] or 0)) / (F.lit(float(t["k"])) * F.col("n"))).alias("weight"))


def shifted(label: Column) -> Column:
    return label - 1
