"""Scores of predictions and summaries of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnwright.operators.ordered import BLOCK_ROWS, blocked, place, running
from turnwright.operators.skew import salted_join


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(y_true, y_pred, n) of rows that have both."""
    return df.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(true).cast("int").alias("y_true"), F.col(predicted).cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) for each class seen or predicted; a score without a value is 0."""
    c = confusion(df, true, predicted)
    hit = F.col("y_true") == F.col("y_pred")
    side = c.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(hit, F.col("n")).otherwise(0).alias("h")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")))).alias("x")).select("x.*")
    g = side.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.select("label", z(F.col("h"), F.col("p")).alias("precision"), z(F.col("h"), F.col("t")).alias("recall"), z(2 * F.col("h"), F.col("t") + F.col("p")).alias("f1"), F.col("t").alias("support"))


def report_averages(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro and support-weighted averages."""
    r = class_report(df, true, predicted)
    s = F.sum("support")
    w = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), s), F.lit(0.0))
    return r.agg(w("recall").alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), w("precision").alias("weighted_precision"), w("f1").alias("weighted_f1"), s.alias("support"))


def describe(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(by,) column_name, count, mean, std (sample), min, q25, q50, q75 (linear), max of numbers; nulls don't count. by must not be null."""
    part = [by] if by else []
    one = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(*part, F.explode(one).alias("x")).select(*part, "x.*").where("v is not null")
    m = long.groupBy(*part, "column_name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, [*part, "column_name"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return m.join(q, [*part, "column_name"]).select(*part, "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def quantiles(df: DataFrame, part: list[str], value: str, shares: dict[str, float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation of each part: (part, one column for each share).

    Equal values are counted first; their places come from running counts, in blocks where a part has many distinct values, so neither a large
    part nor many distinct values end up in one task.
    """
    n = df.groupBy(*part, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    n, b = blocked(n, part, ["_v"], "counts", block_rows)
    d = running(n, part, b, ["_v"], F.col("_n"), "sum", "_before")
    if b is None:
        d = d.withColumn("_t", F.sum("_n").over(Window.partitionBy(*part)))
    else:  # one number a part
        total = n.groupBy(*part).agg(F.sum("_n").alias("_t"))
        d = d.join(total, part) if part else d.withColumn("_t", F.lit(total.first()[0]))
    at, out = {}, []
    for name, s in shares.items():
        h = (F.col("_t") - 1) * s
        for side, place in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            at[f"_{side}_{name}"] = F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))
        at[f"_w_{name}"] = F.max(h - F.floor(h))
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name))
    return d.groupBy(*part).agg(*[c.alias(k) for k, c in at.items()]).select(*part, *out)


def describe_texts(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, column_name, count, n_unique, top, freq): the commonest value, of several the first in order."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("x")).select(by, "x.*").where("v is not null")
    n = long.groupBy(by, "column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by, "column_name").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_unique"), F.min_by("v", F.struct(-F.col("n"), "v")).alias("top"), F.max("n").alias("freq"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """All rows that occur more than once, as often as they occur."""
    c = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return c.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_k")


def top_n(df: DataFrame, by: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n rows of each group with the largest value (of equals the smaller tie), with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Result tables one under the other; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filtered(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values given; a value of None asks nothing. A column that isn't there is an error."""
    for c, v in values.items():
        if v is not None:
            df = df.where(F.col(f"`{c}`") == F.lit(v))
    return df


def median_run(df: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """Of the runs of each group the one in the middle by score (of an even number the upper). Groups, scores and ties are not null."""
    d = place(df.where(F.col(by).isNotNull()).select(by, score, tie), [by], [score, tie], "_k")
    n = d.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return salted_join(d, n, by).where(F.col("_k") == F.floor(F.col("_n") / 2)).drop("_k", "_n")


def labels_agree(a: DataFrame, b: DataFrame) -> bool:
    """True where two label tables hold the same rows equally often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def parameter_grid(spark, values: dict[str, list]) -> DataFrame:
    """Every combination of a few listed values; its size is the product of the lists, known beforehand."""
    from itertools import product

    names = list(values)
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    schema = T.StructType([T.StructField(n, kinds[type(values[n][0])]) for n in names])
    return spark.createDataFrame(list(product(*values.values())), schema)
