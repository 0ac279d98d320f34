"""Sinks, and stages that are skipped if their output is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwright.functions.text import pca_tag


def write_table(df: DataFrame, path: str, parts: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*parts) if parts else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def user_sheet(df: DataFrame, *keys: str) -> DataFrame:
    """User transcript for checking by hand: times with two decimals, behind the key columns named."""
    two = lambda c: F.round(F.col(c).cast("decimal(18,6)"), 2).cast("string")
    return df.select(*keys, "CallID", "Speaker", F.when(F.col("StartTime").isNotNull(), two("StartTime")).alias("StartTime"), F.when(F.col("EndTime").isNotNull(), two("EndTime")).alias("EndTime"), "Transcript")


def rttm_line(code: Column, start: Column, end: Column) -> Column:
    return F.format_string("SPEAKER %s 1 %.5f %.5f <NA> <NA> 1.0 <NA>", code, start, end - start)


def write_rttm(df: DataFrame, path: str) -> None:
    df.select(rttm_line(F.col("filecode"), F.col("start"), F.col("end")).alias("value")).write.mode("overwrite").text(path)


def unmatched_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, texts): what found no partner, by call."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(text)).alias("texts"))


def write_unmatched(df: DataFrame, key: str, text: str, path: str) -> None:
    """unmatched_json() as JSON lines, an object for each call."""
    unmatched_json(df, key, text).write.mode("overwrite").json(path)


def result_name(split: str, dataset: str, **shares: float | None) -> str:
    """The name of a table of a split and dataset: each share of variance follows its kind tenfold, none as nothing, as in
    train_speech_text8_wav.parquet."""
    return "_".join([split, dataset, *[f"{k}{pca_tag(v)}" for k, v in shares.items()]]) + ".parquet"


def only_calls(df: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    return df.join(calls.select(key).distinct(), key, "left_semi")


def report_text(reasons: DataFrame, key: str, n_calls: int) -> DataFrame:
    """Lines 'id: reason' and a last line with count and share."""
    lines = reasons.select(F.concat_ws(": ", key, "reason").alias("value"))
    last = reasons.agg(F.format_string("excluded %d of %d (%.2f%%)", F.count(F.lit(1)), F.lit(n_calls), F.count(F.lit(1)) * 100.0 / max(n_calls, 1)).alias("value"))
    return lines.unionByName(last)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p.suffix("/_SUCCESS"))


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, made and written first if it isn't complete or force is set."""
    if force or not exists(spark, path):
        write_table(make(), path)
    return spark.read.parquet(path)
