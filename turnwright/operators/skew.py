"""Joins in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.session import stage

#: At most so many keys are hot: each holds more than 1 / MOST_HOT of the rows.
MOST_HOT = 20_000


def hot_keys(big: DataFrame, on: str, hot_rows: int = 200_000) -> DataFrame | None:
    """(_k, _salts) of the keys of big, null too, with more than hot_rows rows, or more than 1 / MOST_HOT of all rows if that is more; else None."""
    counts = big.groupBy(F.col(on).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) <= hot_rows:
        return None
    rows = max(hot_rows, -(-total // MOST_HOT))
    return stage(counts.where(F.col("_n") > rows).select("_k", F.ceil(F.col("_n") / rows).cast("int").alias("_salts")), "hot")


def salted_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", hot_rows: int = 200_000, hot: DataFrame | None | bool = True) -> DataFrame:
    """Join big to small, whose rows per key are few, so that a hot key of big is spread over many tasks.

    A hot key, see hot_keys, gets one salt for each hot_rows of its rows: its rows of small are repeated once per salt, and each of its rows of big
    gets the salt of a hash of the row, which a repeated task computes again. Null keys match nothing; with how='left' they stay, and if they are
    many they are spread too. Without hot keys this is a plain join. big is read once for its hot keys, unless they are given, and once for its
    rows, so it should be a stored table.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = hot_keys(big, on, hot_rows) if hot is True else hot
    if hot is None:
        return big.join(small, on, how)
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    wide = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = small.join(hot, small[on] == hot["_k"], "left").withColumn("_salt", F.explode(wide)).drop("_k", "_salts")
    cols = [F.col(f"`{c}`") for c, t in big.dtypes if "map<" not in t]
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*cols), F.col("_salts")).cast("int")).otherwise(0)
    left = big.join(hot, big[on].eqNullSafe(hot["_k"]), "left").withColumn("_salt", salt).drop("_k", "_salts")
    return left.join(right, [on, "_salt"], how).drop("_salt")
