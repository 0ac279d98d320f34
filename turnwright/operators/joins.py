"""Joins by nearest place, by keys in common, and exclusion of dialogues with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.operators.ordered import BLOCK_ROWS, blocked, running
from turnwright.operators.skew import salted_join


def nearest_place(left: DataFrame, right: DataFrame, on: list[str], left_place: str, right_place: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row of left with the row of right that has the same keys and the nearest place (of two the lower); rows without one are left out.

    Both sides are put in one order by place, in which each row of left sees the last row of right before it and the first behind: no pairs of a
    key are made, and a key with more than block_rows rows is spread. One row of right may serve several of left. Rows with a null key or place
    have no partner. Places are whole numbers; names shared beyond the keys must have been told apart before.
    """
    rest = [c for c in left.columns if c not in on]
    other = [c for c in right.columns if c not in on]
    row, hit = F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in other])
    full = lambda place: " and ".join(f"`{c}` is not null" for c in [*on, place])
    a = left.where(full(left_place)).select(*on, F.col(left_place).cast("bigint").alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    b = right.where(full(right_place)).select(*on, F.col(right_place).cast("bigint").alias("_at"), F.lit(0).alias("_side"), hit.alias("_hit"))
    d, blk = blocked(a.unionByName(b, allowMissingColumns=True), on, ["_at", "_side"], "nearest", block_rows)
    seen = F.when(F.col("_side") == 0, F.struct("_at", "_hit"))
    d = running(d, on, blk, ["_at", "_side"], seen, "last", "_lo")
    d = running(d, on, blk, ["_at", "_side"], seen, "last", "_hi", reverse=True)
    nearer = F.col("_hi._at") - F.col("_at") < F.col("_at") - F.col("_lo._at")
    best = F.when(F.col("_lo").isNull() | nearer, F.col("_hi")).otherwise(F.col("_lo"))
    return d.where("_side = 1").withColumn("_best", best).where("_best is not null").select(*on, "_row.*", "_best._hit.*")


def keys_in_common(*frames: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys that all frames hold."""
    out = frames[0].select(key).where(F.col(key).isNotNull())
    for f in frames[1:]:
        out = out.intersect(f.select(key))
    return out.distinct()


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of a that b lacks."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def exclusion_reasons(calls: DataFrame, key: str, invalid: DataFrame | None = None, registered: DataFrame | None = None, manual: DataFrame | None = None, silent_users: DataFrame | None = None, silent_agents: DataFrame | None = None) -> DataFrame:
    """(key, reason) of each call that is left out.

    invalid: (key, reason) of unusable recordings; registered: keys with a recording, all others are 'no .wav file' and that overrules; manual:
    keys left out by hand, which never overrules; silent_users: keys without user speech, which overrules all; silent_agents: keys without agent
    speech, recorded like the manual ones. Where one key has several reasons the highest rank holds.
    """
    spark = calls.sparkSession
    k = calls.select(key).where(F.col(key).isNotNull()).distinct()
    parts = []
    if invalid is not None:
        parts.append(invalid.join(k, key, "left_semi").select(key, "reason", F.lit(2).alias("rank")))
    if registered is not None:
        parts.append(key_difference(k, registered, key).select(key, F.lit("no .wav file").alias("reason"), F.lit(3).alias("rank")))
    for f, reason, rank in ((manual, "manual exclusion", 1), (silent_users, "silent user", 4), (silent_agents, "silent agent", 0)):
        if f is not None:
            parts.append(f.select(key).distinct().join(k, key, "left_semi").select(key, F.lit(reason).alias("reason"), F.lit(rank).alias("rank")))
    if not parts:
        return spark.createDataFrame([], f"{key} string, reason string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.max_by("reason", F.struct("rank", "reason")).alias("reason"))


def with_files(df: DataFrame, files: DataFrame, key: str, file_key: str, path: str) -> DataFrame:
    """df plus path, the file of its group; null where there is none. Of several files of a group the greatest path counts."""
    one = files.where(F.col(file_key).isNotNull()).groupBy(F.col(file_key).alias("_f")).agg(F.max(path).alias(path))
    return salted_join(df.withColumn("_f", F.col(key)), one, "_f", "left").drop("_f")


def exclude(df: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    return df.join(reasons.select(key), key, "left_anti")


def exclusion_summary(calls: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """One row: calls, calls left out and their share in percent, calls that remain."""
    n = calls.where(F.col(key).isNotNull()).select(key).distinct().join(reasons.select(key, F.lit(1).alias("out")), key, "left")
    return n.agg(F.count(F.lit(1)).alias("n_calls"), F.count("out").alias("n_excluded")).select("n_calls", "n_excluded", (F.col("n_calls") - F.col("n_excluded")).alias("n_left"), F.round(F.coalesce(F.try_divide(F.col("n_excluded") * 100.0, "n_calls"), F.lit(0.0)), 4).alias("percent_excluded"))
