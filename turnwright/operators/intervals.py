"""Continuous periods and gaps of overlapping, nested and touching intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwright.operators.ordered import BLOCK_ROWS, blocked, running


def periods_and_gaps(df: DataFrame, entity: str, start_ms: str, end_ms: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge the intervals [start_ms, end_ms] of each entity: rows (entity, span_kind 'period' or 'gap', start_ms, end_ms).

    Intervals are merged by session windows whose gap is each row's own length; an entity with more than block_rows intervals is first cut into
    blocks along their starts. Whether a merged period continues an earlier one is then decided from running values, carried from block to block,
    so a hot entity is never in one task. Touching intervals are continuous; gaps lie between successive periods. Rows with a null entity or time,
    or an end not after the start, are left out; repeated rows change nothing; an empty table gives no rows. Other columns, whatever their names,
    are not read.
    """
    d = df.select(F.col(entity).alias("_e"), F.col(start_ms).cast("bigint").alias("_s"), F.col(end_ms).cast("bigint").alias("_t"))
    d, b = blocked(d.where("_e is not null and _s is not null and _t > _s"), ["_e"], ["_s", "_t"], "p6-rows", block_rows)
    keys = ["_e", *([b] if b else [])]
    length = F.concat((F.col("_t") - F.col("_s")).cast("string"), F.lit(" milliseconds"))
    sessions = d.groupBy(*keys, F.session_window(F.timestamp_millis("_s"), length).alias("_w")).agg(F.min("_s").alias("_s"), F.max("_t").alias("_t")).drop("_w")
    # sessions of an entity, or of one of its blocks, are disjoint or touch; what is left is to join touching ones and those of later blocks
    s = running(sessions, ["_e"], b, ["_s"], F.col("_t"), "max", "_until")
    s = s.withColumn("_new", F.when(F.col("_until").isNull() | (F.col("_s") > F.col("_until")), F.col("_s")))
    s = running(s, ["_e"], b, ["_s"], F.col("_new"), "last", "_first", inclusive=True)
    periods = s.groupBy("_e", "_first").agg(F.max("_t").alias("_t"), *([F.min(b).alias(b)] if b else [])).withColumnRenamed("_first", "_s")
    if b is None:
        nxt = periods.withColumn("_n", F.lead("_s").over(Window.partitionBy("_e").orderBy("_s")))
    else:
        nxt = running(periods, ["_e"], b, ["_s"], F.col("_s"), "last", "_n", reverse=True)
    rows = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("_s").alias("start_ms"), F.col("_t").alias("end_ms")),
        F.struct(F.lit("gap").alias("span_kind"), F.col("_t").alias("start_ms"), F.col("_n").alias("end_ms")),
    )
    out = nxt.select(F.col("_e").alias(entity), F.explode(rows).alias("r")).select(entity, "r.*")
    return out.where("end_ms is not null")
