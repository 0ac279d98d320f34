"""Queries of the general data-preparation problems over the bus line's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwright.functions.ids import call_id, millis, seconds
from turnwright.operators.intervals import periods_and_gaps
from turnwright.operators.nested import NestedTables
from turnwright.operators.propagation import apply_fills, propagate
from turnwright.operators.references import apply_deltas, current_orphans, existence_deltas, orphan_report, orphans, reference_deltas
from turnwright.plans import sqltext as S


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "system_features_full").withColumns({"CallID": call_id(F.col("CallID")), "DD": seconds(F.col("DD"))})


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return propagate(_log(spark, d), "log_id", "logged_at", "CallID", "DD", "exchange_no")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d).select("log_id", "field_name")


def p1_fills(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d)


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return apply_fills(_log(spark, d), _fills(spark, d), "log_id", "CallID", "DD")


def _parses(spark: SparkSession, d: str) -> NestedTables:
    return NestedTables(table(spark, d, "system_features_full"), "log_id", "SemanticParse")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _parses(spark, d).occurrences(last_use=True).withColumnRenamed("row_id", "log_id")


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return _parses(spark, d).objects.select(F.hex("hash").alias("object_id"), "name", "value", "conf", "height", F.size("children").alias("n_children"))


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    b = _parses(spark, d).bridge
    return b.select(F.hex("parent_hash").alias("parent_id"), "ordinal", F.hex("child_hash").alias("child_id"), "child_name")


# The tables whose CallID refers to the register, their keys and times.
REFERRING = {"system_features_full": ("log_id", "logged_at"), "validated_user_transcript": ("utt_id", "transcribed_at"), "validated_agent_transcript": ("turn_id", "transcribed_at")}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = None
    for name, (key, at) in REFERRING.items():
        t = table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), call_id(F.col("CallID")).alias("call"), F.col(at).alias("at"))
        refs = t if refs is None else refs.unionByName(t)
    found = orphans(refs, table(spark, d, "audio_inventory"), "call", "at", "filecode", "registered_at", "deleted_at")
    return found.dropDuplicates(["table_name", "row_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "orphan_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), "table_name", "at")


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    """The current report: keys that are referred to but don't exist after all changes, with their counts."""
    deltas = [reference_deltas(table(spark, d, name).dropDuplicates([key]).select(call_id(F.col("CallID")).alias("call")), "call") for name, (key, _) in REFERRING.items()]
    exist = existence_deltas(table(spark, d, "audio_inventory"), "filecode", "registered_at", "deleted_at").select("key", F.lit(0).alias("d_ref"), "d_exist")
    return current_orphans(apply_deltas(None, *deltas, exist)).withColumnRenamed("key", "call_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "validated_user_transcript")
    t = t.select(call_id(F.col("CallID")).alias("call_id"), millis(F.col("StartTime")).alias("s"), millis(F.col("EndTime")).alias("t"))
    return periods_and_gaps(t, "call_id", "s", "t")


QUERIES = {f.__name__: f for f in (p1_found, p1_fills, p1_filled, p4_found, p4_objects, p4_bridge, p5_found, p5_report, p5_state, p6_found)}

_refs = " union all ".join(f"select '{t}' as table_name, {k} as row_id, {S.cid('CallID')} as c, {at} as ts from (select distinct on ({k}) * from {t})" for t, (k, at) in REFERRING.items())
_spans = f"(select {S.cid('CallID')} as c, {S.MS('StartTime')} as s, {S.MS('EndTime')} as t from validated_user_transcript)"

_orphaned = f"""select table_name, row_id, ts, case when c not in (select filecode from audio_inventory where filecode is not null) then 'missing'
 when exists (select 1 from audio_inventory where filecode = c and registered_at <= ts) then 'deleted' else 'late' end as orphan_kind from ({_refs}) r
 where c is not null and not exists (select 1 from audio_inventory where filecode = c and registered_at <= ts and (deleted_at is null or ts < deleted_at))"""
_lives = "registered_at is not null and (deleted_at is null or deleted_at > registered_at)"

SQL: dict[str, str] = {
    "p5_report": f"select table_name, date_trunc('day', ts)::timestamp as period, orphan_kind, count(*) as n_orphans from ({_orphaned}) group by all",
    "p5_state": f"""select c as call_id, cast(sum(n) as bigint) as n_ref, cast(sum(e) as bigint) as n_exist from (select c, 1 as n, 0 as e from ({_refs}) where c is not null
 union all select filecode, 0, case when {_lives} then 1 else 0 end - case when {_lives} and deleted_at is not null then 1 else 0 end from audio_inventory where filecode is not null) group by c having sum(n) > 0 and sum(e) <= 0""",
    "p1_found": f"select log_id, 'CallID' as field_name from {S.LOG} where {S.cid('CallID')} is null union all select log_id, 'DD' from {S.LOG} where {S.secs('DD')} is null",
    "p5_found": f"select table_name, row_id, orphan_kind from ({_orphaned})",
    "p6_found": f"""with i as (select * from {_spans} where c is not null and t > s), m as (select *, max(t) over (partition by c order by s, t rows between unbounded preceding and 1 preceding) as u from i),
 g as (select *, count(*) filter (where u is null or s > u) over (partition by c order by s, t rows unbounded preceding) as k from m), p as (select c, k, min(s) as s, max(t) as t from g group by c, k),
 n as (select *, lead(s) over (partition by c order by s) as f from p)
 select c as call_id, 'period' as span_kind, s as start_ms, t as end_ms from n union all select c, 'gap', t, f from n where f is not null""",
}
