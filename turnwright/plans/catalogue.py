"""Queries over the bus line's tables, one per operator, each with SQL that computes the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwright.functions import text as X
from turnwright.functions import words as W
from turnwright.functions.ids import call_id, present, usable
from turnwright.operators import align, cleaning, evaluation, exchange, features, joins, metrics, partitions, signal, stats
from turnwright.operators.ordered import fill_ordered, place
from turnwright.plans import sqltext as S
from turnwright.session import stage
from turnwright.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The log with the columns named, each row once."""
    return table(spark, d, "system_features_full").select("log_id", *columns).dropDuplicates(["log_id"])


def agent(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "validated_agent_transcript").drop("transcribed_at").dropDuplicates(["turn_id"])
    return t.withColumn("CallID", call_id(F.col("CallID"))).withColumnRenamed("turn_id", "ord")


def user(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "validated_user_transcript").drop("transcribed_at").dropDuplicates(["utt_id"])
    return t.withColumn("CallID", call_id(F.col("CallID"))).withColumnRenamed("utt_id", "ord")


# ---- cleaning

LOG_TEXTS = ["Prompt", "Utterance", "ASRRecognitionStatus", "Modality", "Activity", "ActivityType", "ExMo", "RoleName", "LoopName"]
_remap = lambda c, m: f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in m.items()) + f" else {c} end"


@query(f"""select log_id, {_remap(f"(case when {S.tidy('ASRRecognitionStatus')} = '' then 'no status' else {S.tidy('ASRRecognitionStatus')} end)", cleaning.STATUS)} as ASRRecognitionStatus,
 {_remap(S.tidy("Modality"), cleaning.MODALITY)} as Modality,
 case when starts_with({S.tidy("Activity")}, '{cleaning.ACTIVITY_PREFIX}') then {S.tidy("Activity")}[{len(cleaning.ACTIVITY_PREFIX) + 1}:] else {S.tidy("Activity")} end as Activity from {S.LOG}""")
def clean_categories(spark, d):
    return cleaning.clean_categories(log(spark, d, "ASRRecognitionStatus", "Modality", "Activity"))


@query(f"select log_id, {S.num('DD')} as DD from {S.LOG}")
def numeric_coerce(spark, d):
    return log(spark, d, "DD").withColumn("DD", cleaning.number(F.col("DD")))


@query(f"select log_id, {S.cid('CallID')} as CallID from {S.LOG}")
def id_normalise(spark, d):
    return log(spark, d, "CallID").withColumn("CallID", call_id(F.col("CallID")))


@query(f"select log_id, substr(CallID, 1, 2) || '0' || substr(CallID, 3) as repaired, regexp_replace({S.tidy('CallID')}, '\\.0$', '') as plain from {S.LOG}")
def id_repair(spark, d):
    return log(spark, d, "CallID").select("log_id", cleaning.repair_id(F.col("CallID")).alias("repaired"), cleaning.plain_id(F.col("CallID")).alias("plain"))


_vocab = ", ".join("'" + v + "'" for v in cleaning.VOCABULARY)
_filled = ", ".join(f"coalesce(case when {c} not in ({_vocab}) then {c} end, '{'' if c == 'Utterance' else 'missing'}') as {c}" for c in LOG_TEXTS)


@query(f"select log_id, {_filled}, case when not isnan(ASRConfidence) then ASRConfidence end as ASRConfidence from {S.LOG}")
def null_vocabulary_fill(spark, d):
    t = cleaning.apply_vocabulary(log(spark, d, *LOG_TEXTS, "ASRConfidence"))
    return cleaning.fill_texts(t, {"Utterance": ""})


_numbered = f"(select log_id, {S.cid('CallID')} as c, {S.num('DD')} as x from {S.LOG})"


def _dd(spark, d):
    return log(spark, d, "CallID", "DD").select("log_id", call_id(F.col("CallID")).alias("CallID"), cleaning.number(F.col("DD")).alias("x"))


@query(f"select log_id, last_value(x ignore nulls) over (partition by coalesce(c, 'row' || log_id) order by log_id) as filled from {_numbered}")
def grouped_ffill(spark, d):
    return fill_ordered(_dd(spark, d), "log_id", "x", "filled", group="CallID").select("log_id", "filled")


@query(f"select log_id, first_value(f ignore nulls) over (order by log_id rows between current row and unbounded following) as filled from (select log_id, last_value(x ignore nulls) over (partition by coalesce(c, 'row' || log_id) order by log_id) as f from {_numbered})")
def global_bfill(spark, d):
    t = fill_ordered(_dd(spark, d), "log_id", "x", "f", group="CallID").select("log_id", "f")
    return fill_ordered(t, "log_id", "f", "filled", forward=False).select("log_id", "filled")


@query(f"select turn_id, last_value({S.cid('CallID')} ignore nulls) over (order by turn_id) as CallID from {S.AGENT}")
def global_ffill(spark, d):
    t = agent(spark, d).select("ord", "CallID")
    return fill_ordered(t, "ord", "CallID", "filled").select(F.col("ord").alias("turn_id"), F.col("filled").alias("CallID"))


ALL_TEXTS = ["CallID", "Prompt", "Utterance", "SemanticParse", "DD", "ASRRecognitionStatus", "Modality", "Activity", "ActivityType", "ExMo", "RoleName", "LoopName"]
ALL_COLUMNS = ["log_id", "logged_at", "received_at", "exchange_no", *ALL_TEXTS, "ASRConfidence", "MeanASRConfidence", "IQRater1", "IQRater2", "IQRater3", "IQMedian"]
_every = f"with l as materialized {S.LOG} "


@query(_every + " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as n_null from l" for c in ALL_COLUMNS) + f" union all select '*any*', count(*) filter (where {' or '.join(f'{c} is null' for c in ALL_COLUMNS)}) from l")
def null_profile(spark, d):
    return cleaning.null_profile(table(spark, d, "system_features_full").dropDuplicates(["log_id"]))


_hot = {"RoleName": ["confirm", "inform"], "ExMo": ["initial", "normal", "repeat"]}


@query(f"select log_id, {', '.join(f'''coalesce({c} = '{v}', false) as {c}_{v}''' for c, vs in _hot.items() for v in vs)} from {S.LOG}")
def one_hot_drop_first(spark, d):
    return cleaning.one_hot(log(spark, d, "RoleName", "ExMo"), ["RoleName", "ExMo"])


KEYS = ("request", "place", "time", "route", "confirm")


@query(f"select log_id, {', '.join(f'''coalesce(regexp_matches(SemanticParse, '(?i)\\b{k}\\b'), false) as {k}_present''' for k in KEYS)} from {S.LOG}")
def keyword_flags(spark, d):
    return log(spark, d, "SemanticParse").select("log_id", *[X.has_word(F.col("SemanticParse"), k).alias(f"{k}_present") for k in KEYS])


@query(f"select log_id, {S.first_key('SemanticParse')} as first_key from {S.LOG}")
def semantic_first_key(spark, d):
    return log(spark, d, "SemanticParse").select("log_id", X.first_key(F.col("SemanticParse")).alias("first_key"))


@query()
def semantic_counts(spark, d):
    return log(spark, d, "SemanticParse").select("log_id", X.semantic_counts(F.col("SemanticParse")).alias("counts"))


@query("select l_orderkey, l_linenumber, l_extendedprice, l_discount from lineitem")
def column_algebra(spark, d):
    return cleaning.drop_columns(table(spark, d, "lineitem"), exact=["L_TAX", "L_Quantity"], keywords=["date", "status", "flag"], pattern="part|supp")


@query(_every + " union all ".join(f"select '{c}' as column_name, count(*) as n, count(distinct {c}) as n_distinct, count(distinct {c}) / count(*)::double < 0.5 as as_category from l" for c in ALL_TEXTS))
def type_report(spark, d):
    return cleaning.type_report(table(spark, d, "system_features_full").dropDuplicates(["log_id"]))


@query(f"select log_id, cast(cast(ASRConfidence as float) as double) as ASRConfidence from {S.LOG} where not isnan(ASRConfidence)")
def numeric_narrowing(spark, d):
    return log(spark, d, "ASRConfidence").where(usable(F.col("ASRConfidence")).isNotNull()).select("log_id", cleaning.single_precision(F.col("ASRConfidence")).alias("ASRConfidence"))


# ---- keys, exclusion, nearest place

_calls = lambda t: f"(select distinct {S.cid('CallID')} as c from {t} where {S.cid('CallID')} is not null)"


def _keys(spark, d, name):
    return table(spark, d, name).select(call_id(F.col("CallID")).alias("CallID")).where("CallID is not null").distinct()


@query(f"select c as CallID from {_calls('system_features_full')} intersect select c from {_calls('validated_agent_transcript')} intersect select c from {_calls('validated_user_transcript')}")
def common_keys(spark, d):
    return joins.keys_in_common(*[_keys(spark, d, n) for n in ("system_features_full", "validated_agent_transcript", "validated_user_transcript")], key="CallID")


@query(f"select c as CallID from {_calls('system_features_full')} except select filecode from audio_inventory")
def key_difference(spark, d):
    return joins.key_difference(_keys(spark, d, "system_features_full"), table(spark, d, "audio_inventory").select(F.col("filecode").alias("CallID")), "CallID")


_reasons = f"""(with k as {_calls('system_features_full')}, r as (
 select c, 'missing path' as reason, 2 as rank from k join (select distinct filecode from audio_inventory where dyad_path is null or user_path is null) on filecode = c
 union all select c, 'no .wav file', 3 from k where c not in (select filecode from audio_inventory where filecode is not null)
 union all select c, 'manual exclusion', 1 from k where c like '%7'
 union all select c, 'silent user', 4 from k where c not in (select c from {_calls('validated_user_transcript')})
 union all select c, 'silent agent', 0 from k where c not in (select c from {_calls('validated_agent_transcript')}))
 select c as CallID, arg_max(reason, rank) as reason from r group by c)"""


def _excluded(spark, d):
    k = _keys(spark, d, "system_features_full")
    reg = table(spark, d, "audio_inventory").select(F.col("filecode").alias("CallID"), "dyad_path", "user_path")
    bad = reg.where("dyad_path is null or user_path is null").select("CallID", F.lit("missing path").alias("reason")).distinct()
    no_user = joins.key_difference(k, _keys(spark, d, "validated_user_transcript"), "CallID")
    no_agent = joins.key_difference(k, _keys(spark, d, "validated_agent_transcript"), "CallID")
    return k, joins.exclusion_reasons(k, "CallID", bad, reg, k.where("CallID like '%7'"), no_user, no_agent)


@query(f"select * from {_reasons}")
def exclusion_audit(spark, d):
    return _excluded(spark, d)[1]


@query(f"select log_id, {S.cid('CallID')} as CallID from {S.LOG} where {S.cid('CallID')} not in (select CallID from {_reasons})")
def dialogue_exclusion(spark, d):
    t = log(spark, d, "CallID").select("log_id", call_id(F.col("CallID")).alias("CallID")).where("CallID is not null")
    return joins.exclude(t, _excluded(spark, d)[1], "CallID")


@query(f"select n_calls, n_excluded, n_calls - n_excluded as n_left, round(n_excluded * 100.0::double / n_calls, 4) as percent_excluded from (select (select count(*) from {_calls('system_features_full')}) as n_calls, (select count(*) from {_reasons}) as n_excluded)")
def exclusion_summary(spark, d):
    k, r = _excluded(spark, d)
    return joins.exclusion_summary(k, r, "CallID")


_pa = f"(select turn_id, {S.cid('CallID')} as c, {S.prompt('AgentPrompt')} as p, IQMedian as q, row_number() over (partition by {S.cid('CallID')} order by turn_id) - 1 as n from {S.AGENT} where {S.cid('CallID')} is not null)"
_pl = f"(select log_id, {S.cid('CallID')} as c, {S.prompt('Prompt')} as p, IQMedian as q, row_number() over (partition by {S.cid('CallID')} order by log_id) - 1 as n from {S.LOG} where {S.cid('CallID')} is not null)"


@query(f"select a.turn_id, arg_min(l.log_id, (abs(a.n - l.n)) * 1000000000 + l.n) as log_id from {_pa} a join {_pl} l on a.c = l.c and a.p = l.p and a.q = l.q group by a.turn_id")
def nearest_ordinal_join(spark, d):
    a = agent(spark, d).where("CallID is not null").select("CallID", "ord", X.prompt_key(F.col("AgentPrompt")).alias("p"), "IQMedian")
    m = log(spark, d, "CallID", "Prompt", "IQMedian").select("log_id", call_id(F.col("CallID")).alias("CallID"), X.prompt_key(F.col("Prompt")).alias("p"), "IQMedian").where("CallID is not null")
    a = place(a, ["CallID"], ["ord"], "place").withColumnRenamed("ord", "turn_id")
    m = place(m, ["CallID"], ["log_id"], "log_place")
    return joins.nearest_place(a, m, ["CallID", "p", "IQMedian"], "place", "log_place").select("turn_id", "log_id")


# ---- text


@query(f"select turn_id, {S.prompt('AgentPrompt')} as prompt_key from {S.AGENT}")
def prompt_standardise(spark, d):
    return agent(spark, d).select(F.col("ord").alias("turn_id"), X.prompt_key(F.col("AgentPrompt")).alias("prompt_key"))


@query(f"select turn_id, {S.agent_text('Transcript')} as clean from {S.AGENT}")
def clean_text_agent(spark, d):
    return agent(spark, d).select(F.col("ord").alias("turn_id"), X.clean_agent(F.col("Transcript")).alias("clean"))


@query(f"select utt_id, {S.blanks('Transcript')} as clean from {S.USER}")
def clean_text_user(spark, d):
    return user(spark, d).select(F.col("ord").alias("utt_id"), X.tidy_blanks(F.col("Transcript")).alias("clean"))


@query()
def number_words(spark, d):
    s = X.standardise(F.col("Transcript"))
    return user(spark, d).select(F.col("ord").alias("utt_id"), s.alias("s")).select("utt_id", "s.output", "s.key")


_ones = "['" + "','".join(X.ONES) + "']"
_tens = "['" + "','".join(X.TENS) + "']"
_below = f"case when r < 20 then {_ones}[r + 1] when r % 10 = 0 then {_tens}[r // 10 + 1] else {_tens}[r // 10 + 1] || ' ' || {_ones}[r % 10 + 1] end"


@query(f"""select o_orderkey, case when h = 0 then w when r = 0 then {_ones}[h + 1] || ' hundred' else {_ones}[h + 1] || ' hundred and ' || w end as words
 from (select *, {_below} as w from (select o_orderkey, (o_orderkey % 1000) // 100 as h, o_orderkey % 100 as r from orders))""")
def numbers_below_thousand(spark, d):
    n = F.pmod(F.col("o_orderkey"), F.lit(1000)).cast("string")
    return table(spark, d, "orders").select("o_orderkey", X.in_words(n).alias("words"))


@query()
def fuzzy_ratio(spark, d):
    a = agent(spark, d)
    return a.select(F.col("ord").alias("turn_id"), F.round(X.similarity(X.prompt_key(F.col("Transcript")), X.prompt_key(F.col("AgentPrompt"))), 6).alias("ratio"))


# ---- exchanges

_a = f"(select {S.cid('CallID')} as c, turn_id as id, {S.finite('StartTime')} as s, {S.finite('EndTime')} as e, {S.agent_text('coalesce(Transcript, chr(32))')} as t, {S.blanks('AgentPrompt')} as p, IQMedian as q from {S.AGENT} where {S.cid('CallID')} is not null and AgentPrompt is not null)"
_u = f"(select {S.cid('CallID')} as c, utt_id as id, {S.finite('StartTime')} as s, {S.finite('EndTime')} as e, {S.blanks('Transcript')} as t from {S.USER} where {S.cid('CallID')} is not null and Transcript is not null)"
_an = f"(select *, lead(s) over (partition by c order by s nulls last, id) as ns, lead(id) over (partition by c order by s nulls last, id) is not null as has_next from {_a})"
_own = f"(select a.c, a.id as ag, u.id as ui, u.s, u.e, u.t from {_an} a join {_u} u on u.c = a.c and u.s > a.s and (not a.has_next or u.s < a.ns))"
_ex = f"""(with o as (select *, s - lag(e) over (partition by c, ag order by s, ui) as gap from {_own}),
 g as (select c, ag, min(s) as us, max(e) as ue, count(*) as n, count(*) filter (where lower(t) in ({S.RESPONSES}) and e - s < {exchange.RESPONSE_S}) as rt, string_agg(t, ' ' order by s, ui) as said,
  count(*) filter (where gap > 0) as np, round(avg(gap) filter (where gap > 0), 2) as pa, round(sum(gap) filter (where gap > 0), 2) as ps, round(stddev_pop(gap) filter (where gap > 0), 2) as pd from o group by c, ag)
 select a.c as CallID, a.id as turn_id, a.s as StartTime, case when has_next then ns else coalesce(ue, a.e) end as EndTime, a.e as AgentEndTime, us as UserStartTime, ue as UserEndTime,
  case when n > 0 then a.t || ' [SEP] ' || said else a.t end as CombinedTranscript, a.t as AgentTranscript, a.p as AgentPrompt, coalesce(rt, 0) as ResponseTokenCount, coalesce(n, 0) as NumConsecutiveUserUtterances, coalesce(n, 0) > 1 as HasConsecutiveUserUtterances,
  coalesce(np, 0) as NumInternalPauses, coalesce(pa, 0) as AvgInternalPauseDuration, coalesce(ps, 0) as TotalInternalPauseDuration, coalesce(pd, 0) as StdInternalPauseDuration, a.q as IQMedian from {_an} a left join g on g.c = a.c and g.ag = a.id)"""


def _utterances(spark, d):
    return exchange.combine(agent(spark, d), user(spark, d))


@query(f"select c as CallID, 'agent' as Speaker, s as StartTime, e as EndTime, t as Transcript, p as AgentPrompt, q as IQMedian, id as ord from {_a} union all select c, 'user', s, e, t, null, null, id from {_u}")
def combine_transcripts(spark, d):
    return _utterances(spark, d)


@query(f"select CallID, turn_id, StartTime, EndTime, UserStartTime, UserEndTime, CombinedTranscript, AgentPrompt, NumConsecutiveUserUtterances, HasConsecutiveUserUtterances, IQMedian from {_ex}")
def exchange_base(spark, d):
    e = exchange.exchanges(_utterances(spark, d))
    return e.select("CallID", "turn_id", "StartTime", "EndTime", "UserStartTime", "UserEndTime", "CombinedTranscript", "AgentPrompt", "NumConsecutiveUserUtterances", "HasConsecutiveUserUtterances", "IQMedian")


@query(f"select CallID, turn_id, ResponseTokenCount, NumInternalPauses, AvgInternalPauseDuration, TotalInternalPauseDuration, StdInternalPauseDuration from {_ex}")
def exchange_pauses(spark, d):
    e = exchange.exchanges(_utterances(spark, d))
    return e.select("CallID", "turn_id", "ResponseTokenCount", "NumInternalPauses", "AvgInternalPauseDuration", "TotalInternalPauseDuration", "StdInternalPauseDuration")


_tt = ["AgentTurnDuration", "UserTurnDuration", "ExchangeDuration", "UserResponseLatency", "AgentResponseLatency", "TurnTakingRatio", "UserOverlapDuration", "AgentOverlapDuration", "PromptCompletionRatio"]


@query(f"""select CallID, turn_id, round(AgentEndTime - StartTime, 4) as AgentTurnDuration, round(coalesce(UserEndTime - UserStartTime, 0), 4) as UserTurnDuration, round(EndTime - StartTime, 4) as ExchangeDuration, round(ul, 4) as UserResponseLatency, round(al, 4) as AgentResponseLatency,
 round(coalesce(case when AgentEndTime - StartTime != 0 then coalesce(UserEndTime - UserStartTime, 0) / (AgentEndTime - StartTime) end, 0), 4) as TurnTakingRatio, round(greatest(-ul, 0), 4) as UserOverlapDuration, round(greatest(-al, 0), 4) as AgentOverlapDuration,
 round(case when length(AgentPrompt) > 0 then length(AgentTranscript)::double / length(AgentPrompt) when length(AgentTranscript) = 0 then 1.0 else 0.0 end, 4) as PromptCompletionRatio, ul < 0 as UserIsOverlap, al < 0 as AgentIsOverlap, ul < 0 and length(AgentTranscript) < length(AgentPrompt) as UserInterruptsAgent
 from (select *, coalesce(UserStartTime - AgentEndTime, 0) as ul, coalesce(StartTime - lag(UserEndTime) over (partition by CallID order by StartTime nulls last, turn_id), 0) as al from {_ex})""")
def turn_taking(spark, d):
    t = exchange.turn_taking(exchange.exchanges(_utterances(spark, d)))
    return t.select("CallID", "turn_id", *[F.round(c, 4).alias(c) for c in _tt], "UserIsOverlap", "AgentIsOverlap", "UserInterruptsAgent")


@query(f"select CallID, turn_id, StartTime, EndTime, CombinedTranscript as text, IQMedian - 1 as label, path from {_ex} join (select filecode, max(dyad_path) as path from audio_inventory group by filecode) on CallID = filecode where IQMedian is not null and StartTime is not null and EndTime is not null and path is not null")
def training_index(spark, d):
    e = stage(exchange.exchanges(_utterances(spark, d)), "exchanges")
    return exchange.training_index(e, table(spark, d, "audio_inventory").select("filecode", F.col("dyad_path").alias("path")), "filecode", "path")


# ---- alignment

_seg = f"(select c, id as id, s, e from {_u} union all select c, -id, s, e from {_a})"


def _sides(spark, d):
    u = user(spark, d).select("CallID", F.col("ord").alias("id"), usable(F.col("StartTime")).alias("start"), usable(F.col("EndTime")).alias("end"), X.tidy_blanks(F.col("Transcript")).alias("text")).where("text is not null and CallID is not null")
    a = agent(spark, d).where("AgentPrompt is not null and CallID is not null").select("CallID", (-F.col("ord")).alias("id"), usable(F.col("StartTime")).alias("start"), usable(F.col("EndTime")).alias("end"), X.clean_agent(F.coalesce("Transcript", F.lit(" "))).alias("text"))
    return u.unionByName(a), u


@query(f"select s.c as CallID, s.id as seg_id, u.id as user_id from {_seg} s join {_u} u on s.c = u.c and abs(s.s - u.s) <= 0.5 and abs(s.e - u.e) <= 0.5")
def user_segment_candidates(spark, d):
    segments, users = _sides(spark, d)
    return align.near_in_time(segments, users).select("CallID", "seg_id", "user_id")


@query()
def user_segment_greedy(spark, d):
    return align.user_segments(*_sides(spark, d))


@query()
def align_greedy(spark, d):
    prompts = agent(spark, d).where("CallID is not null and AgentPrompt is not null").select("CallID", F.col("ord").alias("id"), X.tidy_blanks(F.col("AgentPrompt")).alias("text"))
    segments, _ = _sides(spark, d)
    segments = place(segments.withColumn("s", F.coalesce("start", F.lit(1e18))), ["CallID"], ["s", "id"], "place").select("CallID", "id", "place", "text", (F.col("id") > 0).alias("is_user"))
    return align.align_prompts(place(prompts, ["CallID"], ["id"], "place"), segments)


@query(f"select c as CallID, arg_max(Speaker, n * 1000000000000 - f) as Speaker from (select {S.cid('CallID')} as c, Speaker, count(*) as n, min(utt_id) as f from {S.USER} where {S.cid('CallID')} is not null and Speaker is not null group by all) group by c")
def speaker_mode(spark, d):
    u = user(spark, d).where("CallID is not null and Speaker is not null").groupBy("CallID", "Speaker").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("f"))
    return u.groupBy("CallID").agg(F.max_by("Speaker", F.struct("n", -F.col("f"))).alias("Speaker"))


# ---- sources and sinks

_line = f"'SPEAKER ' || c || ' 1 ' || printf('%.5f', s) || ' ' || printf('%.5f', e - s) || ' <NA> <NA> 1.0 <NA>'"


@query(f"select id as utt_id, {_line} as line from {_u} where s is not null and e is not null")
def rttm_format(spark, d):
    u = user(spark, d).where("CallID is not null and Transcript is not null").select("CallID", "ord", usable(F.col("StartTime")).alias("s"), usable(F.col("EndTime")).alias("e")).where("s is not null and e is not null")
    return u.select(F.col("ord").alias("utt_id"), writers.rttm_line(F.col("CallID"), F.col("s"), F.col("e")).alias("line"))


@query(f"select c as filecode, round(s, 3) as \"start\", round(e, 3) as \"end\" from {_u} where s is not null and e is not null")
def rttm_parse(spark, d):
    r = readers.parse_rttm(rttm_format(spark, d), "line")
    return r.select("filecode", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_path = "(select dyad_path as p from audio_inventory union all select user_path from audio_inventory)"


@query(f"select right(regexp_replace(f, '[^0-9]', '', 'g'), 11) as filecode, max(p) filter (where contains(f, 'output')) as dyad, max(p) filter (where not contains(f, 'output')) as \"user\" from (select p, string_split(p, '/')[-1] as f from {_path} where p is not null) where regexp_matches(f, '[0-9]') group by 1")
def audio_inventory(spark, d):
    t = table(spark, d, "audio_inventory")
    return readers.audio_pairs(t.select(F.explode(F.array("dyad_path", "user_path")).alias("p")), "p")


@query(f"select utt_id, c as CallID, Speaker, case when s is not null then cast(round(cast(s as decimal(18,6)), 2) as varchar) end as StartTime, case when e is not null then cast(round(cast(e as decimal(18,6)), 2) as varchar) end as EndTime, Transcript from (select utt_id, Transcript, {S.cid('CallID')} as c, Speaker, {S.finite('StartTime')} as s, {S.finite('EndTime')} as e from {S.USER})")
def user_sheet(spark, d):
    u = user(spark, d).withColumn("StartTime", usable(F.col("StartTime"))).withColumn("EndTime", usable(F.col("EndTime")))
    return writers.user_sheet(u.withColumnRenamed("ord", "utt_id"), "utt_id")


# ---- groups, folds, weights, features

_filtered = f"(select distinct on (log_id) log_id, {S.cid('CallID')} as c, IQMedian from filtered_system_features)"


def _study(spark, d):
    return table(spark, d, "filtered_system_features").select("log_id", call_id(F.col("CallID")).alias("CallID"), "IQMedian").dropDuplicates(["log_id"])


@query(f"select log_id from (select log_id, row_number() over (partition by c order by log_id) as n from {_filtered} where c is not null) where n > 2")
def warm_up_trim(spark, d):
    return features.warm_up_trim(_study(spark, d), "CallID", "log_id").select("log_id")


@query(f"select log_id, cast((n - n % 20) / 20 as bigint) as chunk_no, n % 20 as place_in_chunk from (select log_id, row_number() over (partition by c order by log_id) - 1 as n from {_filtered} where c is not null)")
def chunk_sequence(spark, d):
    return features.chunks(_study(spark, d), "CallID", "log_id", 20).select("log_id", "chunk_no", "place_in_chunk")


_ranked = f"(select c, row_number() over (order by md5('42:' || c), c) - 1 as place, count(*) over () as n from (select distinct c from {_filtered} where c is not null))"


@query(f"select c as CallID, case when place < floor(n * 0.8::double) then 'train' else 'test' end as part from {_ranked}")
def group_split(spark, d):
    return partitions.group_split(_study(spark, d), "CallID")


@query(f"select c as CallID, cast(floor(place * 10 / n::double) as bigint) as fold from {_ranked}")
def group_folds(spark, d):
    return partitions.group_folds(_study(spark, d), "CallID")


@query(f"select y as label, n, round(sum(n) over () / (count(*) over () * n), 6) as weight from (select IQMedian - 1 as y, count(*) as n from {_filtered} where IQMedian >= 1 group by 1)")
def class_weights(spark, d):
    t = _study(spark, d).withColumn("label", partitions.shifted(F.col("IQMedian")))
    return partitions.class_weights(t, "label").withColumn("weight", F.round("weight", 6))


_scaled = ["l_quantity", "l_extendedprice", "l_discount"]


@query("select l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 4) as {c}" for c in _scaled) + " from lineitem")
def standard_scale(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_scaled)
    t = features.standardise(t, features.moments(t, _scaled))
    return t.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in _scaled])


@query("select vec_id, cast(p as int) as place, round((v - avg(v) over (partition by p)) / stddev_pop(v) over (partition by p), 4) as v from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as p from embeddings)")
def standard_scale_vector(spark, d):
    t = features.standardise_vector(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return t.select("vec_id", F.posexplode("embedding").alias("place", "v")).withColumn("v", F.round("v", 4))


@query()
def pca_group(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    train, test = t.where("vec_id % 5 != 0"), t.where("vec_id % 5 = 0")
    a, b = features.principal_components(train, [train, test], "embedding", 0.8)
    return a.unionByName(b).select("vec_id", "label", F.size("embedding").alias("n_components"), F.transform("embedding", lambda x: F.round(x, 4)).alias("components"))


@query("select vec_id, " + ", ".join(f"embedding[{i + 1}] as dim{i}" for i in range(64)) + " from embeddings")
def expand_vector(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", "embedding")
    return features.expand(t, "embedding", features.longest(t, "embedding"), "dim")


@query("select label, cast(p as int) as place, round(avg(v), 4) as v from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as p from embeddings) group by label, p")
def mean_pool(spark, d):
    t = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "v"))
    return t.groupBy("label", "place").agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("v"))


@query("select vec_id, round(list_sum([x::double for x in embedding]) / len(embedding), 4) as pooled, cast(len(embedding) as int) as n from embeddings")
def pad_mask(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("n"))
    t = features.pad_all(t, "x").withColumn("padded", F.transform("padded", lambda v: F.array(v)))
    return t.select("vec_id", F.round(F.get(features.mean_pool(F.col("padded"), F.col("mask")), F.lit(0)), 4).alias("pooled"), "n")


# ---- scores, summaries, tests

_rated = f"(select IQMedian as t, IQRater1 as a, IQRater2 as b, IQRater3 as c from {S.LOG} where IQMedian between 1 and 5 and IQRater1 between 1 and 5 and IQRater2 between 1 and 5 and IQRater3 between 1 and 5)"


def _rated_rows(spark, d):
    t = log(spark, d, "IQMedian", "IQRater1", "IQRater2", "IQRater3")
    return t.where(" and ".join(f"{c} between 1 and 5" for c in t.columns[1:]))


@query(f"select t as y_true, a as y_pred, count(*) as n from {_rated} group by t, a")
def confusion(spark, d):
    return metrics.confusion(_rated_rows(spark, d), "IQMedian", "IQRater1")


_report = f"""(with k as (select t as label from {_rated} union select a from {_rated}), s as (select label, (select count(*) from {_rated} where t = label and a = label) as h, (select count(*) from {_rated} where t = label) as tt, (select count(*) from {_rated} where a = label) as pp from k)
 select label, coalesce(h / nullif(pp, 0)::double, 0) as "precision", coalesce(h / nullif(tt, 0)::double, 0) as recall, coalesce(2 * h / nullif(tt + pp, 0)::double, 0) as f1, tt as support from s)"""


@query(f'select label, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1, support from {_report}')
def class_report(spark, d):
    r = metrics.class_report(_rated_rows(spark, d), "IQMedian", "IQRater1")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f'select round(sum(recall * support) / sum(support), 6) as accuracy, round(avg("precision"), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum("precision" * support) / sum(support), 6) as weighted_precision, round(sum(f1 * support) / sum(support), 6) as weighted_f1, cast(sum(support) as bigint) as support from {_report}')
def report_averages(spark, d):
    r = metrics.report_averages(_rated_rows(spark, d), "IQMedian", "IQRater1")
    return r.select(*[F.round(c, 6).alias(c) if c != "support" else F.col(c) for c in r.columns])


_described = lambda c, src: f"select l_returnflag, '{c}' as column_name, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, round(max({c})::double, 4) as max from {src} group by l_returnflag"


@query(" union all ".join(_described(c, "lineitem") for c in _scaled))
def describe_numeric(spark, d):
    r = metrics.describe(table(spark, d, "lineitem"), _scaled, "l_returnflag")
    return r.select("l_returnflag", "column_name", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


_mixed = ["o_orderstatus", "o_orderpriority"]


@query(" union all ".join(f"select m as month, '{c}' as column_name, cast(sum(n) as bigint) as count, count(*) as n_unique, arg_min(v, -n * 1000 + k) as top, max(n) as freq from (select *, row_number() over (partition by m order by v) as k from (select month(o_orderdate)::int as m, {c} as v, count(*) as n from orders group by all)) group by m" for c in _mixed))
def describe_mixed(spark, d):
    return metrics.describe_texts(table(spark, d, "orders").withColumn("month", F.month("o_orderdate")), _mixed, "month")


@query("select o_orderpriority, o_orderkey, o_totalprice, cast(rank as int) as rank from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 5")
def top_n_per_group(spark, d):
    return metrics.top_n(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 5)


@query("select utt_id, CallID, Speaker from (select utt_id, CallID, Speaker, count(*) over (partition by utt_id, CallID, Speaker) as n from validated_user_transcript) where n > 1")
def dedup_report(spark, d):
    return metrics.repeated_rows(table(spark, d, "validated_user_transcript").select("utt_id", "CallID", "Speaker"))


@query("select c_custkey, c_acctbal, null as s_suppkey, null as s_acctbal from customer union all select null, null, s_suppkey, s_acctbal from supplier")
def union_results(spark, d):
    return metrics.union_results([table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")])


@query("select o_custkey, o_totalprice, o_orderkey from (select o_custkey, o_totalprice, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders) where k = n // 2 + 1")
def median_run(spark, d):
    return metrics.median_run(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("select * from (values (32), (64)) a(hidden_size), (values (1), (2)) b(num_layers), (values (0.001::double), (0.0005::double)) c(learning_rate), (values (true), (false)) e(use_attention)")
def param_grid(spark, d):
    return metrics.parameter_grid(spark, {"hidden_size": [32, 64], "num_layers": [1, 2], "learning_rate": [0.001, 0.0005], "use_attention": [True, False]})


@query("select n_name, p, round(p_corrected, 6) as p_corrected, p_corrected <= 0.05 as significant from (select n_name, p, least(max(q) over (order by p, n_name rows unbounded preceding), 1.0) as p_corrected from (select n_name, p, (count(*) over () - row_number() over (order by p, n_name) + 1) * p as q from (select n_name, (n_nationkey % 7 + 1) / 1000::double as p from nation)))")
def holm_correction(spark, d):
    t = table(spark, d, "nation").select("n_name", ((F.col("n_nationkey") % 7 + 1) / 1000.0).alias("p"))
    return stats.holm(t, "p", "n_name").withColumn("p_corrected", F.round("p_corrected", 6))


def _macro(a: str) -> str:
    return f"""(with x as (select t as y, {a} as p from {_rated}), k as (select y as l from x union select p from x),
 s as (select l, (select count(*) from x where y = l and p = l)::double as h, (select count(*) from x where y = l) as n, (select count(*) from x where p = l) as m from k) select avg(2 * h / (n + m)) as f1, avg(case when n > 0 then h / n else 0 end) as recall from s)"""


_raters = {"IQRater1": "a", "IQRater2": "b", "IQRater3": "c"}
_pairs = [("IQRater1", "IQRater2"), ("IQRater1", "IQRater3"), ("IQRater2", "IQRater3")]


@query(" union all ".join(f"select '{x} vs {y}' as comparison, round(u.f1, 6) as f1_model_a, round(v.f1, 6) as f1_model_b, round(u.recall, 6) as recall_model_a, round(v.recall, 6) as recall_model_b from {_macro(_raters[x])} u, {_macro(_raters[y])} v" for x, y in _pairs))
def pairwise_scores(spark, d):
    r = stats.pairwise(_rated_rows(spark, d), "IQMedian", ["IQRater1", "IQRater2", "IQRater3"])
    return r.select("comparison", *[F.round(c, 6).alias(c) for c in ("f1_model_a", "f1_model_b", "recall_model_a", "recall_model_b")])


@query()
def pairwise_compare(spark, d):
    return stats.pairwise(_rated_rows(spark, d), "IQMedian", ["IQRater1", "IQRater2", "IQRater3"])


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def filter_chain(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return metrics.filtered(t, o_orderstatus="F", o_orderpriority="1-URGENT", o_orderkey=None)


@query("select round(min(v), 4) as \"min\", round(max(v), 4) as \"max\", round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std from (select unnest([l_quantity::double, l_extendedprice::double, l_discount::double]) as v from lineitem)")
def tensor_stats(spark, d):
    r = features.tensor_stats(table(spark, d, "lineitem"), _scaled)
    return r.select(*[F.round(c, 4).alias(c) for c in r.columns])


@query("""select 'o_orderkey' as column_name, 'bigint' as kind, count(*) * 8 as n_bytes, count(*) * 4 as n_bytes_narrow from orders
 union all select 'o_totalprice', 'double', count(*) * 8, count(*) * 4 from orders union all select 'o_orderpriority', 'string', cast(sum(strlen(o_orderpriority)) as bigint), cast(sum(strlen(o_orderpriority)) as bigint) from orders""")
def memory_report(spark, d):
    return cleaning.memory_report(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority"))


@query(f"select turn_id, path from (select turn_id, {S.cid('CallID')} as c from {S.AGENT}) left join (select filecode, max(dyad_path) as path from audio_inventory group by filecode) on c = filecode")
def group_files(spark, d):
    t = agent(spark, d).select(F.col("ord").alias("turn_id"), "CallID")
    return joins.with_files(t, table(spark, d, "audio_inventory").select("filecode", F.col("dyad_path").alias("path")), "CallID", "filecode", "path").select("turn_id", "path")


@query("select right(regexp_replace(f, '[^0-9]', '', 'g'), 11) as filecode, max(p) as path from (select dyad_path as p, string_split(dyad_path, '/')[-1] as f from audio_inventory) where starts_with(f, 'LetsGoPublic') and ends_with(f, 'output.wav') and regexp_matches(f, '[0-9]') group by 1")
def dyad_inventory(spark, d):
    return readers.dyad_audio(table(spark, d, "audio_inventory"), "dyad_path")


def _said(spark, d):
    """Words of each utterance at even steps of a tenth of a second, every third by the agent."""
    u = user(spark, d).select(F.col("ord").alias("utt_id"), X.tidy_blanks(F.coalesce("Transcript", F.lit(""))).alias("t"), usable(F.col("StartTime")).alias("s")).where("t != ''")
    word = lambda w, i: F.struct(w.alias("word"), (i / 10).alias("start"), (i / 10 + 0.05).alias("end"), F.when(i % 3 == 2, "agent").otherwise("user").alias("speaker"))
    return u.withColumn("words", F.transform(F.split("t", " "), word))


@query(f"""with u as (select utt_id, string_split({S.blanks('Transcript')}, ' ') as ws, {S.finite('StartTime')} as s from {S.USER} where {S.blanks('Transcript')} != '')
 select utt_id, cast(2 * len(ws) as int) as n_words, array_to_string([w for w, i in ws if (i - 1) % 3 < 2], ' ') as said, 'user' as speaker, round(s + (len(ws) - 1) / 10, 3) as last_start from u""")
def word_lists(spark, d):
    t = _said(spark, d)
    both = W.flat_words(F.array(F.struct("words"), F.struct("words")))
    mine, late = W.of_speaker(F.col("words"), F.lit("user")), W.shifted_words(F.col("words"), F.col("s"))
    return t.select("utt_id", F.size(both).alias("n_words"), W.words_text(mine).alias("said"), W.main_speaker(F.col("words")).alias("speaker"), F.round(F.element_at(late, -1)["start"], 3).alias("last_start"))


# ---- models

_features = ["request_present", "place_present", "time_present", "route_present", "confirm_present", "Modality_speech", "ASRRecognitionStatus_success", "ASRRecognitionStatus_timeout", "RoleName_confirm", "ASRConfidence"]


def _modelled(spark, d):
    t = table(spark, d, "filtered_system_features").dropDuplicates(["log_id"]).where("IQMedian between 1 and 5")
    return t.select(call_id(F.col("CallID")).alias("CallID"), (F.col("IQMedian") - 1).alias("label"), *_features[:-1], usable(F.col("ASRConfidence")).alias("ASRConfidence"))


@query()
def scale_and_reduce(spark, d):
    """Groups of columns made of the places of the embeddings, named as the feature tables name them."""
    e = table(spark, d, "embeddings")
    tags = ["Prompt_sbert_dim", "Utterance_roberta_base_dim", "CombinedTranscript_MiniLM_Dim", "wav2vec2_Emb"]
    t = e.select((F.col("vec_id") % 20).cast("string").alias("CallID"), (F.col("label") % 5 + 1).cast("int").alias("IQMedian"), "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"{tags[i // 16]}{i % 16}") for i in range(64)])
    train = t.where("vec_id % 5 != 0")
    a, b = features.scale_and_reduce(train.drop("vec_id"), [train.drop("vec_id"), t.where("vec_id % 5 = 0").drop("vec_id")], {"systemf_text": 0.9, "speechf_text": 0.8, "speechf_wav": None})
    return a.unionByName(b)


@query()
def cv_grid(spark, d):
    return evaluation.grid_search(_modelled(spark, d), _features, "label", "CallID", {"regParam": [0.01, 0.1], "elasticNetParam": [0.0]})


@query()
def final_evaluation(spark, d):
    t = _modelled(spark, d)
    parts = partitions.group_split(t, "CallID")
    part = lambda p: t.join(parts.where(F.col("part") == p).select("CallID"), "CallID", "left_semi")
    return evaluation.final_evaluation(part("train"), part("test"), _features, "label", "CallID", {"regParam": 0.01})[0]


# ---- signal


@query("select vec_id, round(sqrt(list_sum([x::double * x::double for x in embedding]) / len(embedding)) + 1e-6, 6) as rms from embeddings")
def rms_level(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(signal.rms(F.col("embedding")), 6).alias("rms"))


@query("select vec_id, round(list_sum([greatest(-1, least(1, x::double * 0.07 / (sqrt(list_sum([y::double * y::double for y in embedding]) / len(embedding)) + 1e-6))) for x in embedding]), 4) as total from embeddings")
def rms_normalise(spark, d):
    x = signal.normalise(F.col("embedding"), signal.rms(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"select utt_id, cast(greatest(0, least(trunc({S.finite('StartTime')} * 16000), 1000000000)) as int) as frame from {S.USER} where {S.finite('StartTime')} is not null")
def frame_index(spark, d):
    u = user(spark, d).select(F.col("ord").alias("utt_id"), usable(F.col("StartTime")).alias("s")).where("s is not null")
    return u.select("utt_id", signal.frame(F.col("s"), 16000.0, F.lit(1_000_000_000)).alias("frame"))


# the sum of products at every shift; of equal sums the least shift, as argmax takes it
@query("""with e as (select vec_id, cast(vec_id % 7 as int) as k, embedding as b, list_concat([0.0::double for _ in range(cast(vec_id % 7 as int))], embedding) as a from embeddings),
 s as (select vec_id, a, b, unnest(range(1 - len(b), len(a))) as lag from e),
 p as (select vec_id, lag, list_sum([a[i + lag] * b[i]::double for i in range(greatest(1, 1 - lag), least(len(b), len(a) - lag) + 1)]) as v from s)
 select vec_id, cast(arg_max(lag, v) as double) as lag from p group by vec_id""")
def xcorr_offset(spark, d):
    t = table(spark, d, "embeddings").withColumn("k", (F.col("vec_id") % 7).cast("int"))
    later = F.concat(F.array_repeat(F.lit(0.0), F.col("k")), F.col("embedding").cast("array<double>"))
    return t.select("vec_id", signal.lag_samples(later, F.col("embedding")).alias("lag"))


@query(f"select log_id, {S.tidy('LoopName')} as LoopName from {S.LOG} where {S.tidy('LoopName')} not in ('', 'missing')")
def not_blank_filter(spark, d):
    return log(spark, d, "LoopName").select("log_id", present(F.col("LoopName")).alias("LoopName")).where("LoopName is not null")
