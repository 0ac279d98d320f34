"""Queries of the problems of this subpackage over the bus line's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwright.functions.ids import call_id, millis, tidy
from turnwright.llm.consensus import consensus
from turnwright.llm.packing import pack
from turnwright.llm.pieces import split_texts
from turnwright.llm.splits import components, stratify
from turnwright.llm.tokens import count_tokens, encode_column
from turnwright.llm.turns import spoken, turn_texts, turns
from turnwright.operators.skew import salted_join
from turnwright.plans import sqltext as S
from turnwright.session import stage

CAPACITY, LIMIT, OVERLAP = 2048, 512, 64
LEAST_RELIABILITY = 0.25
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
CLASSES = [1, 2, 3, 4, 5]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the log with their usable ratings as votes; who gave a rating of a row without a call is unknown, one such rater per slot."""
    log = table(spark, d, "system_features_full")
    log = log.select("log_id", call_id(F.col("CallID")).alias("call"), "IQRater1", "IQRater2", "IQRater3", "IQMedian").dropDuplicates(["log_id"])
    who = table(spark, d, "call_raters").where("CallID is not null").groupBy(F.col("CallID").alias("call")).agg(*[F.max(F.when(F.col("slot_no") == s, F.col("rater_id"))).alias(f"r{s}") for s in (1, 2, 3)])
    d = salted_join(log, who, "call", "left")
    vote = lambda s: F.when(F.col(f"IQRater{s}").between(1, 5), F.struct(F.coalesce(F.col(f"r{s}"), F.lit(-s)).cast("bigint").alias("a"), F.col(f"IQRater{s}").cast("int").alias("l")))
    return d.select("log_id", "IQMedian", F.array_compact(F.array(vote(1), vote(2), vote(3))).alias("votes"))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus(stage(_rated(spark, d), "p2-items"), "votes", CLASSES)
    return items.select("log_id", "IQMedian", F.size("votes").alias("n_votes"), "consensus", F.round("certainty", 6).alias("certainty"), F.round("agreement", 6).alias("agreement"))


def p2_raters(spark: SparkSession, d: str) -> DataFrame:
    _, raters = consensus(stage(_rated(spark, d), "p2-items"), "votes", CLASSES)
    return raters.where("annotator > 0").select(F.col("annotator").alias("rater_id"), "n_votes", F.round("reliability", 6).alias("reliability"), "type_no")


def misstated(median: Column, votes: Column) -> Column:
    """True where at least two votes were given and median is null or isn't theirs."""
    v = F.array_sort(F.transform(votes, lambda x: x["l"]))
    n = F.size(v)
    twice = F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))
    fits = F.abs(F.col("IQMedian") * 2 - twice) == twice % 2
    return (n >= 2) & ~F.coalesce(fits, F.lit(False))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items, raters = consensus(stage(_rated(spark, d), "p2-items"), "votes", CLASSES)
    wrong = items.where(F.col("consensus").isNotNull() & misstated(F.col("IQMedian"), F.col("votes")))
    bad = raters.where((F.col("annotator") > 0) & (F.col("reliability") < LEAST_RELIABILITY))
    return wrong.select(F.lit("item").alias("subject_kind"), F.col("log_id").alias("subject_id")).unionByName(bad.select(F.lit("rater").alias("subject_kind"), F.col("annotator").alias("subject_id")))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of p2_found with what they were held against."""
    items, _ = consensus(stage(_rated(spark, d), "p2-items"), "votes", CLASSES)
    return items.where(F.col("consensus").isNotNull() & misstated(F.col("IQMedian"), F.col("votes"))).select("log_id", "IQMedian", F.size("votes").alias("n_votes"), F.round("agreement", 6).alias("agreement"))


def split_name(c: Column) -> Column:
    """train, validation or test behind their loose spellings, else null."""
    # Spellings of the three splits.
    t = F.lower(tidy(c))
    return F.when(t.isin("train", "training", "trn"), "train").when(t.isin("validation", "valid", "val", "dev", "development"), "validation").when(t.isin("test", "testing", "tst"), "test")


def _related(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their component, and (component, split)."""
    t = table(spark, d, "filtered_system_features")
    t = t.select("log_id", call_id(F.col("CallID")).alias("call_id"), F.concat(F.lit("k"), F.col("caller_key").cast("string")).alias("hub"), "IQMedian", split_name(F.col("split_name")).alias("was")).dropDuplicates(["log_id"])
    t = stage(t, "p3-rows")
    of_call, of_hub = components(t, "call_id", "hub")
    of_hub = of_hub.withColumnRenamed("component", "c2")
    t = salted_join(salted_join(t, of_call, "call_id", "left"), of_hub, "hub", "left")
    alone = F.concat(F.lit("row"), F.col("log_id").cast("string"))
    t = t.withColumn("component", F.coalesce("component", "call_id", "c2", "hub", alone)).drop("c2")
    t = stage(t, "p3-related")
    labels = [f"n{c}" for c in (*CLASSES, 0)]
    count = [F.sum((F.col("IQMedian") == c).cast("int")).alias(f"n{c}") for c in CLASSES]
    other = F.sum((~F.coalesce(F.col("IQMedian").isin(CLASSES), F.lit(False))).cast("int")).alias("n0")
    groups = t.groupBy("component").agg(*count, other, F.collect_set("was").alias("splits_before"))
    groups = stage(groups, "p3-groups")
    placed = stratify(groups, "component", labels, SHARES)
    return t, groups.select("component", "splits_before").join(placed, "component")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    rows, groups = _related(spark, d)
    return salted_join(rows.select("log_id", "call_id", "component", "IQMedian"), groups.select("component", "split"), "component")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, groups = _related(spark, d)
    torn = groups.where((F.size("splits_before") > 1) & F.col("split").isNotNull()).select("component")
    return rows.where("call_id is not null").select("call_id", "component").distinct().join(torn, "component").select("call_id").distinct()


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "validated_user_transcript")
    t = t.select("utt_id", call_id(F.col("CallID")).alias("call"), "Speaker", millis(F.col("StartTime")).alias("s"), millis(F.col("EndTime")).alias("t"), "Transcript").where("call is not null and t > s")
    return spoken(t, "call", "Speaker", "Transcript")


def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    return turn_texts(_spoken(spark, d), "call", "utt_id", "s", "t")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return turns(_spoken(spark, d), "call", "utt_id", "s", "t").select("call_id", "speaker_role", "start_ms", "end_ms")


def p7_merge(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the labels as they are, without clustering or cleaning."""
    t = table(spark, d, "validated_user_transcript").where("Transcript is not null")
    t = t.select("utt_id", call_id(F.col("CallID")).alias("call"), F.coalesce(F.lower(tidy(F.col("Speaker"))), F.lit("none")).alias("speaker_role"), millis(F.col("StartTime")).alias("s"), millis(F.col("EndTime")).alias("t"), F.col("Transcript").alias("speech"))
    return turns(t, "call", "utt_id", "s", "t")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each item when documents are packed by their characters: its pieces, what they hold together, and the fullest container."""
    packed = pack(table(spark, d, "documents"), "doc_id", "n_chars", CAPACITY)
    fill = stage(packed, "p9-packed")
    full = fill.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    over = full.where(F.col("n") > CAPACITY).select("container", F.lit(1).alias("over"))
    return fill.join(over, "container", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_chars"), F.count("over").alias("n_overfull"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), "doc_id", "text", LIMIT, OVERLAP)


QUERIES = {f.__name__: f for f in (p2_found, p2_items, p2_consensus, p2_raters, p3_found, p3_splits, p7_found, p7_turns, p7_merge, p8_ids, p9_containers, p9_items, p10_pieces)}

_votes = f"(select log_id, IQMedian as q, list_sort([x for x in [IQRater1, IQRater2, IQRater3] if x between 1 and 5]) as v from {S.LOG})"
_named = f"lower({S.tidy('split_name')})"
_split = f"case when {_named} in ('train', 'training', 'trn') then 'train' when {_named} in ('validation', 'valid', 'val', 'dev', 'development') then 'validation' when {_named} in ('test', 'testing', 'tst') then 'test' end"

SQL: dict[str, str] = {
    "p7_merge": f"""with u as (select utt_id as k, {S.cid('CallID')} as c, coalesce(lower({S.tidy('Speaker')}), 'none') as w, {S.MS('StartTime')} as s, {S.MS('EndTime')} as t from {S.USER} where Transcript is not null),
 v as (select *, lag(w) over p as b from u where c is not null and t > s window p as (partition by c order by s, t, k)),
 x as (select *, count(*) filter (where b is null or b != w) over (partition by c order by s, t, k) as r from v),
 y as (select *, max(t) over (partition by c, r order by s, t, k rows between unbounded preceding and 1 preceding) as m from x),
 z as (select *, count(*) filter (where m is null or s > m + 1500) over (partition by c order by s, t, k) as n from y)
 select c as call_id, w as speaker_role, min(s) as start_ms, max(t) as end_ms, count(*) as n_rows from z group by c, n, w""",
    "p9_items": f"select doc_id, cast(greatest(1, ceil(n_chars / {CAPACITY}.0)) as bigint) as n_pieces, n_chars, 0::bigint as n_overfull from documents",
    "p2_items": f"""select log_id, q as IQMedian, cast(n as int) as n_votes, round((list_sum([list_sum([(case when x = y then 1 else 0 end) for y in v]) for x in v]) - n)::double / (n * (n - 1)), 6) as agreement
 from (select *, len(v) as n, v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1] as twice from {_votes}) where n >= 2 and (q is null or abs(2 * q - twice) != twice % 2)""",
    "p3_found": f"""with recursive t as (select {S.cid('CallID')} as c, caller_key as k, {_split} as p from (select distinct on (log_id) * from filtered_system_features)),
 e as (select distinct c, k from t where c is not null and k is not null), near as (select distinct a.c, b.c as d from e a join e b on a.k = b.k),
 r(root, c) as (select distinct c, c from t where c is not null union select r.root, near.d from r join near on r.c = near.c),
 of_call as (select c, min(root) as g from r group by c), of_key as (select k, min(g) as g from e join of_call using (c) group by k),
 torn as (select coalesce(x.g, y.g) as g from t left join of_call x on t.c = x.c left join of_key y on t.k = y.k group by 1 having count(distinct p) > 1)
 select c as call_id from of_call where g in (select g from torn where g is not null)""",
}
