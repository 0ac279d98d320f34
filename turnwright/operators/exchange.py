"""Exchanges of a dialogue: one agent turn and the user utterances up to the next, with pauses and turn-taking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.functions.ids import usable
from turnwright.functions.text import clean_agent, tidy_blanks
from turnwright.operators.cleaning import safe_ratio
from turnwright.operators.joins import with_files
from turnwright.operators.ordered import BLOCK_ROWS, blocked, running
from turnwright.session import stage

#: Place in the order of rows without a start: behind all others.
LAST = 1e18
# Short answers, and how long one may last in seconds.
RESPONSES = ("yeah", "yes", "yep", "correct", "wrong", "huh", "uh", "okay", "ok", "right", "alright", "oh", "sure", "really", "no", "nope")
RESPONSE_S = 1.001


def combine(agent: DataFrame, user: DataFrame) -> DataFrame:
    """Utterances (CallID, Speaker, StartTime, EndTime, Transcript, AgentPrompt, IQMedian, ord) of both sides.

    Needs an id in column ord. Rows without a call, agent rows without a prompt and user rows without a transcript are left out; times that
    are no numbers are null; texts are cleaned by side. The two sides keep apart by Speaker. The agent's prompt may also be called Prompt.
    """
    if "AgentPrompt" not in agent.columns and "Prompt" in agent.columns:
        agent = agent.withColumnRenamed("Prompt", "AgentPrompt")
    a = agent.where("CallID is not null and AgentPrompt is not null").select(
        "CallID", F.lit("agent").alias("Speaker"), usable(F.col("StartTime")).alias("StartTime"), usable(F.col("EndTime")).alias("EndTime"), clean_agent(F.coalesce("Transcript", F.lit(""))).alias("Transcript"), tidy_blanks(F.col("AgentPrompt")).alias("AgentPrompt"), "IQMedian", "ord"
    )
    u = user.where("CallID is not null and Transcript is not null").select(
        "CallID", F.lit("user").alias("Speaker"), usable(F.col("StartTime")).alias("StartTime"), usable(F.col("EndTime")).alias("EndTime"), tidy_blanks(F.col("Transcript")).alias("Transcript"), F.lit(None).cast("string").alias("AgentPrompt"), F.lit(None).cast("int").alias("IQMedian"), "ord"
    )
    return a.unionByName(u)


def assign_users(utterances: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(agent turns with next_start and has_next; users with the agent row ag that owns them and prev_end, the end of the user before in it).

    A user belongs to the agent turn that began last before it, strictly. One that begins together with an agent turn, before the first, or
    after a turn whose successor has no start, belongs to none. Calls with more than block_rows rows are ordered in blocks with carried values.
    """
    d = utterances.withColumn("_s", F.coalesce("StartTime", F.lit(LAST))).withColumn("_u", (F.col("Speaker") == "user").cast("int")).where("_u = 0 or StartTime is not null")
    order = ["_s", "_u", "ord"]
    d, b = blocked(d, ["CallID"], order, "exchange-rows", block_rows)
    mine = F.when(F.col("_u") == 0, F.struct("_s", "ord"))
    d = running(d, ["CallID"], b, order, mine, "last", "_own")
    d = running(d, ["CallID"], b, order, mine, "last", "_next", reverse=True)
    if b:
        d = stage(d, "exchange-owned")
    turns = d.where("_u = 0").withColumns({"next_start": F.when(F.col("_next._s") < LAST, F.col("_next._s")), "has_next": F.col("_next").isNotNull()})
    users = d.where("_u = 1 and _own is not null and _own._s < _s and coalesce(_next._s, 0D) < 1e18D").withColumn("ag", F.col("_own.ord"))
    users = running(users, ["CallID"], b, ["_s", "ord"], F.struct("ag", "EndTime"), "last", "_before")
    return turns, users.withColumn("prev_end", F.when(F.col("_before.ag") == F.col("ag"), F.col("_before.EndTime")))


def exchanges(utterances: DataFrame, responses: tuple[str, ...] = RESPONSES, response_s: float = RESPONSE_S, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per agent turn with its users' times, text, short answers and pauses.

    A pause is a positive gap between a user's start and the previous user's end within the exchange; its numbers are rounded to two places,
    the deviation is that of the population. Exchanges without users have zeros and no user times. The text of an exchange is one value, so
    only it grows with the exchange's length.
    """
    turns, users = assign_users(utterances, block_rows)
    gap = F.col("StartTime") - F.col("prev_end")
    short = F.lower(F.trim("Transcript")).isin(*responses) & (F.col("EndTime") - F.col("StartTime") < response_s)
    u = users.withColumn("gap", F.when(gap > 0, gap)).withColumn("short", F.coalesce(short, F.lit(False)))
    spoken = F.array_sort(F.collect_list(F.struct("_s", "ord", "Transcript")))
    g = u.groupBy("CallID", "ag").agg(
        F.min("StartTime").alias("UserStartTime"),
        F.max("EndTime").alias("UserEndTime"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("short").alias("ResponseTokenCount"),
        F.array_join(F.transform(spoken, lambda x: x["Transcript"]), " ").alias("said"),
        F.count("gap").alias("NumInternalPauses"),
        F.round(F.avg("gap"), 2).alias("avg"),
        F.round(F.sum("gap"), 2).alias("sum"),
        F.round(F.stddev_pop("gap"), 2).alias("std"),
    )
    e = turns.join(g.withColumnRenamed("ag", "ord"), ["CallID", "ord"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    end = F.when(F.col("has_next"), F.col("next_start")).otherwise(F.coalesce("UserEndTime", "EndTime"))
    return e.select(
        "CallID",
        F.col("ord").alias("turn_id"),
        "StartTime",
        end.alias("EndTime"),
        F.col("EndTime").alias("AgentEndTime"),
        "UserStartTime",
        "UserEndTime",
        F.when(F.col("n") > 0, F.concat_ws(" [SEP] ", "Transcript", "said")).otherwise(F.col("Transcript")).alias("CombinedTranscript"),
        F.col("Transcript").alias("AgentTranscript"),
        "AgentPrompt",
        zero("ResponseTokenCount").alias("ResponseTokenCount"),
        zero("n").alias("NumConsecutiveUserUtterances"),
        (zero("n") > 1).alias("HasConsecutiveUserUtterances"),
        zero("NumInternalPauses").alias("NumInternalPauses"),
        F.coalesce("avg", F.lit(0.0)).alias("AvgInternalPauseDuration"),
        F.coalesce("sum", F.lit(0.0)).alias("TotalInternalPauseDuration"),
        F.coalesce("std", F.lit(0.0)).alias("StdInternalPauseDuration"),
        "IQMedian",
    )


def turn_taking(e: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Durations, latencies, overlaps, interruptions and prompt completion of exchanges, in order of start within the call."""
    order = ["_s", "turn_id"]
    d, b = blocked(e.withColumn("_s", F.coalesce("StartTime", F.lit(LAST))), ["CallID"], order, "exchange-turns", block_rows)
    d = running(d, ["CallID"], b, order, F.struct("UserEndTime"), "last", "_p").withColumn("_prev", F.col("_p.UserEndTime"))
    d = d.withColumns({
        "AgentTurnDuration": F.col("AgentEndTime") - F.col("StartTime"),
        "UserTurnDuration": F.coalesce(F.col("UserEndTime") - F.col("UserStartTime"), F.lit(0.0)),
        "ExchangeDuration": F.col("EndTime") - F.col("StartTime"),
        "UserResponseLatency": F.coalesce(F.col("UserStartTime") - F.col("AgentEndTime"), F.lit(0.0)),
        "AgentResponseLatency": F.coalesce(F.col("StartTime") - F.col("_prev"), F.lit(0.0)),
    })
    said, asked = F.length(F.coalesce("AgentTranscript", F.lit(""))), F.length(F.coalesce("AgentPrompt", F.lit("")))
    over = F.col("UserResponseLatency") < 0
    return d.withColumns({
        "TurnTakingRatio": safe_ratio(F.col("UserTurnDuration"), F.col("AgentTurnDuration")),
        "UserIsOverlap": over,
        "UserOverlapDuration": F.greatest(-F.col("UserResponseLatency"), F.lit(0.0)),
        "AgentIsOverlap": F.col("AgentResponseLatency") < 0,
        "AgentOverlapDuration": F.greatest(-F.col("AgentResponseLatency"), F.lit(0.0)),
        "UserInterruptsAgent": over & (said < asked),
        "PromptCompletionRatio": F.when(asked > 0, said / asked).when(said == 0, 1.0).otherwise(0.0),
    }).drop("_s", "_blk", "_p", "_prev")


def training_index(e: DataFrame, files: DataFrame, file_key: str, path: str) -> DataFrame:
    """What fine-tuning needs of exchanges: (CallID, turn_id, StartTime, EndTime, text, label, path), label counted from 0 and path the recording of
    the call. Exchanges without label, times or recording are left out; features and ids stay joinable by CallID and turn_id."""
    d = with_files(e, files, "CallID", file_key, path)
    d = d.where(f"IQMedian is not null and StartTime is not null and EndTime is not null and `{path}` is not null")
    return d.select("CallID", "turn_id", "StartTime", "EndTime", F.col("CombinedTranscript").alias("text"), (F.col("IQMedian") - 1).alias("label"), path)
