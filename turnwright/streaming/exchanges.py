"""Exchanges from a stream of utterances: a stateful extension of the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "CallID string, StartTime double, AgentEndTime double, AgentTranscript string, NumConsecutiveUserUtterances int, UserStartTime double, UserEndTime double"
STATE = "start double, agent_end double, text string, n int, user_start double, user_end double"


def stream_exchanges(utterances: DataFrame, event_time: str, lateness: str = "10 minutes", quiet_ms: int = 600_000) -> DataFrame:
    """An exchange when its successor begins, or when its call has been quiet for quiet_ms.

    utterances: CallID, Speaker, StartTime, EndTime, Transcript and an event time. Late rows beyond the watermark are dropped by Spark. Within
    a micro-batch rows are ordered by StartTime; a user row that begins with an agent row or before the first belongs to none.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _row(key[0], now)
            return
        rows = pd.concat(list(frames))
        rows["_u"] = (rows["Speaker"] == "user").astype(int)
        done = []
        for r in rows.sort_values(["StartTime", "_u"]).itertuples():
            if r.Speaker != "user":
                if now is not None:
                    done.append(_row(key[0], now))
                now = (r.StartTime, r.EndTime, r.Transcript, 0, None, None)
            elif now is not None and r.StartTime > now[0]:
                s, e = now[4], now[5]
                now = (*now[:3], now[3] + 1, r.StartTime if s is None else min(s, r.StartTime), r.EndTime if e is None else max(e, r.EndTime))
        if now is not None:
            state.update(now)
            state.setTimeoutDuration(quiet_ms)
        yield from done

    d = utterances.withWatermark(event_time, lateness).drop(event_time)
    return d.groupBy("CallID").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _row(call: str, s: tuple) -> pd.DataFrame:
    return pd.DataFrame([(call, s[0], s[1], s[2], s[3], s[4], s[5])], columns=["CallID", "StartTime", "AgentEndTime", "AgentTranscript", "NumConsecutiveUserUtterances", "UserStartTime", "UserEndTime"])
