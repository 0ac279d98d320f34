"""Alignment of transcripts by time and by fuzzy text, one to one and greedy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwright.functions.text import matching_key, ratio, similarity, spoken_form
from turnwright.operators.ordered import BLOCK_ROWS, blocked, running

TOLERANCE_S, TEXT_RATIO = 0.5, 80.0
WINDOW_RATIO, WORD_RATIO, FULL_SCORE, MOST_SEGMENTS, NEAR = 60.0, 60.0, 95.0, 5, 5
#: A word of a segment: text, speaker, start, end.
Word = tuple[str, str | None, float | None, float | None]


def _cells(segments: DataFrame, users: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """segments (CallID, seg_start, ...) and users (CallID, user_start, ...) with _c, cells of time four times as wide as the tolerance in which they
    meet, so a hot call is split by time. A user is in every cell, one or two, where a segment may be near it."""
    cell = lambda c, by: F.floor((F.col(c) + by * tolerance) / (4 * tolerance))
    reach = F.sequence(cell("user_start", -1.01), cell("user_start", 1.01))  # a little wider, as sums are rounded
    return segments.withColumn("_c", cell("seg_start", 0)), users.withColumn("_c", F.explode(reach))


def _near(segments: DataFrame, users: DataFrame, tolerance: float) -> DataFrame:
    """Rows of segments and users, in cells, whose starts and ends both differ by at most tolerance."""
    j = segments.join(users, ["CallID", "_c"])
    return j.where((F.abs(F.col("seg_start") - F.col("user_start")) <= tolerance) & (F.abs(F.col("seg_end") - F.col("user_end")) <= tolerance))


def _side(df: DataFrame, n: str, *columns: str) -> DataFrame:
    """CallID and the columns, named after the side, of rows with call and times."""
    return df.where("CallID is not null and start is not null and `end` is not null").select("CallID", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "start", "end", *columns)])


def near_in_time(segments: DataFrame, users: DataFrame, tolerance: float = TOLERANCE_S) -> DataFrame:
    """Pairs (CallID, seg_id, user_id, seg_start, user_start) whose starts and ends both differ by at most tolerance.

    segments and users have CallID, id, start, end.
    """
    s, u = _cells(_side(segments, "seg"), _side(users, "user"), tolerance)
    return _near(s, u, tolerance).select("CallID", "seg_id", "user_id", "seg_start", "user_start")


def user_segments(segments: DataFrame, users: DataFrame, tolerance: float = TOLERANCE_S, least: float = TEXT_RATIO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(CallID, seg_id, user_id): each segment, in order of start, takes the first user utterance near it whose text is alike and not taken.

    segments and users have CallID, id (unique within the call), start, end, text. Rows of a side with equal call, times and text are met and
    compared once, as one with many ids, so n such rows on both sides make n picks and not n * n pairs. Each task settles its calls in one pass.
    Candidates of a call that are more than twice the tolerance apart in time can't compete: a call with more than block_rows pairs is cut into
    clusters there, which go to several tasks.
    """
    def met(d: DataFrame, n: str) -> DataFrame:
        ids = F.array_sort(F.collect_set(f"{n}_id")).alias(f"{n}_ids")
        return d.where(F.col(f"{n}_text").isNotNull()).repartition("CallID", "_c").groupBy("CallID", "_c", f"{n}_start", f"{n}_end", f"{n}_text").agg(ids)

    s, u = _cells(_side(segments, "seg", "text"), _side(users, "user", "text"), tolerance)
    pairs = _near(met(s, "seg"), met(u, "user"), tolerance)
    a, b = F.col("seg_text"), F.col("user_text")
    n = F.length(a) + F.length(b)
    able = (n == 0) | (F.least(F.length(a), F.length(b)) * 200.0 >= n * least)  # the length alone rules out most
    r = F.coalesce(F.when(a == b, 100.0), similarity(F.when(a != b, a), F.when(a != b, b)))  # equal texts stay out of Python
    first = {"seg_id": F.col("seg_ids")[0], "user_id": F.col("user_ids")[0]}
    pairs = pairs.where(able).withColumn("r", r).where(F.col("r") >= least).withColumns(first).select("CallID", "seg_start", "seg_id", "user_start", "user_id", "seg_ids", "user_ids")
    keys, order = ["CallID"], ["seg_start", "seg_id", "user_start", "user_id"]
    d, b = blocked(pairs, keys, order, "align-pairs", block_rows)
    if b:
        d = running(d, keys, b, order, F.col("seg_start"), "max", "_p")
        d = d.withColumn("_n", F.when(F.col("_p").isNull() | (F.col("seg_start") > F.col("_p") + 4 * tolerance), F.struct("seg_start", "seg_id"))).drop("_p")
        d, keys = running(d, keys, b, order, F.col("_n"), "last", "cluster", inclusive=True), ["CallID", "cluster"]
    return d.repartition(*keys).select("CallID", *order, "seg_ids", "user_ids").sortWithinPartitions("CallID", *order).mapInArrow(_greedy, _TAKEN)


_TAKEN = "CallID string, seg_id bigint, user_id bigint"


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles pairs sorted by call, start of the segment, segment, start of the user and user. Rows that begin together take turns by id; of
    the users that are alike the one that began first is taken, then by id, so the ids of equal users go in their order and a count is enough."""
    table = lambda out: pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["CallID", "seg_id", "user_id"])
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    taken: dict[int, int] = {}
    last, out = None, []
    for (call, _), group in groupby(rows, key=lambda r: (r[0], r[1])):
        if call != last:
            taken, last = {}, call
        ids: dict[int, list[int]] = {}
        alike: dict[int, list[tuple[float, int, list[int]]]] = defaultdict(list)
        for _, _, s, user_start, u, seg_ids, user_ids in group:
            ids[s] = seg_ids
            alike[s].append((user_start, u, user_ids))
        for i, s in sorted((i, s) for s in ids for i in ids[s]):
            left = alike[s] = [x for x in alike[s] if taken.get(x[1], 0) < len(x[2])]
            if left:
                _, user, u = min((user_start, user_ids[taken.get(u, 0)], u) for user_start, u, user_ids in left)
                taken[u] = taken.get(u, 0) + 1
                out.append((call, i, user))
        if len(out) >= 10_000:
            yield table(out)
            out = []
    if out:
        yield table(out)


def window_candidates(prompt: str, segments: list[str], taken: list[bool], at: int, effective: list[int], prompt_at: int, known: dict[tuple[str, str], float] | None = None) -> Iterator[tuple[float, int, int]]:
    """(score, first segment, length) of the windows of 1 to MOST_SEGMENTS segments from place at on that resemble the prompt.

    Score: text ratio, plus 5 for each step nearer than NEAR + 1 that the window's place is to the prompt's, plus 5 for one segment,
    minus 10 for three or more. known keeps the ratios of text pairs.
    """
    known = {} if known is None else known
    text = ""
    for size in range(1, MOST_SEGMENTS + 1):
        i = at + size - 1
        if i >= len(segments) or taken[i]:
            return
        text = f"{text} {segments[i]}".strip()
        a, b = len(prompt), len(text)
        if a + b and 200.0 * min(a, b) / (a + b) < WINDOW_RATIO:
            continue
        r = known.get((prompt, text))
        if r is None:
            r = known[prompt, text] = ratio(prompt, text)
        if r < WINDOW_RATIO:
            continue
        d = abs(prompt_at - effective[at])
        yield r + max(0, NEAR - d + 1) * 5 * (d <= NEAR) + 5 * (size == 1) - 10 * (size >= 3), at, size


#: The score of an equal single segment far from the prompt; only near windows score more.
EQUAL = 105.0


class _Call:
    """What is left of a call's prompts and segments while its candidates are settled, best score first."""

    def __init__(self, prompts: list[str], segments: list[str], is_user: list[bool], words: list[list[Word]] | None = None):
        self.prompts, self.segments, self.is_user, self.words = prompts, segments, is_user, words
        self.speaker = speaker_of(words[0]) if words else None
        self.checked: dict[tuple[str, int, int, bool], bool] = {}
        self.used, self.done, self.out = list(is_user), [False] * len(prompts), []
        self.queue: dict[str, list[int]] = defaultdict(list)  # prompts left of each text, the first one last
        for p in reversed(range(len(prompts))):
            self.queue[prompts[p]].append(p)

    def windows(self) -> dict[tuple[int, str], list[int]]:
        """(number of segments, text) of the windows left, with their places, the first one last."""
        found = defaultdict(list)
        for at in reversed(range(len(self.segments))):
            text = ""
            for size in range(1, MOST_SEGMENTS + 1):
                if at + size > len(self.segments) or self.used[at + size - 1]:
                    break
                text = f"{text} {self.segments[at + size - 1]}".strip()
                found[size, text].append(at)
        return found

    def free(self, at: int, size: int) -> bool:
        return not any(self.used[at : at + size])

    def holds(self, prompt: str, at: int, size: int, score: float) -> bool:
        """True where the words that a window keeps at this score still resemble the prompt; without word lists the text has been compared already."""
        if not self.words or not any(self.words[at : at + size]):
            return True
        key = prompt, at, size, score >= FULL_SCORE
        if key not in self.checked:
            kept = kept_words(self.words[at : at + size], score, self.speaker)
            self.checked[key] = ratio(prompt, said(kept)[1]) >= WORD_RATIO
        return self.checked[key]

    def settle(self, score: float, near: dict[int, list[tuple[int, int]]], far: dict[str, list[tuple[int, list[int]]]]) -> None:
        """All candidates of one score, by prompt, length and place. near: prompt to windows; far: text to windows of each length and text.

        A window near a prompt that is left has been taken before its text's score without bonus comes up, so far needs no places of prompts.
        """
        heap = [(p, False, "") for p in near] + [(self.queue[t].pop(), True, t) for t in far if self.queue[t]]
        heapify(heap)
        while heap:
            p, queued, t = heappop(heap)
            if not self.done[p]:
                text = self.prompts[p]
                best = min((w for w in near.get(p, ()) if self.free(w[1], w[0]) and self.holds(text, w[1], w[0], score)), default=None)
                for size, places in far.get(text, ()):
                    while places and not self.free(places[-1], size):
                        places.pop()  # what is taken stays taken
                    first = next((at for at in reversed(places) if self.free(at, size) and self.holds(text, at, size, score)), None)
                    if first is not None and (best is None or (size, first) < best):
                        best = size, first
                if best is not None:
                    size, at = best
                    self.done[p] = True
                    self.used[at : at + size] = [True] * size
                    self.out.append((p, at, size, score))
                elif queued:
                    self.queue[t].append(p)  # nothing is left for its text at this score
                    continue
            if queued and self.queue[t]:
                heappush(heap, (self.queue[t].pop(), True, t))


def speaker_of(words: list[Word]) -> str | None:
    """The speaker of most words, of several the one who speaks first; None where no word names one."""
    n: dict[str, int] = {}
    for w in words:
        if w[1]:
            n[w[1]] = n.get(w[1], 0) + 1
    return max(n, key=n.get) if n else None


def kept_words(words: list[list[Word]], score: float, speaker: str | None) -> list[Word]:
    """The words of a window that are the agent's: all from FULL_SCORE on or where no speaker is known, else those of the speaker."""
    flat = [w for ws in words for w in ws]
    return flat if score >= FULL_SCORE or speaker is None else [w for w in flat if w[1] == speaker]


def said(words: list[Word]) -> tuple[str, str]:
    """What words say, with numbers in words, and its matching key."""
    _, text, key = spoken_form(" ".join(w[0] or "" for w in words).strip())
    return text or "", key or ""


def align_call(prompts: list[str], segments: list[str], is_user: list[bool], words: list[list[Word]] | None = None) -> list[tuple[int, int, int, float]]:
    """(prompt, first segment, number of segments, score), one to one: the best score first, ties by prompt, length and place.

    With words, a list for each segment, a candidate counts only if the words that it keeps (all from FULL_SCORE on, else those of the agent, who
    is the main speaker of the first segment) resemble the prompt by WORD_RATIO; otherwise the next best takes its place.

    All prompts of the call meet all its windows, but no list of pairs is made: near windows (at most NEAR places away) are listed, of the
    others each distinct text is compared once with each distinct prompt. What scores EQUAL or more is settled first, as equal texts need no
    comparing; only prompts and windows left by then are compared.
    """
    call = _Call(prompts, segments, is_user, words)
    agents = [i for i, x in enumerate(is_user) if not x]
    effective, n = [], 0
    for x in is_user:
        effective.append(n)
        n += not x
    known: dict[tuple[str, str], float] = {}
    near: dict[float, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for p, text in enumerate(prompts):
        for i in agents[max(0, p - NEAR) : p + NEAR + 1]:
            for s, at, size in window_candidates(text, segments, is_user, i, effective, p, known):
                near[s][p].append((size, at))
    equal = {t: [(1, places)] for (size, t), places in call.windows().items() if size == 1 and t in call.queue}
    for s in sorted({*near, EQUAL}, reverse=True):
        if s >= EQUAL:
            call.settle(s, near.get(s, {}), equal if s == EQUAL else {})

    texts, windows = [t for t, q in call.queue.items() if any(not call.done[p] for p in q)], list(call.windows().items())
    lengths = np.array([len(t) for (_, t), _ in windows], dtype="int64")
    extra = np.array([5 * (size == 1) - 10 * (size >= 3) for (size, _), _ in windows], dtype="int64")
    scores, at_text, at_window = [np.empty(0)], [np.empty(0, "int32")], [np.empty(0, "int32")]
    for k, t in enumerate(texts):
        n = lengths + len(t)
        able = np.flatnonzero(200 * np.minimum(lengths, len(t)) >= WINDOW_RATIO * n)  # the length alone rules out many
        r = np.array([known.get((t, windows[w][0][1])) or ratio(t, windows[w][0][1]) for w in able], dtype="float64")
        able, r = able[r >= WINDOW_RATIO], r[r >= WINDOW_RATIO]
        scores.append(r + extra[able])
        at_text.append(np.full(len(able), k, "int32"))
        at_window.append(able.astype("int32"))
    score, text, window = np.concatenate(scores), np.concatenate(at_text), np.concatenate(at_window)
    order = np.argsort(-score, kind="stable")
    score, text, window = score[order], text[order], window[order]
    for s in sorted({x for x in near if x < EQUAL} | set(score.tolist()), reverse=True):
        far = defaultdict(list)
        for j in range(np.searchsorted(-score, -s, "left"), np.searchsorted(-score, -s, "right")):
            far[texts[text[j]]].append((windows[window[j]][0][0], windows[window[j]][1]))
        call.settle(s, near.get(s, {}), far)
    return sorted(call.out)


RESULT = "CallID string, prompt_id bigint, first_seg bigint, n_segments bigint, score double, StartTime double, EndTime double, Transcript string"


def align_prompts(prompts: DataFrame, segments: DataFrame) -> DataFrame:
    """(CallID, prompt_id, first_seg, n_segments, score, StartTime, EndTime, Transcript), a row per prompt.

    prompts: CallID, id, place, text; segments: CallID, id, place, text, is_user and, where known, start, end and words (array of word, start, end,
    speaker). StartTime is that of the first word kept and EndTime that of the last, those of the window's segments where it has no words;
    Transcript is what the kept words say, with numbers in words. Prompts that find no segment have nulls and their own text. A call is settled
    as a whole in one task, because any of its prompts may compete for any of its segments.
    """
    none = F.lit(None).cast("double")
    has = lambda c, other: F.col(c) if c in segments.columns else other.alias(c)
    nothing = F.lit(None).cast("array<struct<word: string, start: double, end: double, speaker: string>>")
    p = prompts.where("CallID is not null").select("CallID", F.lit(0).alias("kind"), "id", "place", "text", F.lit(False).alias("is_user"), none.alias("start"), none.alias("end"), nothing.alias("words"))
    s = segments.where("CallID is not null").select("CallID", F.lit(1).alias("kind"), "id", "place", "text", "is_user", has("start", none), has("end", none), has("words", nothing))

    def call(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["kind", "place", "id"])
        a, b = f[f["kind"] == 0], f[f["kind"] == 1]
        number = lambda x: None if pd.isna(x) else float(x)
        words = [[(w["word"], w["speaker"], w["start"], w["end"]) for w in ws] if ws is not None else [] for ws in b["words"]]
        texts, raw = [matching_key(x or "") for x in a["text"]], [x or "" for x in b["text"]]
        speaker = speaker_of(words[0]) if words else None
        got = {x[0]: x for x in align_call(texts, [matching_key(x) for x in raw], list(b["is_user"]), words if any(words) else None)}
        ids, start, end = list(b["id"]), list(b["start"]), list(b["end"])
        rows = []
        for k, (c, i, text) in enumerate(zip(a["CallID"], a["id"], a["text"], strict=True)):
            if k not in got:
                rows.append((c, i, None, None, None, None, None, spoken_form(text)[1]))
                continue
            _, at, size, score = got[k]
            kept = kept_words(words[at : at + size], score, speaker)
            if kept:
                rows.append((c, i, ids[at], size, score, number(kept[0][2]), number(kept[-1][3]), said(kept)[0]))
            else:
                rows.append((c, i, ids[at], size, score, number(start[at]), number(end[at + size - 1]), spoken_form(" ".join(raw[at : at + size]))[1]))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
        return out.astype({"first_seg": "Int64", "n_segments": "Int64", "score": "float64", "StartTime": "float64", "EndTime": "float64"})

    return p.unionByName(s).groupBy("CallID").applyInPandas(call, RESULT)
