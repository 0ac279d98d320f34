"""Clean speaker turns from transcripts with stamps, hesitations, annotations and loose speaker labels."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnwright.functions.ids import MISSING, present
from turnwright.operators.ordered import BLOCK_ROWS, blocked, position, running
from turnwright.operators.skew import salted_join
from turnwright.session import stage

# Words that name a speaker's role.
ANCHORS = {
    "user": ("user", "caller", "rider", "customer", "passenger", "client", "human"),
    "agent": ("agent", "system", "bot", "machine", "robot", "assistant", "computer", "dialogue system", "ivr"),
    "other": ("other", "bystander", "background", "background speaker", "third party", "others"),
}
# Hesitation sounds, written with any number of repeated letters.
HESITATION = r"(?:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m{2,}|m+h+m+|a+h+|hu+h+)"
# Time stamps.
STAMP = r"(?:[\[(<]\s*\d[\d:.,]*\s*(?:s|sec)?\s*[\])>]|\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s*-+>\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?)?)"
# Brackets that hold annotations of sounds or of something unintelligible.
ANNOTATION = r"(?:\(\([^)]*\)\)|\[[^\]]*\]|\([^)]*\)|<[^>]*>|\*[^*]*\*|\{[^}]*\}|\+\+[^+]*\+\+)"
#: A label that opens a text: [user], User: or User> or user - before the speech.
LABEL = r"(?iU)^[\s\p{Punct}&&[^\[]]*(?:\[\s*([a-z][a-z ]{0,30}(?:_?\d+)?)\s*\]|([a-z][a-z ]{0,30}(?:_?\d+)?)\s*[:>](?!\d)|([a-z][a-z ]{1,30}(?:_?\d+)?)\s+-\s)"
NOTHING = ("nan", "none", "null", "na", "n/a")
#: Rows whose speech is put together in one text; a longer turn has several.
PART_ROWS = 10_000


def label_key(c: Column) -> Column:
    """A label in lower case without digits, punctuation and outer blanks; null where none is left or it stands for a missing one."""
    k = F.trim(F.regexp_replace(F.lower(present(c)), r"(?U)[^\p{L}]+", " "))
    return F.when(c.rlike("^[a-z]+$") & ~c.isin(*MISSING), c).otherwise(_where(k, lambda x: x != ""))


def _where(v: Column, test) -> Column:
    """v where the test holds, else null, with v computed only once."""
    return F.get(F.filter(F.array(v), test), F.lit(0))


def without_stamps(c: Column) -> Column:
    """The text with single plain blanks and without time stamps."""
    t = F.when(c.rlike("[^!-~ ]|  "), F.regexp_replace(c, r"(?U)[\s ​﻿]+", " ")).otherwise(c)
    return F.trim(F.when(c.rlike("[0-9]"), F.regexp_replace(t, r"(?i)" + STAMP, " ")).otherwise(t))


def opening_label(stripped: Column) -> Column:
    """The label that opens a text freed from stamps: a word for a role, an initial or an abbreviation without vowels; other words are speech."""
    found = label_key(F.concat(F.regexp_extract(stripped, LABEL, 1), F.regexp_extract(stripped, LABEL, 2), F.regexp_extract(stripped, LABEL, 3)))
    words = "|".join(w for ws in ANCHORS.values() for w in ws)
    sure = rf"^(?:{words}|[a-z]|(?!{HESITATION}$)[^aeiou\s]{{2,4}})$"
    return F.when(stripped.rlike(r"[\[:>]| - ") & stripped.rlike(LABEL), _where(found, lambda x: x.rlike(sure)))  # none does without these marks


def clean_speech(stripped: Column, labelled: Column) -> Column:
    """The speech of a text freed from stamps, without its label (if labelled), annotations and hesitations; null where no word is left."""
    sound = r"(?iU)(?<![\p{L}\p{N}'])" + HESITATION + r"(?![\p{L}\p{N}'])(?:\s*[,.…]+)?"
    t = F.when(labelled, F.regexp_replace(stripped, LABEL, " ")).otherwise(stripped)
    t = F.regexp_replace(F.regexp_replace(t, ANNOTATION, " "), sound, " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.?!…])", "$1"), r"\s+", " "))
    t = F.regexp_replace(t, r"^[\s,.?!…:;-]+", "")
    t = F.regexp_replace(t, r"([,.?!…])[,.…]+$", "$1")
    # a text of letters, digits and blanks has no label, annotation or punctuation: only hesitations and the blanks they leave
    plain = F.trim(F.regexp_replace(F.regexp_replace(stripped, sound, " "), r"\s+", " "))
    plain = F.when(stripped.rlike(sound), plain).otherwise(stripped)
    t = F.when(labelled | stripped.rlike("[^A-Za-z0-9' ]|  "), t).otherwise(plain)
    stand_in = lambda x: ~x.rlike("[A-Za-z]{5}") & F.lower(F.regexp_replace(x, r"[^A-Za-z/]", "")).isin(*NOTHING)
    return _where(t, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~stand_in(x))


def resolve(labels: list[str]) -> dict[str, str]:
    """The role of each label of one transcript; labels that lead to no known word are left out.

    Labels and role words are the nodes of a union-find. A label is joined to the word that it equals, abbreviates (initials, prefix, or letters
    left out) or resembles most; then labels that begin alike and resemble each other are joined, known or not, unless that would join two roles.
    A set takes the role of its words.
    """
    words = [w for ws in ANCHORS.values() for w in ws]
    parent = {f"W:{w}": f"W:{w}" for w in words}
    role = {f"W:{w}": r for r, ws in ANCHORS.items() for w in ws}  # of the top of each set that has a word

    def top(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: str, y: str) -> None:
        a, b = top(x), top(y)
        if a != b and not (a in role and b in role and role[a] != role[b]):
            parent[a] = b
            if a in role:
                role[b] = role[a]

    begin: dict[str, list[str]] = {}
    for a in sorted(set(labels)):
        best = max(words, key=lambda w: (likeness(a, w), -words.index(w)))
        if likeness(a, best) >= 0.75:
            join("L:" + a, "W:" + best)
        begin.setdefault(a[:2], []).append(a)
    for alike in begin.values():
        for i, a in enumerate(alike):
            for b in alike[:i]:
                if top("L:" + a) != top("L:" + b) and likeness(a, b) >= 0.85:
                    join("L:" + a, "L:" + b)
    return {a: role[top("L:" + a)] for a in set(labels) if top("L:" + a) in role}


def likeness(a: str, word: str) -> float:
    """1 for the same label, 0.8 to 0.95 for an abbreviation, else the share of matching letters (0 if they begin differently)."""
    if a == word:
        return 1.0
    if not a or a[0] != word[0]:
        return 0.0
    flat, parts = a.replace(" ", ""), word.split()
    if len(parts) > 1 and flat == "".join(p[0] for p in parts):
        return 0.95
    if len(flat) <= 4 and word.startswith(flat):
        return 0.9
    if 2 <= len(flat) <= 4 and _skips(flat, word):
        return 0.8
    if word in a.split():
        return 0.9
    return SequenceMatcher(None, a, word).ratio()


def _skips(short: str, word: str) -> bool:
    rest = iter(word)
    return all(ch in rest for ch in short)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _resolve(sets: pd.Series) -> pd.Series:
    seen: dict[tuple, dict] = {}
    out = []
    for s in sets:
        k = tuple(sorted(s))
        if k not in seen:
            if len(seen) > 10_000:
                seen.clear()
            seen[k] = resolve(list(k))
        out.append(seen[k])
    return pd.Series(out)


def spoken(df: DataFrame, call: str, speaker: str, text: str) -> DataFrame:
    """df plus speaker_role and speech. Texts and labels are read once and staged. Names beginning with an underscore are reserved."""
    d = df.withColumn("_text", without_stamps(F.col(text)))
    d = d.withColumn("_speaker", label_key(F.col(speaker))).withColumn("_opens", opening_label(F.col("_text")))
    there = F.col(text).rlike("[!-~] [!-~]") | present(F.col(text)).isNotNull()  # no stand-in has two words
    d = stage(d.withColumn("_there", there), "p7-labels")
    found = d.where(F.col(call).isNotNull()).select(call, "_speaker", "_opens").distinct().select(call, F.explode(F.array_compact(F.array("_speaker", "_opens"))).alias("_l"))
    roles = found.distinct().groupBy(call).agg(F.collect_list("_l").alias("_ls")).select(call, _resolve("_ls").alias("_roles"))
    d = salted_join(d, roles, call, "left").select(*df.columns, "_text", "_speaker", "_opens", "_there", "_roles")
    named = F.when(F.col("_speaker").isNotNull(), F.coalesce(F.element_at("_roles", F.col("_speaker")), F.lit("other")))
    d = d.withColumn("_by_text", F.element_at("_roles", F.col("_opens"))).withColumn("speaker_role", F.coalesce(named, "_by_text", F.lit("user")))
    said = F.when(F.col("_there"), clean_speech(F.col("_text"), F.col("_by_text").isNotNull()))
    return d.withColumn("speech", said).drop("_text", "_speaker", "_opens", "_there", "_roles", "_by_text")


def turn_rows(df: DataFrame, call: str, key: str, start_ms: str, end_ms: str, pause_ms: int = 1500, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, str | None]:
    """Rows (call_id, k, s, t, speaker_role, speech, turn) of df, which has speaker_role and speech, and their column of blocks, if any.

    turn is the row (s, t, k) that begins the turn. A turn goes on while the role is the same and a row starts at most pause_ms after the latest
    end within the turn, in order of start, end and key. Rows without a call, a usable interval or speech are left out; rows with the same key
    count once (a missing key: the row itself). A call with more than block_rows rows is ordered in blocks with carried values.
    """
    d = df.select(F.col(call).alias("call_id"), F.coalesce(F.col(key).cast("bigint"), F.xxhash64(start_ms, end_ms, "speech")).alias("k"), F.col(start_ms).cast("bigint").alias("s"), F.col(end_ms).cast("bigint").alias("t"), "speaker_role", "speech")
    d = d.where("call_id is not null and s is not null and t > s and speech is not null").dropDuplicates(["call_id", "k"])
    order = ["s", "t", "k"]
    row = F.struct("s", "t", "k")
    x, b = blocked(d, ["call_id"], order, "p7-rows", block_rows)
    x = running(x, ["call_id"], b, order, F.col("speaker_role"), "last", "before")
    x = x.withColumn("change", F.when(F.col("before").isNull() | (F.col("before") != F.col("speaker_role")), row)).drop("before")
    x = running(x, ["call_id"], b, order, F.col("change"), "last", "run", inclusive=True).drop("change")
    # within a run of one role a row that starts a new turn does so after all earlier ends, so the latest end of the run is that of the turn;
    # runs rise along the order, so the largest pair of run and end is the latest end of the run at hand
    x = running(x, ["call_id"], b, order, F.struct("run", "t"), "max", "until")
    x = x.withColumn("change", F.when(F.col("until").isNull() | (F.col("until.run") != F.col("run")) | (F.col("s") > F.col("until.t") + pause_ms), row)).drop("until")
    return running(x, ["call_id"], b, order, F.col("change"), "last", "turn", inclusive=True).drop("change", "run"), b


def turns(df: DataFrame, call: str, key: str, start_ms: str, end_ms: str, **options) -> DataFrame:
    """Turns (call_id, speaker_role, start_ms, end_ms, n_rows); see turn_rows for what counts."""
    rows, _ = turn_rows(df, call, key, start_ms, end_ms, **options)
    return rows.groupBy("call_id", "turn", "speaker_role").agg(F.min("s").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("n_rows")).drop("turn")


def turn_texts(df: DataFrame, call: str, key: str, start_ms: str, end_ms: str, part_rows: int = PART_ROWS, **options) -> DataFrame:
    """turns() plus part_no and text: the speech of a turn in order, in parts of at most part_rows rows, so that no text grows with its call."""
    rows, b = turn_rows(df, call, key, start_ms, end_ms, **options)
    order = ["s", "t", "k"]
    rows = position(rows, ["call_id"], b, order, "at")
    rows = running(rows, ["call_id"], b, order, F.when(F.struct(*order) == F.col("turn"), F.col("at")), "last", "began", inclusive=True)
    rows = rows.withColumn("part_no", (F.floor((F.col("at") - F.col("began")) / part_rows) + 1).cast("int"))
    said = F.array_sort(F.collect_list(F.struct("at", "speech")))
    parts = rows.groupBy("call_id", "turn", "speaker_role", "part_no").agg(F.min("s").alias("s"), F.max("t").alias("t"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(said, lambda r: r["speech"]), " ").alias("text"))
    w = Window.partitionBy("call_id", "turn")
    return parts.select("call_id", "speaker_role", F.min("s").over(w).alias("start_ms"), F.max("t").over(w).alias("end_ms"), F.sum("n").over(w).alias("n_rows"), "part_no", "text")
