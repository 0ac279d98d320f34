"""Text functions: clean-up, matching keys, number words, similarity, first keys of parses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwright.functions.parses import nested_counts

# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion"]
# What is said in words, in the order in which it is replaced: route names, hours of half a day, clock times, three digits, the rest;
# and what doesn't count in matching keys.
ROUTE = re.compile(r"\b(\d+)([a-zA-Z]+)\b")
HALF_DAY = re.compile(r"\b(\d+)\s*(a\.?m\.?|p\.?m\.?)\b")
CLOCK = re.compile(r"\b(\d{1,2}):(\d{2})\b")
THREE = re.compile(r"\b(\d{3})\b")
NUMBER = re.compile(r"\b(\d+)\b")
NO_KEY = re.compile(r"[^a-z0-9\s]")
#: An all-capital word that is a name and stays as it is.
KEPT_CAPITALS = "CMU"


def number_words(text: str) -> str:
    """English words for a whole number, with 'and' after hundreds and commas between groups of three digits; other texts unchanged."""
    try:
        n = int(text)
    except (TypeError, ValueError):
        return text
    if n < 0:
        return "minus " + number_words(str(-n))
    if n >= 1000 ** len(SCALES):
        return " ".join(ONES[int(c)] for c in str(n))
    if n == 0:
        return ONES[0]
    groups = []
    while n:
        n, g = divmod(n, 1000)
        groups.append(g)
    said = [f"{_below_thousand(g)} {SCALES[i]}".strip() for i, g in reversed(list(enumerate(groups))) if g]
    if len(groups) > 1 and 0 < groups[0] < 100:
        return ", ".join(said[:-1]) + " and " + said[-1]
    return ", ".join(said)


@F.pandas_udf(T.StringType())
def in_words(numbers: pd.Series) -> pd.Series:
    """number_words() of each text; null for null."""
    done: dict = {}
    return pd.Series([None if t is None else done[t] if t in done else done.setdefault(t, number_words(t)) for t in numbers.where(numbers.notna(), None)])


def _below_thousand(n: int) -> str:
    h, r = divmod(n, 100)
    rest = ONES[r] if r < 20 else TENS[r // 10] + (f" {ONES[r % 10]}" if r % 10 else "")
    if not h:
        return rest
    return f"{ONES[h]} hundred" + (f" and {rest}" if r else "")


def _clock(m: re.Match) -> str:
    hour, minute = number_words(m[1]), int(m[2])
    return hour if minute == 0 else f"{hour} oh {ONES[minute]}" if minute < 10 else f"{hour} {number_words(m[2])}"


def _three(m: re.Match) -> str:
    a, b, c = m[1]
    return f"{ONES[int(a)]} oh {ONES[int(c)]}" if b == "0" and c != "0" and a != "0" else number_words(m[1])


def spoken_form(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(text, text with numbers in words, matching key). Route names come before a.m. and p.m., those before clock times."""
    if text is None:
        return None, None, None
    t = ROUTE.sub(lambda m: f"{number_words(m[1])} {m[2]}", text)
    t = HALF_DAY.sub(lambda m: f"{number_words(m[1])} {' '.join(m[2])}", t)
    t = CLOCK.sub(_clock, t)
    t = THREE.sub(_three, t)
    t = NUMBER.sub(lambda m: number_words(m[1]), t)
    t = re.sub(r"\s+", " ", t).strip()
    return text, t, matching_key(t)


def matching_key(text: str) -> str:
    return re.sub(r"\s+", " ", NO_KEY.sub(" ", text.lower())).strip()


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "output", "key")]))
def standardise(texts: pd.Series) -> pd.DataFrame:
    done: dict = {}
    rows = [done[t] if t in done else done.setdefault(t, spoken_form(t)) for t in texts.where(texts.notna(), None)]
    return pd.DataFrame(rows, columns=["raw", "output", "key"])


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one long number."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity 0..100: twice the common subsequence over both lengths; two empty texts are alike."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs(a, b) / n


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def prompt_key(c: Column) -> Column:
    """Prompt text for matching: lower case, no blank before punctuation at the end of a word, single blanks. Null stays null."""
    t = F.regexp_replace(F.lower(c), r"(?U)\s+([?.!,'\"])(?=\s|$)", "$1")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tidy_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def clean_agent(c: Column) -> Column:
    """Agent text: blanks tidied, the letter behind a route number in capitals wherever the number stands, all-capital words in title case.

    What a word is compared by ends with its last letter, digit or underscore; marks behind that stay as they are.
    """
    t = tidy_blanks(c)
    routes = t
    for letter in "abcdefghijklmnopqrstuvwxyz":
        routes = F.regexp_replace(routes, rf"(?U)(?<=\d){letter}(?!\w)", letter.upper())
    t = F.when(t.rlike(r"(?U)\d[a-z](?!\w)"), routes).otherwise(t)

    def word(w: Column) -> Column:
        core = F.regexp_replace(w, r"(?U)\W+$", "")
        tail = F.substr(w, F.length(core) + 1)
        shout = (F.length(core) > 1) & (F.upper(core) == core) & (F.lower(core) != core) & (core != KEPT_CAPITALS)
        title = F.concat(F.upper(F.substring(core, 1, 1)), F.lower(F.substr(core, F.lit(2))), tail)
        return F.when(core.rlike(r"(?U)^\d+[a-zA-Z]$"), F.concat(F.upper(core), tail)).when(shout, title).otherwise(w)

    return F.when(t.rlike(r"(?U)[\p{Lu}\d]"), F.array_join(F.transform(F.split(t, " "), word), " ")).otherwise(t)


def has_word(c: Column, word: str) -> Column:
    """True where the word occurs between word boundaries, in any case; null counts as no."""
    return F.coalesce(c.rlike(rf"(?i)\b\Q{word}\E\b"), F.lit(False))


def first_key(c: Column) -> Column:
    """The first key of a parse in bracket notation: the first name of the innermost group left open, or of the text if all are closed; names in
    closed groups are no keys of what lies around them. Empty where there is none, null for null."""
    t = F.when(F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))) == "semantic no match", "semantic_no_match").otherwise(c)
    tokens = F.regexp_extract_all(t, F.lit(r"(?U)([()]|\w+\[.*?\]|\w+)"), F.lit(1))

    def step(first: Column, token: Column) -> Column:  # first: the first name of each open group, the innermost last
        last = F.element_at(first, -1)
        without = F.slice(first, 1, F.size(first) - 1)
        named = F.concat(without, F.array(F.regexp_extract(token, r"(?U)^\w+", 0)))
        closed = F.when(F.size(first) > 1, without).otherwise(first)
        return F.when(token == "(", F.concat(first, F.array(F.lit("")))).when(token == ")", closed).when(last == "", named).otherwise(first)

    return F.element_at(F.aggregate(tokens, F.array(F.lit("")), step), -1)


@F.pandas_udf(T.StringType())
def semantic_counts(parses: pd.Series) -> pd.Series:
    """nested_counts() of each parse as JSON; null for null."""
    done: dict = {}
    return pd.Series([None if t is None else done[t] if t in done else done.setdefault(t, json.dumps(nested_counts(t), ensure_ascii=False)) for t in parses.where(parses.notna(), None)])


def model_tag(name: str, short: bool = True) -> str:
    """Column prefix of a model: the last part of its path with underscores; the small sentence encoder is called sbert."""
    tag = name.rsplit("/", 1)[-1].replace("-", "_")
    return "sbert" if short and "MiniLM" in tag else tag


def pca_tag(share: float | None) -> str:
    """Share of variance in file names: tenfold and rounded; none for none."""
    return "" if share is None else str(round(share * 10))
