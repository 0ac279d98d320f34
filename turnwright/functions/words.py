"""Column functions over the word lists of transcripts: array<struct<word, start, end, speaker>>, and over runs of segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_words(segments: Column) -> Column:
    """The words of an array of segments one after the other; segments without words add none."""
    return F.flatten(F.transform(segments, lambda s: F.coalesce(s["words"], F.slice(F.array(F.struct(F.lit("").alias("word"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit("").alias("speaker"))), 1, 0))))


def of_speaker(words: Column, speaker: Column) -> Column:
    """The words of one speaker; none for a null speaker."""
    return F.filter(words, lambda w: F.coalesce(w["speaker"] == speaker, F.lit(False)))


def shifted_words(words: Column, offset: Column) -> Column:
    """Words with the offset in seconds added to their times; a word without times keeps none."""
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), (w["start"] + offset).alias("start"), (w["end"] + offset).alias("end"), w["speaker"].alias("speaker")))


def words_text(words: Column) -> Column:
    """The words with blanks between them."""
    return F.trim(F.array_join(F.transform(words, lambda w: w["word"]), " "))


def main_speaker(words: Column) -> Column:
    """The speaker of most words, of several the one who speaks first; null where no word names one."""
    named = F.filter(F.transform(words, lambda w: w["speaker"]), lambda s: s.isNotNull() & (s != ""))
    counts = F.transform(F.array_distinct(named), lambda s, i: F.struct(F.size(F.filter(named, lambda x: x == s)).alias("n"), (-i).alias("at"), s.alias("speaker")))
    return F.get(F.transform(F.array(F.array_max(counts)), lambda x: x["speaker"]), F.lit(0))


def places(start: Column, size: Column) -> Column:
    """The places start, start + 1, ... of a window of size segments; none for size 0."""
    return F.slice(F.sequence(start, start + size), F.lit(1), size)


def none_taken(window: Column, taken: Column) -> Column:
    """True where no place of the window is true in taken (places from 0; those beyond its end aren't taken)."""
    return ~F.exists(window, lambda i: F.coalesce(F.get(taken, i), F.lit(False)))
