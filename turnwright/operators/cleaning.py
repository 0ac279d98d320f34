"""Cleaning of log tables: coercion, categories, ids, missing values, columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwright.functions.ids import tidy

# Texts that mean a missing value, in cleaning and filtering and in extraction.
VOCABULARY = ("", "<NA>", "nan", "NA", "null", "None", "\\N", " ")
VOCABULARY_EXTRACTION = ("", " ", "nan", "NaN", "N/A", "None", "null", "NULL", "none")
# Synonyms of recogniser states and modalities, and the prefix of activities.
STATUS = {"no input": "timeout", "no match": "reject", "complete": "success"}
MODALITY = {"voice": "speech"}
ACTIVITY_PREFIX = "/LetsGoPublic/PerformTask/"


def number(c: Column) -> Column:
    """A trimmed text as a double; what isn't one, NaN too, becomes null."""
    x = tidy(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def remap(c: Column, names: dict[str, str]) -> Column:
    """Whole values replaced by a dictionary; others stay."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def empty_to(c: Column, label: str) -> Column:
    """Only the empty text becomes label; null stays."""
    return F.when(c == "", label).otherwise(c)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1_000_000)).otherwise(c)


def repair_id(c: Column) -> Column:
    """'0' put in after the second character."""
    return F.concat(F.substring(c, 1, 2), F.lit("0"), F.substring(c, 3, 1_000_000))


def plain_id(c: Column) -> Column:
    """An id as text, without blanks around it and without a trailing .0."""
    return F.regexp_replace(tidy(c.cast("string")), r"\.0$", "")


def clean_categories(df: DataFrame) -> DataFrame:
    """Log categories in one spelling: status and modality synonyms, activities without prefix, empty states named."""
    out = {}
    if "ASRRecognitionStatus" in df.columns:
        out["ASRRecognitionStatus"] = remap(empty_to(tidy(F.col("ASRRecognitionStatus")), "no status"), STATUS)
    if "Modality" in df.columns:
        out["Modality"] = remap(tidy(F.col("Modality")), MODALITY)
    if "Activity" in df.columns:
        out["Activity"] = without_prefix(tidy(F.col("Activity")), ACTIVITY_PREFIX)
    return df.withColumns(out)


def apply_vocabulary(df: DataFrame, vocabulary: Iterable[str] = VOCABULARY) -> DataFrame:
    """Texts of the vocabulary become null in every text column; NaN becomes null in every floating column."""
    words, out = list(vocabulary), {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(~c.isin(words), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(c), c)
    return df.withColumns(out)


def fill_texts(df: DataFrame, special: dict[str, str], rest: str = "missing") -> DataFrame:
    """Missing texts: the special columns get their own filling, all other text columns get rest."""
    out = {f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(special.get(f.name, rest))) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(out)


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_null) per column, and the row '*any*' with the rows that hold any null; one pass, no shuffle of rows."""
    cols = df.columns
    holds = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    some = F.count_if(F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in cols], F.lit(0)) > 0).alias("any")
    one = df.agg(*holds, some)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows, F.struct(F.lit("*any*").alias("column_name"), F.col("any").alias("n_null")))).alias("r")).select("r.*")


def drop_columns(df: DataFrame, exact: Iterable[str] = (), keywords: Iterable[str] = (), pattern: str | None = None) -> DataFrame:
    """df without columns that bear one of the exact names (in any case), contain a keyword, or match the pattern."""
    names, words = {x.lower() for x in exact}, list(keywords)
    gone = [c for c in df.columns if c.lower() in names or any(w in c for w in words) or (pattern and re.search(pattern, c))]
    return df.drop(*gone)


def columns_with(df: DataFrame, kept: Iterable[str], tags: Iterable[str]) -> DataFrame:
    """The kept columns, those whose name begins with non_pca, and those that contain one of the tags."""
    kept, tags = set(kept), [t for t in tags if t]
    return df.select([F.col(f"`{c}`") for c in df.columns if c in kept or c.startswith("non_pca") or any(t in c for t in tags)])


def categories(df: DataFrame, columns: list[str], most: int = 10_000) -> dict[str, list[str]]:
    """Sorted distinct values of each column (more than most is an error: such a column isn't a category)."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("x")
    found = df.select(one).select("x.*").where("v is not null").distinct().limit(most * len(columns) + 1).collect() if columns else []
    out = {c: sorted(r.v for r in found if r.c == c) for c in columns}
    for c, values in out.items():
        if len(values) > most or len(found) > most * len(columns):
            raise ValueError(f"{c} has more than {most} values")
    return out


def one_hot(df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None, prefix: str = "") -> DataFrame:
    """Boolean columns <column>_<value> for all values but the first in order; missing values are false everywhere. The columns go."""
    known = known or categories(df, columns)
    flags = [F.coalesce(F.col(f"`{c}`") == v, F.lit(False)).alias(f"{prefix}{c}_{v}") for c in columns for v in known[c][1:]]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *flags)


def type_report(df: DataFrame, least_repeat: float = 0.5) -> DataFrame:
    """(column_name, n, n_distinct, as_category): texts whose values repeat enough to be held as a dictionary."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, n bigint, n_distinct bigint, as_category boolean")
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(texts)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"d{i}").alias("n_distinct"), (F.try_divide(F.col(f"d{i}"), F.col("n")) < least_repeat).alias("as_category")) for i, c in enumerate(texts)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def memory_report(df: DataFrame) -> DataFrame:
    """(column_name, kind, n_bytes, n_bytes_narrow): bytes of each column as it is, and with doubles in single precision and long whole numbers as
    int where their values fit; texts count by their bytes, other kinds by the size that Spark takes them to have. One pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fixed = lambda c: int(df.select(F.col(f"`{c}`"))._jdf.schema().head().dataType().defaultSize())
    n = F.count(F.lit(1))
    whole, narrow = [], []
    for i, (c, k) in enumerate(kinds.items()):
        col = F.col(f"`{c}`")
        size = F.coalesce(F.sum(F.octet_length(col)), F.lit(0)) if isinstance(k, (T.StringType, T.BinaryType)) else n * fixed(c)
        fits = F.coalesce(F.max(F.abs(col)) < 2**31, F.lit(False)) if isinstance(k, T.LongType) else F.lit(isinstance(k, T.DoubleType))
        whole.append(size.cast("bigint").alias(f"w{i}"))
        narrow.append((F.when(fits, size / 2).otherwise(size) if isinstance(k, (T.LongType, T.DoubleType)) else size).cast("bigint").alias(f"n{i}"))
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k.simpleString()).alias("kind"), F.col(f"w{i}").alias("n_bytes"), F.col(f"n{i}").alias("n_bytes_narrow")) for i, (c, k) in enumerate(kinds.items())]
    return df.agg(*whole, *narrow).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def single_precision(c: Column) -> Column:
    return c.cast("float").cast("double")


def head(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows, for a look."""
    return df.orderBy(ordinal).limit(n)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where it has no value."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
