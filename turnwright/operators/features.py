"""Feature columns: routing by name, standardising, principal components, vectors and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.operators.ordered import place


# The groups of feature columns, in order: words that a name must hold, words that it must not hold, and whose share of variance holds.
GROUPS = {
    "utterance_sbert": (("utterance", "sbert"), (), "systemf_text"),
    "utterance_roberta": (("utterance", "roberta"), (), "systemf_text"),
    "utterance_todbert": (("utterance", "tod_bert"), (), "systemf_text"),
    "prompt_sbert": (("prompt", "sbert"), (), "systemf_text"),
    "prompt_roberta": (("prompt", "roberta"), (), "systemf_text"),
    "prompt_todbert": (("prompt", "tod_bert"), (), "systemf_text"),
    "speechf_sbert": (("minilm",), ("utterance", "prompt"), "speechf_text"),
    "speechf_roberta": (("roberta",), ("utterance", "prompt"), "speechf_text"),
    "speechf_todbert": (("tod_bert",), ("utterance", "prompt"), "speechf_text"),
    "speechf_wav2vec": (("wav2vec",), (), "speechf_wav"),
    "speechf_hubert": (("hubert",), (), "speechf_wav"),
    "speechf_wavlm": (("wavlm",), (), "speechf_wav"),
}


def route(columns: list[str], rules: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> dict[str, list[str]]:
    """Columns of each group: names, in lower case, that contain all words of the first tuple and none of the second. A column may be in several."""
    return {g: [c for c in columns if all(w in c.lower() for w in inc) and not any(w in c.lower() for w in exc)] for g, (inc, exc) in rules.items()}


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, nulls left out, in one pass; no deviation counts as 1."""
    if not columns:
        return {}
    r = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - m) / s for c, (m, s) in fitted.items()})


def standardise_vector(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Each place of an array column less its mean, over its population deviation; moments come from fit_on (else df), one row per place."""
    per = (fit_on or df).select(F.posexplode(column).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    r = sorted(per.collect(), key=lambda x: x["p"])  # as many rows as the vector has places
    mean, dev = F.lit([x["m"] for x in r]), F.lit([x["s"] or 1.0 for x in r])
    return df.withColumn(column, F.zip_with(F.zip_with(F.col(column).cast("array<double>"), mean, lambda a, b: a - b), dev, lambda a, b: a / b))


def principal_components(train: DataFrame, frames: list[DataFrame], column: str, share: float) -> list[DataFrame]:
    """Each frame with column replaced by as few leading components as hold more than share of the variance of train (standardised on it)."""
    if not 0 < share < 1:
        raise ValueError("the share of variance must lie between 0 and 1")
    size = train.select(F.max(F.size(column))).first()[0]
    fit = standardise_vector(train, column).withColumn("_v", array_to_vector(column))
    model = PCA(k=size, inputCol="_v", outputCol="_c").fit(fit)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share, side="right")) + 1
    out = []
    for f in frames:
        x = standardise_vector(f, column, train).withColumn("_v", array_to_vector(column))
        out.append(model.transform(x).withColumn(column, F.slice(vector_to_array("_c"), 1, min(k, size))).drop("_v", "_c"))
    return out


def scale_and_reduce(train: DataFrame, frames: list[DataFrame], shares: dict[str, float | None], kept: tuple[str, ...] = ("CallID", "IQMedian"), groups=None) -> list[DataFrame]:
    """Each frame with its feature columns standardised on train and, group by group, replaced by principal components of train.

    shares: for each kind of group the share of variance that its components hold together; None or an absent kind keeps all components. Columns
    of a group become <group>__pca0, ...; a column may be in several groups; columns in none are only standardised, as non_pca__<column>. IQMedian
    is counted from 0. Nulls count as the column's mean. All frames have the columns of train.
    """
    groups = GROUPS if groups is None else groups
    columns = [c for c in train.columns if c not in kept]
    routed = route(columns, {g: rule[:2] for g, rule in groups.items()})
    rest = [c for c in columns if not any(c in cs for cs in routed.values())]
    fitted = moments(train, columns)
    z = lambda c: F.coalesce((F.col(f"`{c}`").cast("double") - fitted[c][0]) / fitted[c][1], F.lit(0.0))
    own = [F.col(c) - 1 if c == "IQMedian" else F.col(c) for c in kept if c in train.columns]
    names = [c for c in kept if c in train.columns]
    vectors = [F.array(*[z(c) for c in cs]).alias(g) for g, cs in routed.items() if cs]
    lay = lambda f: f.select(*[c.alias(n) for c, n in zip(own, names, strict=True)], *[z(c).alias(f"non_pca__{c}") for c in rest], *vectors)
    fit, out = lay(train), [lay(f) for f in frames]
    for g, cs in routed.items():
        if not cs:
            continue
        model = PCA(k=len(cs), inputCol="_v", outputCol="_c").fit(fit.select(array_to_vector(g).alias("_v")))
        share = shares.get(groups[g][2])
        n = len(cs) if share is None else min(len(cs), int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share, side="right")) + 1)
        for i, f in enumerate(out):
            x = model.transform(f.withColumn("_v", array_to_vector(g))).withColumn("_c", vector_to_array("_c"))
            out[i] = x.withColumns({f"{g}__pca{k}": F.get("_c", F.lit(k)) for k in range(n)}).drop("_v", "_c", g)
    return out


def tensor_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (min, max, mean, std) over all values of all columns together; the deviation is that of a sample, nulls don't count."""
    one = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count), ("s", F.sum), ("v", F.var_pop))])
    col = lambda n: [F.col(f"{n}{i}") for i in range(len(columns))]
    total = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n, mean = total(col("n")), F.try_divide(total(col("s")), total(col("n")))
    spread = total([c * (v + F.pow(F.try_divide(s, c) - mean, 2)) for c, v, s in zip(col("n"), col("v"), col("s"), strict=True)])
    return one.select(F.least(*col("lo"), F.lit(None)).alias("min"), F.greatest(*col("hi"), F.lit(None)).alias("max"), mean.alias("mean"), F.sqrt(F.try_divide(spread, n - 1)).alias("std"))


def expand(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    """An array column as size columns name0, name1, ...; places beyond its end are null."""
    return df.select("*", *[F.get(F.col(column), F.lit(i)).alias(f"{name}{i}") for i in range(size)]).drop(column)


def mean_pool(vectors: Column, mask: Column | None = None) -> Column:
    """The mean of an array of equal-length vectors, over those whose mask is true; null if there is none."""
    kept = vectors if mask is None else F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, 1_000_000_000), F.get(kept, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def pad(values: Column, size: int, filler: float) -> Column:
    """The first size values, or all followed by filler."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler), size)), 1, size)


def longest(df: DataFrame, column: str) -> int:
    """The length of the longest array of column; 0 if there is none."""
    return df.agg(F.max(F.size(column))).first()[0] or 0


def pad_all(df: DataFrame, column: str, filler: float = 0.0) -> DataFrame:
    """df with padded, whole arrays filled up to the longest, and mask, true where a place holds a value of the array."""
    size = longest(df, column)
    return df.withColumn("padded", pad(F.col(column), size, filler)).withColumn("mask", F.transform(F.slice(F.sequence(F.lit(0), F.lit(size)), 2, size), lambda i: i <= F.size(column)))


def filled_rows(vectors: Column) -> Column:
    """True for each vector that isn't all zeros."""
    return F.transform(vectors, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)) > 1e-9)


def chunks(df: DataFrame, part: str, ordinal: str, size: int) -> DataFrame:
    """df plus chunk_no and place_in_chunk: rows of a part in order of ordinal (unique in it, whole), cut into chunks of size rows."""
    d = place(df.where(F.col(part).isNotNull() & F.col(ordinal).isNotNull()), [part], [ordinal], "_n")
    return d.withColumn("chunk_no", F.floor(F.col("_n") / size)).withColumn("place_in_chunk", F.col("_n") % size).drop("_n")


def warm_up_trim(df: DataFrame, part: str, ordinal: str, skip: int = 2) -> DataFrame:
    """df without the first skip rows of each part."""
    return place(df.where(F.col(part).isNotNull()), [part], [ordinal], "_n").where(F.col("_n") >= skip).drop("_n")
