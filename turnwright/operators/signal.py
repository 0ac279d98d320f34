"""Deterministic array arithmetic of the audio side, and the seam for models that are not part of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Target loudness and the smallest loudness added to each segment.
TARGET_RMS, LEAST_RMS = 0.07, 1e-6


def frame(t: Column, rate: float, n: Column) -> Column:
    """The sample at a time in seconds, within the signal."""
    return F.greatest(F.lit(0), F.least((t * rate).cast("int"), n))


def rms(samples: Column) -> Column:
    """Root mean square of an array plus LEAST_RMS; null if it is empty."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)) + LEAST_RMS)


def loudness(samples: Column, segments: Column, rate: float) -> Column:
    """RMS over segments (array of start and end in seconds), weighted by their length; empty segments don't count."""
    cut = F.transform(segments, lambda s: F.slice(samples, frame(s["start"], rate, F.size(samples)) + 1, F.greatest(F.lit(0), frame(s["end"], rate, F.size(samples)) - frame(s["start"], rate, F.size(samples)))))
    full = F.filter(cut, lambda x: F.size(x) > 0)
    weighed = F.aggregate(full, F.lit(0.0), lambda a, x: a + rms(x) * F.size(x))
    n = F.aggregate(full, F.lit(0), lambda a, x: a + F.size(x))
    return F.try_divide(weighed, n)


def normalise(samples: Column, level: Column) -> Column:
    """Samples brought to TARGET_RMS and clipped to [-1, 1]; unchanged where there is no level."""
    return F.when(level.isNull(), samples.cast("array<double>")).otherwise(F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * (F.lit(TARGET_RMS) / level)))))


def with_noise(samples: Column, seed: int, scale: float = 0.05) -> Column:
    """Samples plus normal noise from a hash of the place (the same for every run), clipped to [-1, 1]."""
    u = lambda i, k: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    g = lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * np.pi * u(i, 1))
    return F.transform(samples, lambda x, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") + scale * g(i))))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


@F.pandas_udf(T.DoubleType())
def lag_samples(a: pd.Series, b: pd.Series) -> pd.Series:
    """The shift at which two signals correlate most (positive: a is later); null if one is empty."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None or not len(x) or not len(y):
            out.append(None)
        else:
            out.append(float(np.correlate(np.asarray(x, float), np.asarray(y, float), "full").argmax() - (len(y) - 1)))
    return pd.Series(out, dtype="float64")


def attention_pool(x: np.ndarray, w: np.ndarray, b: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Additive self-attention: the mean of the rows of x with weights softmax(v . tanh(w x + b)) over rows whose mask is true."""
    s = np.tanh(x @ w.T + b) @ v
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    e = np.exp(s - s.max())
    return (e / e.sum()) @ x


def with_model(df: DataFrame, load: Callable[[], Callable[[list], list]], column: str, name: str, kind: str, batch: int = 32) -> DataFrame:
    """df plus name: what a model says to column. load is called once in each worker and gives a function from a list of inputs to a list of
    outputs; inputs come in batches; a null input gives a null."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            out: list = [None] * len(s)
            at = [i for i, x in enumerate(s) if x is not None]
            for k in range(0, len(at), batch):
                for i, y in zip(at[k : k + batch], model([s.iloc[i] for i in at[k : k + batch]]), strict=True):
                    out[i] = y
            yield pd.Series(out)

    return df.withColumn(name, run(column))
