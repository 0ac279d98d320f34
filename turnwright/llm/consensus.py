"""Consensus of several annotators by a community confusion model.

Annotators belong to a few types, each with one confusion matrix that its members share; labels of items, types of annotators and matrices are
inferred together by variational updates. An annotator with few labels is judged by the type it falls into rather than by its own few labels.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwright.operators.skew import salted_join
from turnwright.session import drop_stage, stage

#: How many votes per class the types of an annotator count for beside its own.
STRENGTH = 20.0


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function for positive x: recurrence to at least 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def first_types(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices to start from, and which of them learn from their members: sharp, loose, strict, mild and contrary types do. Types whose labels
    say nothing, indifferent or always c for each class c, stay what they are at every size of the data, or the average annotator would turn the
    indifferent type into its own likeness and all would end up in it."""
    i = np.arange(k)
    d = i[None, :] - i[:, None]
    kinds = [np.exp(-1.6 * abs(d)), np.exp(-0.8 * abs(d)), np.exp(-1.2 * abs(d + 1)), np.exp(-1.2 * abs(d - 1)), np.exp(-1.2 * abs(i[None, :] - (k - 1 - i)[:, None]))]
    learn = len(kinds)
    kinds += [np.ones((k, k))] + [np.tile(np.where(i == c, 20.0, 1.0), (k, 1)) for c in range(k)]
    return np.stack([m / m.sum(1, keepdims=True) for m in kinds]), (np.arange(len(kinds)) < learn)[:, None, None]


#: What the matrix of a type that doesn't learn is worth in votes a class.
FIXED = 1e6


class Consensus:
    """Fitted model: classes, and frames.

    patterns (pattern, q): posterior over classes of each distinct set of votes. annotators (annotator, n_votes, reliability, type_no):
    reliability is the correlation of the annotator's labels with the true ones, 0 for one whose labels say nothing, negative for a contrary one.
    converged is true if the matrices had settled when the rounds ended.
    """

    def __init__(self, classes: list[int], patterns: DataFrame, annotators: DataFrame, rounds: int, converged: bool):
        self.classes, self.patterns, self.annotators, self.rounds, self.converged = classes, patterns, annotators, rounds, converged


def pattern_of(votes: Column) -> Column:
    """The text of an array<struct<a: bigint, l: int>> regardless of its order; null if it is empty."""
    return F.when(F.size(votes) > 0, F.array_join(F.transform(F.array_sort(votes), lambda v: F.concat_ws(":", v["a"].cast("string"), v["l"].cast("string"))), "|"))


def fit(items: DataFrame, votes: str, classes: list[int], most_rounds: int = 60, tolerance: float = 5e-3, strength: float = STRENGTH) -> Consensus:
    """Fit the model to items, whose column votes is array<struct<a: bigint, l: int>> with l among classes.

    Items with equal votes are counted together first, so each round runs over distinct sets of votes. An annotator who holds a third of all
    votes does no harm: its counts are summed before they are moved. Rounds go on until no entry of a shared matrix moves by more than tolerance;
    if most_rounds end before that, a warning says so and the model's converged is false.
    """
    k = len(classes)
    v = items.select(F.col(votes).alias("v")).where(F.size("v") > 0).select(pattern_of(F.col("v")).alias("pattern"), F.array_sort("v").alias("v"))
    pat = v.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    labels = stage(pat.select("pattern", "n", F.explode("v").alias("x")).select("pattern", "n", F.col("x.a").alias("a"), F.col("x.l").alias("l")), "p2-votes")
    ks = [f"q{c}" for c in range(k)]
    total = sum((F.col(q) for q in ks), F.lit(0.0))
    types, learns = first_types(k)
    prior = types * np.where(learns, 10.0, FIXED) + 0.1
    alpha, mu = prior, np.full(len(types), 1.0 / len(types))
    first = labels.groupBy("pattern", "n").agg(*[F.pow(F.avg((F.col("l") == c).cast("double")) + 0.1, 2).alias(q) for c, q in zip(classes, ks, strict=True)])
    post = first.select("pattern", "n", *[(F.col(q) / total).alias(q) for q in ks])
    for rounds in range(1, most_rounds + 1):
        rated = _rated(labels, post, ks)
        ln_c = digamma(alpha) - digamma(alpha.sum(2, keepdims=True))
        sums, weight, true = _type_sums(rated, classes, ln_c, np.log(mu))
        fresh = prior + np.where(learns, sums, 0.0)
        moved = np.abs(fresh / fresh.sum(2, keepdims=True) - alpha / alpha.sum(2, keepdims=True)).max()
        model = (ln_c, np.log(mu), fresh / fresh.sum(2, keepdims=True))
        alpha, mu, pi = fresh, (weight + 1) / (weight + 1).sum(), (true + 1) / (true + 1).sum()
        w = rated.mapInPandas(_weigher(classes, *model, strength), "a bigint, l int, " + ", ".join(f"w{c} double" for c in range(k)))
        score = labels.join(w, ["a", "l"]).groupBy("pattern", "n").agg(*[(F.sum(f"w{c}") + float(np.log(pi[c]))).alias(f"s{c}") for c in range(k)])
        score = score.withColumn("top", F.greatest(*[F.col(f"s{c}") for c in range(k)], F.lit(float("-inf"))))
        score = score.select("pattern", "n", *[F.exp(F.col(f"s{c}") - F.col("top")).alias(q) for c, q in enumerate(ks)])
        before, post = post, stage(score.select("pattern", "n", *[(F.col(q) / total).alias(q) for q in ks]), "p2-posterior")
        drop_stage(rated)
        if rounds > 1:
            drop_stage(before)
        if moved < tolerance:
            break
    else:
        warnings.warn(f"shared matrices still move by {moved:.3g} after {most_rounds} rounds", stacklevel=2)
    annotators = _rated(labels, post, ks).mapInPandas(_judge(classes, *model, pi, strength), "annotator bigint, n_votes bigint, reliability double, type_no int")
    return Consensus(classes, post.select("pattern", F.array(*ks).alias("q")), annotators, rounds, bool(moved < tolerance))


def _rated(labels: DataFrame, post: DataFrame, ks: list[str]) -> DataFrame:
    """(a, n_votes, c): for each annotator the expected counts of the true classes behind each of its labels."""
    n = labels.join(post.drop("n"), "pattern").groupBy("a", "l").agg(*[F.sum(F.col("n") * F.col(q)).alias(q) for q in ks], F.sum("n").alias("n"))
    return stage(n.groupBy("a").agg(F.sum("n").alias("n_votes"), F.collect_list(F.struct("l", F.array(*ks).alias("q"))).alias("c")), "p2-counts")


def _matrix(cells, classes: list[int]) -> np.ndarray:
    """Expected counts [true class, label] of one annotator."""
    out = np.zeros((len(classes), len(classes)))
    for x in cells:
        out[:, classes.index(x["l"])] += np.asarray(x["q"], dtype=float)
    return out


def _belongs(n: np.ndarray, ln_c: np.ndarray, ln_mu: np.ndarray) -> np.ndarray:
    s = (n[None] * ln_c).sum((1, 2)) + ln_mu
    r = np.exp(s - s.max())
    return r / r.sum()


def _type_sums(rated: DataFrame, classes: list[int], ln_c: np.ndarray, ln_mu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each type, its weight, and the counts of the true classes, summed over tasks: a row for each number comes to the driver."""
    m, k = len(ln_c), len(classes)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weight, true = np.zeros((m, k, k)), np.zeros(m), np.zeros(k)
        for f in frames:
            for cells in f["c"]:
                n = _matrix(cells, classes)
                r = _belongs(n, ln_c, ln_mu)
                sums += r[:, None, None] * n[None]
                weight += r
                true += n.sum(1)
        x = np.concatenate([sums.ravel(), weight, true])
        yield pd.DataFrame({"i": np.arange(len(x)), "x": x})

    x = np.zeros(m * k * k + m + k)
    for r in rated.select("c").mapInPandas(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        x[r.i] = r.x
    return x[: m * k * k].reshape(m, k, k), x[m * k * k : m * k * k + m], x[m * k * k + m :]


def _own(n: np.ndarray, ln_c: np.ndarray, ln_mu: np.ndarray, shared: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """An annotator's part in each type, and the Dirichlet of its matrix: that of its types, worth strength votes per class, plus its own."""
    r = _belongs(n, ln_c, ln_mu)
    return r, np.tensordot(r, shared, 1) * strength + n + 0.01


def _weigher(classes: list[int], ln_c: np.ndarray, ln_mu: np.ndarray, shared: np.ndarray, strength: float = STRENGTH):
    """What a label of an annotator says about each true class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a, cells in zip(f["a"], f["c"], strict=True):
                _, own = _own(_matrix(cells, classes), ln_c, ln_mu, shared, strength)
                w = digamma(own) - digamma(own.sum(1, keepdims=True))
                rows += [(a, c, *w[:, j]) for j, c in enumerate(classes)]
            yield pd.DataFrame(rows, columns=["a", "l", *[f"w{c}" for c in range(len(classes))]])

    return run


def _judge(classes: list[int], ln_c: np.ndarray, ln_mu: np.ndarray, shared: np.ndarray, pi: np.ndarray, strength: float = STRENGTH):
    y = np.asarray(classes, dtype=float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a, cells, votes in zip(f["a"], f["c"], f["n_votes"], strict=True):
                r, own = _own(_matrix(cells, classes), ln_c, ln_mu, shared, strength)
                joint = pi[:, None] * own / own.sum(1, keepdims=True)
                px, py = joint.sum(1), joint.sum(0)
                mx, my = px @ y, py @ y
                cov = ((y - mx)[:, None] * (y - my)[None] * joint).sum()
                sd = np.sqrt((px @ (y - mx) ** 2) * (py @ (y - my) ** 2))
                rows.append((a, int(votes), float(cov / sd) if sd > 1e-9 else 0.0, int(r.argmax())))
            yield pd.DataFrame(rows, columns=["annotator", "n_votes", "reliability", "type_no"])

    return run


def consensus(items: DataFrame, votes: str, classes: list[int], **options) -> tuple[DataFrame, DataFrame]:
    """(items with consensus, certainty and agreement; annotators with their reliability).

    items keep all their columns and rows; names beginning with an underscore, and those three, are reserved. consensus is the likeliest class,
    certainty its posterior, agreement the share of pairs of votes that are equal. Items without votes get null; those with one vote have no
    agreement. Ties go to the smaller class. Repeated items count as often as they come.
    """
    model = fit(items, votes, classes, **options)
    q = model.patterns.select(F.col("pattern").alias("_pattern"), F.col("q").alias("_q"))
    d = salted_join(items.withColumn("_pattern", pattern_of(F.col(votes))), q, "_pattern", "left")
    best = F.array_max("_q")
    n = F.size(votes)
    given = F.transform(votes, lambda v: v["l"])
    same = sum((F.pow(n - F.size(F.array_remove(given, c)), 2) for c in classes), F.lit(0.0))
    d = d.withColumns({
        "consensus": F.when(best.isNotNull(), F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("_q", best).cast("int") - 1)),
        "certainty": best,
        "agreement": F.when(n > 1, (same - n) / (n * (n - 1))),
    })
    return d.drop("_pattern", "_q"), model.annotators
