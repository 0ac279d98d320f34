import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwright.llm import queries as Q
from turnwright.llm.consensus import consensus, digamma

SCHEMA = "i bigint, votes array<struct<a: bigint, l: int>>, q string, n string"


def test_digamma():
    assert np.allclose(digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-7)


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for i in range(1500):
        z = int(rng.integers(1, 6))
        truth[i] = z
        votes = []
        for a in rng.choice(8, 3, replace=False):
            near = int(np.clip(z + rng.choice([-1, 0, 0, 0, 0, 1]), 1, 5))
            said = {5: int(rng.integers(1, 6)), 6: 4, 7: 6 - z}.get(int(a), near)
            votes.append((int(a), said))
        rows.append((i, votes, "clash", "clash"))
    rows += [(5000, [], "", ""), (5001, None, "", ""), (5002, [(1, 3)], "", ""), (5003, [(99, 2), (1, 2)], "", "")]
    return truth, rows


def test_consensus_and_reliability(spark, rated):
    truth, rows = rated
    items, raters = consensus(spark.createDataFrame(rows, SCHEMA), "votes", [1, 2, 3, 4, 5])
    got = {r.i: r for r in items.collect()}
    assert len(got) == len(rows) and items.columns[:4] == ["i", "votes", "q", "n"]
    right = np.mean([got[i].consensus == z for i, z in truth.items()])
    majority = np.mean([max(set(v), key=v.count) == truth[r[0]] for r in rows[:1500] for v in [[x[1] for x in r[1]]]])
    # the best that anyone could do who knew how each annotator errs
    p = np.zeros((8, 5, 5))
    for z in range(5):
        for step in (-1, 0, 0, 0, 0, 1):
            p[:5, z, int(np.clip(z + step, 0, 4))] += 1 / 6
        p[5, z] = 0.2
        p[6, z, 3] = 1
        p[7, z, 4 - z] = 1
    best = np.mean([np.sum([np.log(p[a, :, y - 1] + 1e-9) for a, y in r[1]], 0).argmax() + 1 == truth[r[0]] for r in rows[:1500]])
    assert right > best - 0.02 and right > majority + 0.1
    rel = {r.annotator: r.reliability for r in raters.collect()}
    assert all(rel[a] > 0.7 for a in range(5)) and abs(rel[5]) < 0.2 and abs(rel[6]) < 0.2 and rel[7] < -0.7
    assert rel[99] > 0.2  # one vote: judged by the type it falls into
    assert got[5000].consensus is None and got[5001].consensus is None and got[5002].agreement is None and got[5002].consensus == 3
    assert got[5003].agreement == 1.0


def test_no_items(spark):
    items, raters = consensus(spark.createDataFrame([], SCHEMA), "votes", [1, 2, 3, 4, 5])
    assert items.count() == 0 and raters.count() == 0


def test_misstated_medians(spark):
    v = lambda *x: [(k, y) for k, y in enumerate(x)]
    rows = [(v(3, 4), 3), (v(3, 4), 4), (v(3, 4), 5), (v(2, 4), 3), (v(2, 4), 2), (v(1, 2, 5), 2), (v(1, 2, 5), None), (v(3), 1), (v(1, 4), 2), (v(1, 4), 4)]
    d = spark.createDataFrame(rows, "votes array<struct<a: bigint, l: int>>, IQMedian int")
    got = [r[0] for r in d.select(Q.misstated(F.col("IQMedian"), F.col("votes"))).collect()]
    assert got == [False, False, True, False, True, False, True, False, False, True]
