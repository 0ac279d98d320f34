import random

import numpy as np
from pyspark.sql import functions as F

from turnwright.llm import queries as Q
from turnwright.llm.splits import components, place, stratify


def brute(links):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for n, h in links:
        if n is not None and h is not None:
            up[top(("n", n))] = top(("h", h))
    out = {}
    for x in list(up):
        out.setdefault(top(x), set()).add(x)
    return sorted(sorted(v) for v in out.values())


def test_components(spark):
    rng = random.Random(2)
    links = [(f"n{rng.randint(0, 60)}", f"h{rng.randint(0, 50)}") for _ in range(70)]
    links += [(f"c{i:03}", f"x{i:03}") for i in range(40)] + [(f"c{i + 1:03}", f"x{i:03}") for i in range(40)]  # a long chain
    links += [(f"s{i}", "star") for i in range(200)] + [(None, "star"), ("lonely", None)] + links[:10]
    a, b = components(spark.createDataFrame(links, "n string, h string"), "n", "h")
    got = {}
    for r in a.collect():
        got.setdefault(r.component, set()).add(("n", r.n))
    for r in b.collect():
        got[r.component].add(("h", r.h))
    assert sorted(sorted(v) for v in got.values()) == brute(links)
    assert components(spark.createDataFrame([], "n string, h string"), "n", "h")[0].count() == 0


def test_place_keeps_the_mix():
    rng = np.random.default_rng(1)
    v = rng.poisson([1, 3, 8], size=(600, 3)).astype(float)
    p = np.array([0.8, 0.1, 0.1])
    s = place(v, p[:, None] * v.sum(0)[None])
    assert (s >= 0).all()
    for k in range(3):
        assert np.allclose(v[s == k].sum(0) / v.sum(0), p[k], atol=0.02)


def test_stratify_with_one_huge_component(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", *map(int, rng.poisson([1, 3, 8]))) for i in range(3000)] + [("huge", 1000, 2000, 3000), ("empty", 0, 0, 0), ("nulls", None, None, 5)]
    d = spark.createDataFrame(rows, "c string, a int, b int, e int").withColumn("split", F.lit("clash"))
    out = stratify(d, "c", ["a", "b", "e"], {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert out.count() == len(rows) == out.select("c").distinct().count()
    sums = {r.split: r for r in out.join(d.drop("split"), "c").groupBy("split").agg(*[F.sum(x).alias(x) for x in "abe"]).collect()}
    total = [sum(r[k] or 0 for r in rows) for k in (1, 2, 3)]
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert all(abs(sums[name][x] / t - share) < 0.03 for x, t in zip("abe", total, strict=True))
    again = stratify(d.repartition(7), "c", ["a", "b", "e"], {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert stratify(d.limit(0), "c", ["a", "b", "e"], {"train": 1.0}).count() == 0


def test_rows_of_the_tables_stay_together(spark, tiny):
    r = Q.p3_splits(spark, tiny)
    assert r.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert r.groupBy("call_id").agg(F.count_distinct("component").alias("n")).where("n > 1 and call_id is not null").count() == 0
    assert r.count() == spark.read.parquet(f"{tiny}/filtered_system_features.parquet").select("log_id").distinct().count() and r.where("split is null").count() == 0


def test_split_names(spark):
    names = ["train ", "TRAIN", "trn", " val", "dev", "Validation", " test", "testing", None, "", "NA"]
    d = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in d.select(Q.split_name(F.col("s"))).collect()] == ["train"] * 3 + ["validation"] * 3 + ["test"] * 2 + [None] * 3
