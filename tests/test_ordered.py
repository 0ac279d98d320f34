import random

from pyspark.sql import functions as F

from turnwright.operators.joins import nearest_place
from turnwright.operators.metrics import quantiles
from turnwright.operators.ordered import blocked, fill_ordered, place, position, running
from turnwright.operators.skew import hot_keys, salted_join


def test_running_crosses_blocks(spark):
    rng = random.Random(1)
    rows = [(p, i, rng.choice([None, rng.randint(0, 99)])) for p in "ab" for i in range(120)]
    d = spark.createDataFrame(rows, "p string, i int, v int").withColumn("b", F.floor(F.col("i") / 7))
    for how, whole in (("max", lambda x: max(x, default=None)), ("last", lambda x: x[-1] if x else None), ("sum", lambda x: sum(x))):
        got = {(r.p, r.i): r.o for r in running(d, ["p"], "b", ["i"], F.col("v"), how, "o").collect()}
        for p in "ab":
            for i in range(120):
                assert got[p, i] == whole([v for q, j, v in rows if q == p and j < i and v is not None])
    got = {(r.p, r.i): r.o for r in running(d, ["p"], "b", ["i"], F.col("v"), "last", "o", inclusive=True, reverse=True).collect()}
    assert all(got[p, i] == next((v for q, j, v in rows if q == p and j >= i and v is not None), None) for p, i, _ in rows)


def test_fills_and_position(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "b", None), (4, "c", 2), (5, None, None)], "o bigint, g string, x int")
    f = fill_ordered(d, "o", "x", "y", group="g", block_rows=2)
    assert [r.y for r in f.orderBy("o").collect()] == [None, 1, None, 2, None]
    b = fill_ordered(f.select("o", "y"), "o", "y", "z", forward=False, block_rows=2)
    assert [r.z for r in b.orderBy("o").collect()] == [1, 1, 2, 2, None]
    n = position(d.withColumn("b", F.col("o")), [], "b", ["o"], "n")
    assert [r.n for r in n.orderBy("o").collect()] == [0, 1, 2, 3, 4]
    assert fill_ordered(d.limit(0), "o", "x", "y").count() == 0


def test_salted_join_is_a_join(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3)], "k string, v int")
    for how in ("inner", "left"):
        a = sorted(map(tuple, salted_join(big, small, "k", how, hot_rows=100).select("id", "k", "v").collect()), key=repr)
        assert a == sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=repr)


def test_a_hot_key_within_one_minute_is_cut_by_rows(spark):
    d = spark.range(2000).select(F.when(F.col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("p"), (F.col("id") % 60).alias("at"), "id", (F.hash("id") % 50).alias("v"))
    b, name = blocked(d, ["p"], ["at", "id"], "t", rows=100)
    sizes = {(r.p, r[name]): r["count"] for r in b.groupBy("p", name).count().collect()}
    assert all(n <= 600 for n in sizes.values()) and len([k for k in sizes if k[0] == "hot"]) > 5 and all(k[1] == -1 for k in sizes if k[0] != "hot")
    whole = [(r.p, r.at, r.id, r.v) for r in d.collect()]
    for how, of in (("max", max), ("sum", sum), ("last", lambda x: x[-1])):
        got = {r.id: r.o for r in running(b, ["p"], name, ["at", "id"], F.col("v"), how, "o").collect()}
        for p in ("hot", "k3"):
            order = sorted(x[1:] for x in whole if x[0] == p)
            assert all(got[x[1]] == (of([y[2] for y in order[:i]]) if i else (0 if how == "sum" else None)) for i, x in enumerate(order) if i % 37 == 0)
    assert {r.id: r.n for r in place(d, ["p"], ["at", "id"], "n", rows=100).collect()} == {r.id: r.n for r in place(d, ["p"], ["at", "id"], "n").collect()}
    assert blocked(d.limit(0), ["p"], ["at", "id"], "t", rows=1)[1] is None and blocked(d, [], ["id"], "t", rows=100)[1] == "_blk"


def test_null_keys_are_hot_too(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "a").alias("k"))
    small = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert {r._k: r._salts for r in hot_keys(big, "k", 90).collect()} == {"a": 2, None: 10} and hot_keys(big, "k", 1000) is None
    got = salted_join(big, small, "k", "left", hot_rows=90)
    assert got.count() == 1000 and got.where("v = 1").count() == 100 and got.where("v is null").count() == 900
    assert salted_join(big, small, "k", hot_rows=90).count() == 100 and salted_join(big.limit(0), small, "k", "left").count() == 0


def test_nearest_place_and_quantiles_against_brute_force(spark):
    rng = random.Random(9)
    a = [(i, rng.choice(["x", "x", "y", None]), rng.choice([None, *range(30)])) for i in range(200)]
    b = [(i, rng.choice(["x", "y", None]), rng.randrange(30)) for i in range(40)]
    left, right = spark.createDataFrame(a, "id int, k string, p int"), spark.createDataFrame(b, "rid int, k string, q int").dropDuplicates(["k", "q"])
    there = [(r.rid, r.k, r.q) for r in right.collect()]
    want = sorted((i, min((abs(p - q), q) for _, k2, q in there if k2 == k)[1]) for i, k, p in a if k is not None and p is not None and any(k2 == k for _, k2, _ in there))
    for rows in (7, 10**6):
        assert sorted((r.id, r.q) for r in nearest_place(left, right, ["k"], "p", "q", block_rows=rows).collect()) == want
        got = quantiles(left.where("p is not null and k is not null"), ["k"], "p", {"m": 0.5, "q": 0.9}, block_rows=rows).collect()
        for r in got:
            v = sorted(p for _, k, p in a if k == r.k and p is not None)
            at = lambda s: v[int((len(v) - 1) * s)] + (v[min(int((len(v) - 1) * s) + 1, len(v) - 1)] - v[int((len(v) - 1) * s)]) * ((len(v) - 1) * s % 1)  # noqa: B023, E731
            assert abs(r.m - at(0.5)) < 1e-9 and abs(r.q - at(0.9)) < 1e-9
    assert nearest_place(left.limit(0), right, ["k"], "p", "q").count() == 0 and nearest_place(left, right.limit(0), ["k"], "p", "q").count() == 0
