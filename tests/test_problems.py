import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnwright.functions.ids import call_id, seconds
from turnwright.functions.parses import identify, read
from turnwright.operators import propagation
from turnwright.operators.intervals import periods_and_gaps
from turnwright.operators.nested import NestedTables
from turnwright.operators.propagation import apply_fills, propagate
from turnwright.operators.references import apply_deltas, current_orphans, orphan_report, orphans, reference_deltas

T0 = dt.datetime(2000, 1, 1)
LOG = "log_id bigint, at timestamp, call string, dd double, no int, g string, x string, b int, i bigint"


def log_row(i, call, start, no, dd=True, when=True):
    at = T0 + dt.timedelta(seconds=start + 10 * no)
    return (i, at if when else None, call, 10.0 * no if dd else None, no, "clash", "clash", 1, 7)


def fills_of(spark, rows):
    d = spark.createDataFrame(rows, LOG)
    return d, propagate(d, "log_id", "at", "call", "dd", "no")


def test_fills_come_from_neighbours(spark):
    rows = [log_row(k, "A", 0, k) for k in range(1, 11)] + [log_row(10 + k, "B", 1000, k) for k in range(1, 11)]
    for k, what in ((4, "call"), (5, "call"), (6, "call"), (13, "dd"), (14, "dd"), (9, "both")):
        r = list(rows[k - 1])
        if what in ("call", "both"):
            r[2] = None
        if what in ("dd", "both"):
            r[3] = None
        rows[k - 1] = tuple(r)
    rows += rows[:3] + rows[12:14]
    random.Random(3).shuffle(rows)
    d, f = fills_of(spark, rows)
    got = {(r.log_id, r.field_name): r for r in f.collect()}
    assert set(got) == {(4, "call"), (5, "call"), (6, "call"), (9, "call"), (9, "dd"), (13, "dd"), (14, "dd")}
    assert all(got[k, "call"].text_value == "A" and got[k, "call"].source == "neighbours" for k in (4, 5, 6, 9))
    assert abs(got[13, "dd"].number_value - 30) < 1 and abs(got[14, "dd"].number_value - 40) < 1 and abs(got[9, "dd"].number_value - 90) < 1
    whole = apply_fills(d, f, "log_id", "call", "dd")
    assert whole.count() == len(rows) and whole.where("call is null or dd is null").count() == 0
    assert {r.log_id for r in whole.where("call_filled").collect()} == {4, 5, 6, 9}


def test_fills_do_not_depend_on_the_spacing_of_keys(spark):
    rows = [list(log_row(k, "AB"[k > 30], 0 if k <= 30 else 2000, k % 31 + 1)) for k in range(1, 61)]
    for k in (5, 6, 7, 8, 9, 10, 11, 12, 31, 44, 60):
        rows[k - 1][2 if k % 2 else 3] = None
    far = [[r[0] ** 2 * 1000, *r[1:]] for r in rows]
    near = {(r.log_id, r.field_name): r for r in fills_of(spark, rows)[1].collect()}
    got = {(r.log_id, r.field_name): r for r in fills_of(spark, far)[1].collect()}
    assert len(near) == 11 and {r.source for r in near.values()} == {"neighbours"}
    assert {(k * k * 1000, f): (r.text_value, r.number_value) for (k, f), r in near.items()} == {k: (r.text_value, r.number_value) for k, r in got.items()}


def test_fills_without_neighbours(spark):
    far = [log_row(1, "A", 0, 1), log_row(1000, None, 50, 1, dd=False), log_row(5000, "B", 60, 2, dd=False), log_row(6000, "C", 100_000, 2, dd=False, when=False), log_row(None, None, 0, 1)]
    _, f = fills_of(spark, far)
    got = {(r.log_id, r.field_name): r for r in f.collect()}
    assert got[1000, "call"].text_value in "AB" and got[1000, "call"].source == "neighbours"
    assert got[5000, "dd"].number_value == 10.0 and got[5000, "dd"].source == "time"
    assert got[6000, "dd"].number_value == 10.0 and got[6000, "dd"].source == "all"
    assert len(got) == 4  # a row without a key can't be named
    _, f = fills_of(spark, [log_row(1, None, 0, 1, dd=False), log_row(2, None, 0, 2, dd=False)])
    assert {r.source for r in f.collect()} == {"none"}
    _, f = fills_of(spark, [])
    assert f.count() == 0


def test_long_runs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(propagation, "BLOCK", 8)
    rows = [list(log_row(k, "A", 0, k)) for k in range(1, 41)]
    for k in range(10, 31):  # longer than two blocks
        rows[k - 1][2] = rows[k - 1][3] = None
    got = {(r.log_id, r.field_name): r for r in fills_of(spark, rows)[1].collect()}
    assert len(got) == 42 and all(got[k, "call"].text_value == "A" and abs(got[k, "dd"].number_value - 10 * k) < 1 for k in range(10, 31))


def test_held_out_values_come_back(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/system_features_full.parquet").dropDuplicates(["log_id"])
    t = t.select("log_id", "logged_at", "exchange_no", call_id(F.col("CallID")).alias("c"), seconds(F.col("DD")).alias("x"))
    hidden = t.select("log_id", "logged_at", "exchange_no", F.when(F.col("log_id") % 17 != 0, F.col("c")).alias("call"), F.when(F.col("log_id") % 19 != 0, F.col("x")).alias("dd"))
    f = propagate(hidden, "log_id", "logged_at", "call", "dd", "exchange_no").join(t, "log_id")
    right = f.where("field_name = 'call' and c is not null").agg(F.avg((F.col("text_value") == F.col("c")).cast("int"))).first()[0]
    near = f.where("field_name = 'dd' and x is not null").agg(F.avg((F.abs(F.col("number_value") - F.col("x")) < 2).cast("int"))).first()[0]
    assert right > 0.98 and near > 0.98


def tree(text):
    return [(i + 1, n.parent + 1, n.name) for i, n in enumerate(read(text))]


@pytest.mark.parametrize(
    ("text", "nodes"),
    [
        (None, []),
        ("", []),
        (" Semantic  No Match ", []),
        ("nan", []),
        ("a b", [(1, 0, "a"), (2, 0, "b")]),
        ("a[x (y) z](b[1] c (d)) e", [(1, 0, "a"), (2, 1, "b"), (3, 1, "c"), (4, 3, "d"), (5, 0, "e")]),
        ("a (b (c", [(1, 0, "a"), (2, 1, "b"), (3, 2, "c")]),
        ("a ) ) b", [(1, 0, "a"), (2, 0, "b")]),
        ("a (b) (c)", [(1, 0, "a"), (2, 1, "b"), (3, 1, "c")]),
        ("(a) b", [(1, 0, "a"), (2, 0, "b")]),
        ('{"slot": "a", "sub": {"slot": "b", "value": 2}}', [(1, 0, "a"), (2, 1, "b")]),
        ('[{"slot": "a", "sub": [{"slot": "b"}, {"slot": "c"}]}, {"slot": "d", "sub": null}]', [(1, 0, "a"), (2, 1, "b"), (3, 1, "c"), (4, 0, "d")]),
        ('{"ver": 2, "nodes": []}', []),
        ('"[{\\"slot\\": \\"a\\"}]"', [(1, 0, "a")]),
        ("[]", []),
        ('{"slot": ', []),
    ],
)
def test_reading_parses(text, nodes):
    assert tree(text) == nodes


@pytest.mark.parametrize("text", ['{"slot":"a","sub":' * 50_000 + "null" + "}" * 50_000, '[{"slot":"a","sub":' * 20_000 + "[]" + "}]" * 20_000, "a (" * 50_000])
def test_no_depth_is_too_deep(text):
    nodes = read(text)
    assert len(nodes) in (20_000, 50_000) and identify(nodes)[1][0] == len(nodes)
    assert identify(read('{"slot":"a","value":' + "[" * 20_000 + "]" * 20_000 + "}"))[1] == [1]


def test_equal_objects_have_one_identity():
    a, b = read("p[1] (q[2] r) s (p[1] (q[2] r))"), read('[{"slot":"p","value":"1","sub":[{"slot":"q","value":"2"},{"slot":"r"}]}]')
    ia, ib = identify(a)[0], identify(b)[0]
    assert ia[0] == ia[4] == ib[0] and ia[1] == ib[1] and len({ia[0], ia[1], ia[2], ia[3]}) == 4
    assert identify(read("a (b c)"))[0][0] != identify(read("a (c b)"))[0][0]


def test_tables_give_back_the_texts(spark):
    texts = ["a[1](b c(d))", "a[1](b c(d))", "z (a[1](b c(d)))", None, "", "b", " ".join("n (" for _ in range(40)), "x " * 3000, " ".join(f"d{i} (e" for i in range(200)), "a (b " * 64 + "c"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, "a", "q")]
    t = NestedTables(spark.createDataFrame(rows, "k bigint, p string, hash string"), "k", "p")
    want = sorted((i, *n) for i, x in enumerate(texts) for n in tree(x))
    assert sorted(map(tuple, t.occurrences().collect())) == want
    assert t.objects.count() == t.objects.select("hash").distinct().count()
    assert t.bridge.groupBy("parent_hash").count().where("count = 3000").count() == 1
    assert NestedTables(spark.createDataFrame([], "k bigint, p string"), "k", "p").occurrences().count() == 0


def test_orphans(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    reg = [("A", day(1), None), ("B", day(1), day(3)), ("B", day(1), day(3)), ("B", day(5), None), ("C", day(9), day(8)), ("D", None, None), (None, day(1), None)]
    refs = [(1, "A", day(0)), (2, "A", day(1)), (3, "B", day(2)), (4, "B", day(3)), (5, "B", day(5)), (6, "C", day(9)), (7, "X", day(1)), (8, None, day(1)), (9, "X", None), (10, "A", None), (11, "D", day(1)), (11, "D", day(1))]
    d = spark.createDataFrame(refs, "id int, k string, t timestamp").withColumn("states", F.lit(0)).withColumn("n_ever", F.lit(0))
    r = spark.createDataFrame(reg, "key string, born timestamp, died timestamp")
    for rows in (2, 10**6):
        got = sorted((x.id, x.orphan_kind) for x in orphans(d, r, "k", "t", "key", "born", "died", block_rows=rows).collect())
        assert got == [(1, "late"), (4, "deleted"), (6, "deleted"), (7, "missing"), (9, "missing"), (11, "late"), (11, "late")]
    assert orphans(d.limit(0), r, "k", "t", "key", "born", "died").count() == 0
    assert {x.orphan_kind for x in orphans(d, r.limit(0), "k", "t", "key", "born", "died").collect()} == {"missing"}
    rep = orphan_report(orphans(d.withColumn("table", F.lit("x")), r, "k", "t", "key", "born", "died"), "table", "t")
    assert rep.agg(F.sum("n_orphans")).first()[0] == 7


def test_signed_counts(spark):
    refs = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "k string")
    exist = spark.createDataFrame([("A", 0, 1)], "key string, d_ref bigint, d_exist bigint")
    s = apply_deltas(None, reference_deltas(refs, "k"), exist)
    assert [r.key for r in current_orphans(s).collect()] == ["B"]
    s = apply_deltas(s, spark.createDataFrame([("A", 0, -1), ("B", 0, 1)], "key string, d_ref bigint, d_exist bigint"))
    assert [(r.key, r.n_ref) for r in current_orphans(s).collect()] == [("A", 2)]
    batches = [reference_deltas(refs, "k"), exist, reference_deltas(refs, "k", -1), reference_deltas(refs, "k")]
    folded = None
    for b in batches:  # a state kept from batch to batch is that of all batches at once
        folded = apply_deltas(folded, b)
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, apply_deltas(None, *batches).collect()))
    s = apply_deltas(s, reference_deltas(refs, "k", -1))
    assert current_orphans(s).count() == 0


def spans(rows):
    out, by = [], {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, v in by.items():
        v.sort()
        per = [list(v[0])]
        for s, t in v[1:]:
            if s <= per[-1][1]:
                per[-1][1] = max(per[-1][1], t)
            else:
                per.append([s, t])
        out += [(e, "period", *p) for p in per] + [(e, "gap", a[1], b[0]) for a, b in zip(per, per[1:], strict=False)]
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 120)), st.integers(-2, 60)), max_size=60))
def test_periods_against_brute_force(spark, raw):
    rows = [(e, s, None if s is None else s + n) for e, s, n in raw]
    d = spark.createDataFrame(rows, "e string, s bigint, t bigint").withColumn("span_kind", F.lit("clash"))
    assert sorted(map(tuple, periods_and_gaps(d, "e", "s", "t", block_rows=7).collect())) == spans(rows)
