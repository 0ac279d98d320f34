import json
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import turnwright.__main__ as cli
from turnwright.functions import text as X
from turnwright.functions import words as W
from turnwright.operators import align, cleaning, exchange, features, joins, metrics, partitions, signal, stats
from turnwright.plans import catalogue
from turnwright.sources import paths, readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def dialogue(spark):
    a = [("c", "agent", 0.0, 2.0, "Where to?", "Where to go?", 4, 1), ("c", "agent", 6.0, 8.0, "Ok", "Ok", 5, 2), ("d", "agent", 0.0, 1.0, "x", "x", 1, 5), ("d", "agent", None, None, "y", "y", 1, 6)]
    u = [("c", "user", 1.5, 1.8, "yes", 11), ("c", "user", 3.0, 4.0, "downtown", 12), ("c", "user", 6.0, 6.5, "no", 13), ("d", "user", 2.0, 3.0, "lost", 14), (None, "user", 2.0, 3.0, "lost", 15)]
    ad = spark.createDataFrame(a, "CallID string, Speaker string, StartTime double, EndTime double, Transcript string, AgentPrompt string, IQMedian int, ord bigint")
    ud = spark.createDataFrame(u, "CallID string, Speaker string, StartTime double, EndTime double, Transcript string, ord bigint")
    return exchange.combine(ad, ud)


def test_exchange_and_turn_taking(spark):
    e = {r.turn_id: r for r in exchange.turn_taking(exchange.exchanges(dialogue(spark))).collect()}
    x, y = e[1], e[2]
    assert (x.EndTime, x.ExchangeDuration, x.CombinedTranscript) == (6.0, 6.0, "Where to? [SEP] yes downtown")
    assert (x.UserStartTime, x.UserEndTime, x.ResponseTokenCount, x.NumConsecutiveUserUtterances, x.HasConsecutiveUserUtterances) == (1.5, 4.0, 1, 2, True)
    assert (x.NumInternalPauses, x.AvgInternalPauseDuration, x.TotalInternalPauseDuration, x.StdInternalPauseDuration) == (1, 1.2, 1.2, 0.0)
    assert (x.AgentTurnDuration, x.UserTurnDuration, x.TurnTakingRatio, x.UserResponseLatency, x.UserIsOverlap, x.UserOverlapDuration) == (2.0, 2.5, 1.25, -0.5, True, 0.5)
    assert (x.AgentResponseLatency, x.AgentIsOverlap, x.UserInterruptsAgent, x.PromptCompletionRatio) == (0.0, False, True, 0.75)
    assert (y.EndTime, y.CombinedTranscript, y.UserStartTime, y.NumConsecutiveUserUtterances, y.AgentResponseLatency, y.PromptCompletionRatio) == (8.0, "Ok", None, 0, 2.0, 1.0)
    assert e[5].EndTime is None and e[5].NumConsecutiveUserUtterances == 0 and e[6].NumConsecutiveUserUtterances == 0


def test_cleaning(spark):
    d = spark.createDataFrame([("no match", "voice", "/LetsGoPublic/PerformTask/Ask ", " 1.5 ", "nan"), ("", None, None, "x", "k")], "ASRRecognitionStatus string, Modality string, Activity string, n string, v string")
    assert rows(cleaning.clean_categories(d).select("ASRRecognitionStatus", "Modality", "Activity")) == [("no status", None, None), ("reject", "speech", "Ask")]
    assert rows(d.select(cleaning.number(F.col("n")))) == [(1.5,), (None,)]
    assert rows(cleaning.apply_vocabulary(d).select("v")) == [("k",), (None,)]
    assert {r.column_name: r.n_null for r in cleaning.null_profile(d).collect()} == {"ASRRecognitionStatus": 0, "Modality": 1, "Activity": 1, "n": 0, "v": 0, "*any*": 1}
    c = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert rows(cleaning.one_hot(c, ["c"])) == [(False,), (False,), (True,)]
    assert cleaning.drop_columns(d, exact=["MODALITY"], keywords=["Status"], pattern="^n$").columns == ["Activity", "v"]
    assert [r[0] for r in spark.range(1).select(cleaning.repair_id(F.lit("2000111265")), cleaning.plain_id(F.lit(" 12.0 "))).collect()] == ["20000111265"]


def test_nearest_place(spark):
    a = spark.createDataFrame([(1, "k", 0), (2, "k", 1), (3, "z", 0)], "id int, k string, p int")
    b = spark.createDataFrame([("k", 0), ("k", 2)], "k string, q int")
    assert sorted((r.id, r.q) for r in joins.nearest_place(a, b, ["k"], "p", "q").collect()) == [(1, 0), (2, 0)]


def test_exclusion(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "c string")
    bad = spark.createDataFrame([("1", "empty file"), ("2", "empty file")], "c string, reason string")
    r = joins.exclusion_reasons(s("1", "2", "3", "4", "5", None), "c", bad, s("1", "3", "4", "5"), s("1", "3"), s("3"), s("4"))
    assert rows(r) == [("1", "empty file"), ("2", "no .wav file"), ("3", "silent user"), ("4", "silent agent")]
    assert rows(joins.exclude(s("1", "5"), r, "c")) == [("5",)]
    assert tuple(joins.exclusion_summary(s("1", "2", "3", "4", "5"), r, "c").first()) == (5, 4, 1, 80.0)


def test_scaling(spark):
    tr, te = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double"), spark.createDataFrame([(2.0, 7.0)], "a double, b double")
    fit = features.moments(tr, ["a", "b"])
    assert tuple(features.standardise(te, fit).first()) == (0.0, 2.0)
    assert abs(features.standardise(tr, fit).first().a + 1 / np.sqrt(2 / 3)) < 1e-9
    with pytest.raises(ValueError):
        features.principal_components(tr, [tr], "a", 0.0)


def test_components_hold_the_variance(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(200, 2))
    x = np.hstack([z, z @ rng.normal(size=(2, 4))]) + 1e-3 * rng.normal(size=(200, 6))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    (out,) = features.principal_components(d, [d], "v", 0.99)
    assert len(out.first().v) == 2 and out.count() == 200


def test_sequences(spark):
    d = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), (None, 1)], "g string, o bigint")
    assert rows(features.warm_up_trim(d, "g", "o")) == [("a", 2), ("a", 3), ("a", 4)]
    assert rows(features.chunks(d, "g", "o", 2)) == [("a", 0, 0, 0), ("a", 1, 0, 1), ("a", 2, 1, 0), ("a", 3, 1, 1), ("a", 4, 2, 0), ("b", 9, 0, 0)]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]],)], "v array<array<double>>")
    r = v.select(features.mean_pool(F.col("v"), features.filled_rows(F.col("v"))).alias("m"), features.pad(F.lit([1.0]), 3, 0.0).alias("p")).first()
    assert r.m == [2.0, 3.0] and r.p == [1.0, 0.0, 0.0]


def test_route():
    r = features.route(["Prompt_sbert_dim0", "UserIsOverlap"], {"a": (("prompt", "dim"), ()), "b": (("dim",), ("sbert",)), "c": (("overlap",), ())})
    assert r == {"a": ["Prompt_sbert_dim0"], "b": [], "c": ["UserIsOverlap"]}


def test_groups_stay_whole(spark):
    d = spark.createDataFrame([(f"g{i % 37}", i) for i in range(500)], "g string, i int")
    s = partitions.group_split(d, "g")
    assert s.count() == 37 and s.where("part = 'train'").count() == 29
    f = [r[1] for r in partitions.group_folds(d, "g").groupBy("fold").count().collect()]
    assert len(f) == 10 and max(f) - min(f) <= 1 and sum(f) == 37
    with pytest.raises(ValueError):
        partitions.group_split(d, "no")
    w = {r.y: round(r.weight, 4) for r in partitions.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,), (-1,)], "y int"), "y").collect()}
    assert w == {0: 0.6667, 1: 2.0}


def test_scores(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "t int, p int")
    assert {r.label: round(r.f1, 4) for r in metrics.class_report(d, "t", "p").collect()} == {0: 0.5, 1: 0.8, 2: 0.0}
    r = metrics.report_averages(d, "t", "p").first()
    assert abs(r.macro_f1 - 0.43333) < 1e-4 and abs(r.macro_recall - 0.5) < 1e-9 and abs(r.accuracy - 0.6) < 1e-9
    assert metrics.labels_agree(d, d) and not metrics.labels_agree(d, d.limit(2))
    two = metrics.union_results([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert rows(two) == [(1, None), (None, 2)]


def test_holm_and_permutation(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    h = {r.k: (round(r.p_corrected, 6), r.significant) for r in stats.holm(p, "p", "k").collect()}
    assert h == {"a": (0.04, True), "b": (0.09, False), "c": (0.09, False), "d": (0.5, False)}
    d = spark.range(400).select((F.col("id") % 3).cast("int").alias("t"), (F.col("id") % 3).cast("int").alias("a"), ((F.col("id") * 7) % 3).cast("int").alias("same"), F.lit(0).alias("b"))
    assert stats.compare(d, "t", "a", "same")["p_f1"] == 1.0
    r = stats.compare(d, "t", "a", "b")
    assert r["f1_a"] == 1.0 and r["p_f1"] < 0.01
    assert stats.pairwise(d, "t", ["a"]) is None and stats.pairwise(d, "t", ["a", "b", "same"]).count() == 3


def test_alignment(spark):
    seg = spark.createDataFrame([("c", 1, 0.0, 1.0, "hello there"), ("c", 2, 0.2, 1.1, "hello there"), ("c", 3, 50.0, 51.0, "other")], "CallID string, id bigint, start double, `end` double, text string")
    use = spark.createDataFrame([("c", 10, 0.1, 1.0, "hello there"), ("c", 11, 50.1, 51.2, "nothing like")], "CallID string, id bigint, start double, `end` double, text string")
    assert rows(align.near_in_time(seg, use).select("seg_id", "user_id")) == [(1, 10), (2, 10), (3, 11)]
    assert rows(align.user_segments(seg, use)) == [("c", 1, 10)]
    got = align.align_call(["where are you leaving from", "where are you going"], ["hm", "where are you", "leaving from", "where are you going"], [True, False, False, False])
    assert [(p, a, n) for p, a, n, _ in got] == [(0, 1, 2), (1, 3, 1)]


SIDE = "CallID string, id bigint, start double, `end` double, text string"


def test_user_segments_against_all_pairs(spark):
    r = random.Random(3)
    texts = ["yes", "yes", "yes please", "no", "next bus", "next buss", "the next bus", "", None]

    def side(n, first):
        return [(r.choice("cd"), first + k, x := r.choice([None, float("nan"), *(i / 4 for i in range(30))]), None if x is None else x + r.choice([0.5, 0.75, 1.5]), r.choice(texts)) for k in range(n)]

    seg, use = side(300, 1), side(250, -100)
    known = lambda d: sorted((x for x in d if x[2] is not None and x[2] == x[2] and x[4] is not None), key=lambda x: (x[2], x[1]))
    taken, expected = set(), []
    for c, i, a, b, t in known(seg):
        for c2, i2, a2, b2, t2 in known(use):
            if c == c2 and (c, i2) not in taken and abs(a - a2) <= 0.5 and abs(b - b2) <= 0.5 and X.ratio(t, t2) >= 80:
                taken.add((c, i2))
                expected.append((c, i, i2))
                break
    assert len(expected) > 100
    for block_rows in (20, 200_000):
        assert rows(align.user_segments(spark.createDataFrame(seg, SIDE), spark.createDataFrame(use, SIDE), block_rows=block_rows)) == sorted(expected, key=repr)


def test_user_segments_take_no_time_for_each_cluster_nor_each_pair_of_equal_rows(spark):
    n, m = 30_000, 4_000
    d = spark.range(n).selectExpr("concat('c', id % 2000) as CallID", "id", "id * 1D as start", "id + 0.5D as `end`", "concat('utterance ', id) as text")
    d = d.unionByName(spark.range(n, n + m).selectExpr("'hot' as CallID", "id", "1D as start", "2D as `end`", "'yes' as text"))
    began = time.time()
    assert align.user_segments(d, d).where("seg_id = user_id").count() == n + m
    assert time.time() - began < 60


def long_call(n, seed, words=4):
    """n prompts, and 2.4 segments each: the agent's, some cut, divided, lost or late, and the user's between them."""
    r = random.Random(seed)
    names = ["mill", "quay", "depot", "square", "loop", "street", "bridge", "market", ""][:words]
    prompts = [r.choice(["leave from {}", "going to {}", "next bus at {} {}", "sorry say {} again", "{}"]).format(r.choice(names), r.choice(names)).strip() for _ in range(n)]
    segments, late = [], []
    for p in prompts:
        x = r.random()
        if x < 0.1:
            k = r.randrange(len(p) + 1)
            segments += [(p[:k].strip(), False), (p[k:].strip(), False)]
        elif x < 0.2:
            late.append((p, False))
        elif x < 0.9:
            segments.append((p[: r.randrange(len(p) + 1)] if x < 0.4 else p, False))
        segments += [("yes", True)] * (r.random() < 0.8)
    segments += late
    while len(segments) < 2.4 * n:
        segments.insert(r.randrange(len(segments)), ("no", True))
    return prompts, [t for t, _ in segments], [u for _, u in segments]


def all_pairs(prompts, segments, is_user):
    """Alignment from the list of all candidates of the call."""
    effective = [sum(not x for x in is_user[:i]) for i in range(len(is_user))]
    known = {}
    found = sorted((-s, p, size, at) for p, t in enumerate(prompts) for i in range(len(segments)) if not is_user[i] for s, at, size in align.window_candidates(t, segments, is_user, i, effective, p, known))
    used, out = set(), {}
    for s, p, size, at in found:
        if p not in out and used.isdisjoint(range(at, at + size)):
            out[p] = (p, at, size, -s)
            used.update(range(at, at + size))
    return sorted(out.values())


def test_long_calls_are_aligned_as_a_whole():
    for seed in range(60):
        call = long_call(seed % 30, seed, 2 + seed % 8)
        assert align.align_call(*call) == all_pairs(*call)
    call = long_call(1000, 7)
    assert align.align_call(*call) == all_pairs(*call)


def test_segments_of_their_own_row_are_met_in_a_long_call(spark):
    n = 1200
    prompts = spark.range(n).selectExpr("'c' as CallID", "id", "id as place", "concat('stop ', id * 7919, ' or ', id * 104729) as text")
    segments = prompts.selectExpr("CallID", "-id as id", "cast(floor(place * 2.4) as bigint) as place", "text", "false as is_user")
    users = spark.range(int(n * 2.4)).where("floor(ceil(id / 2.4) * 2.4) != id").selectExpr("'c' as CallID", "id + 1 as id", "id as place", "'yes' as text", "true as is_user")
    got = align.align_prompts(prompts, segments.unionByName(users))
    assert got.where("first_seg = -prompt_id and n_segments = 1").count() == n


def test_words_decide_below_the_full_score():
    prompts, segments = ["going to umber mill"], ["zzz"] * 6 + ["going to amber hall now"]
    words = lambda who: [[("zzz", "A", 0.0, 1.0)]] * 6 + [[(w, who, 10.0 + i, 10.5 + i) for i, w in enumerate(segments[6].split())]]
    assert align.align_call(prompts, segments, [False] * 7, words("A"))[0][:3] == (0, 6, 1)
    assert align.align_call(prompts, segments, [False] * 7, words("B")) == []
    assert align.align_call(prompts, segments, [False] * 7)[0][:3] == (0, 6, 1)
    near = align.align_call(["zzz"], segments, [False] * 7, words("B"))  # from the full score on all words count
    assert near[0][:3] == (0, 0, 1) and near[0][3] >= align.FULL_SCORE


def test_aligned_times_are_those_of_the_words(spark):
    word = "struct<word: string, start: double, end: double, speaker: string>"
    prompts = spark.createDataFrame([("c", 1, 0, "Leaving at 5"), ("c", 2, 1, "nothing like it")], "CallID string, id bigint, place bigint, text string")
    seg = [("c", 10, 0, "leaving at five", False, 3.0, 9.0, [("leaving", 4.0, 4.5, "A"), ("at", 4.5, 5.0, "A"), ("five", 5.0, 6.0, "B")]), ("c", 11, 1, "hm", True, 9.0, 10.0, None)]
    s = spark.createDataFrame(seg, f"CallID string, id bigint, place bigint, text string, is_user boolean, start double, `end` double, words array<{word}>")
    got = {r.prompt_id: r for r in align.align_prompts(prompts, s).collect()}
    assert (got[1].first_seg, got[1].StartTime, got[1].EndTime, got[1].Transcript) == (10, 4.0, 6.0, "leaving at five")
    assert (got[2].first_seg, got[2].StartTime, got[2].Transcript) == (None, None, "nothing like it")
    plain = {r.prompt_id: r for r in align.align_prompts(prompts, s.drop("words")).collect()}
    assert (plain[1].StartTime, plain[1].EndTime) == (3.0, 9.0)


def test_word_lists(spark):
    w = "array<struct<word: string, start: double, end: double, speaker: string>>"
    d = spark.createDataFrame([([("a", 0.0, 1.0, "x"), ("b", None, 2.0, "y"), ("c", 2.0, 3.0, "y")], [True, False]), ([], []), (None, None)], f"w {w}, taken array<boolean>")
    r = d.select(W.words_text(W.of_speaker(F.col("w"), F.lit("y"))).alias("said"), W.main_speaker(F.col("w")).alias("who"), W.shifted_words(F.col("w"), F.lit(1.5)).alias("late"), W.flat_words(F.array(F.struct(F.col("w").alias("words")))).alias("flat"), W.none_taken(W.places(F.lit(1), F.lit(3)), F.col("taken")).alias("free"), W.places(F.lit(4), F.lit(0)).alias("none")).collect()
    assert (r[0].said, r[0].who, [x.start for x in r[0].late], len(r[0].flat), r[0].free, r[0].none) == ("b c", "y", [1.5, None, 3.5], 3, True, [])
    assert (r[1].said, r[1].who, r[1].flat, r[2].who, r[2].flat) == ("", None, [], None, [])


def test_groups_of_features_are_scaled_and_reduced(spark):
    rng = random.Random(5)
    cols = ["CallID", "IQMedian", "Prompt_sbert_dim0", "Prompt_sbert_dim1", "wav2vec2_Emb0", "wav2vec2_Emb1", "NumPauses"]
    raw = [(str(i % 3), i % 5 + 1, a := rng.gauss(0, 1), 2 * a + 1, rng.gauss(0, 1), rng.gauss(0, 1), float(i) if i else None) for i in range(40)]
    d = spark.createDataFrame(raw, ", ".join(f"{c} {k}" for c, k in zip(cols, ["string", "int"] + ["double"] * 5, strict=True)))
    a, b = features.scale_and_reduce(d, [d, d.limit(0)], {"systemf_text": 0.9, "speechf_wav": None})
    assert a.columns == ["CallID", "IQMedian", "non_pca__NumPauses", "prompt_sbert__pca0", "speechf_wav2vec__pca0", "speechf_wav2vec__pca1"] == b.columns
    r = a.agg(F.min("IQMedian"), F.avg("prompt_sbert__pca0"), F.var_pop("prompt_sbert__pca0"), F.count("non_pca__NumPauses")).first()
    assert r[0] == 0 and abs(r[1]) < 1e-9 and abs(r[2] - 2) < 1e-6 and r[3] == 40


def test_results_of_differing_headers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.csv").write_text("macro_f1,model_type\n0.5,lstm\n")
    (tmp_path / "a" / "b" / "y.csv").write_text("model_type,epochs,macro_f1\nbert,3,0.75\nbert,nan?,0.25\n")
    got = readers.read_kind(spark, "cv_results", str(tmp_path)).select("model_type", "epochs", "macro_f1")
    assert rows(got) == sorted([("lstm", None, 0.5), ("bert", 3.0, 0.75), ("bert", None, 0.25)], key=repr)
    assert rows(metrics.filtered(got, model_type="bert", epochs=None).select("macro_f1")) == [(0.25,), (0.75,)]


def test_nested_counts_and_first_keys(spark):
    texts = ["semantic no match", "a b", "route[61A]", "r[1] (s[2])", "(x)", "(x", "(x) y[1]", "a (b) (c", "a ) b", "q[x (y) z](w)", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    r = {x.i: x for x in d.select("i", X.first_key(F.col("t")).alias("k"), X.semantic_counts(F.col("t")).alias("c")).collect()}
    assert [r[i].k for i in range(len(texts))] == ["semantic_no_match", "a", "route", "r", "", "x", "y", "c", "a", "q", "", None]
    want = [{"semantic_no_match": 1}, {"a": {"b": 1}}, {"route": {"61A": 1}}, {"r": {"s": {"2": 1}}}, {}, {"x": 1}, {"y": {"1": 1}}, {"c": 1}, {"a": {"b": 1}}, {"q": {"w": 1}}, {}]
    assert [json.loads(r[i].c) for i in range(11)] == want and r[11].c is None
    assert all((next(iter(n), "") == r[i].k) for i, n in enumerate(want))


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 0 and "turn_taking" in capsys.readouterr().out and cli.main(["nothing"]) == 2
    out = str(tmp_path / "o")
    assert cli.main(["holm_correction", "--base", "/root/testdata", "--data", "sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 25
    assert paths.resolve("/a", "b/c") == "/a/b/c" and paths.resolve("/a", "/b") == "/b" and paths.resolve("/a", "s3://b") == "s3://b"


def test_vectors_are_taken_whole(spark, tmp_path):
    d = spark.createDataFrame([(1, [float(i) for i in range(70)]), (2, [3.0]), (3, [])], "vec_id bigint, embedding array<float>")
    d.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in catalogue.QUERIES["expand_vector"](spark, str(tmp_path)).collect()}
    assert [got[1][f"dim{i}"] for i in range(70)] == list(range(70)) and got[2].dim0 == 3.0 and got[2].dim69 is None and len(got[3]) == 71
    assert rows(catalogue.QUERIES["pad_mask"](spark, str(tmp_path))) == [(1, 34.5, 70), (2, 3.0, 1), (3, None, 0)]
    padded = {r.vec_id: r for r in features.pad_all(d, "embedding").collect()}
    assert [(len(r.padded), len(r.mask), sum(r.mask)) for _, r in sorted(padded.items())] == [(70, 70, 70), (70, 70, 1), (70, 70, 0)]


def test_type_report_counts_exactly(spark):
    d = spark.range(19_999).selectExpr("cast(id % 9999 as string) as a", "cast(id % 10000 as string) as b")
    assert rows(cleaning.type_report(d)) == [("a", 19_999, 9999, True), ("b", 19_999, 10_000, False)]


@pytest.mark.parametrize("name", ["expand_vector", "pad_mask", "user_sheet", "type_report", "null_profile"])
def test_whole_rows_equal_their_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("embeddings", "validated_user_transcript", "system_features_full"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    r = con.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    df = catalogue.QUERIES[name](spark, tiny)
    assert df.columns == names and rows(df) == sorted(r.fetchall(), key=repr)


def test_signal(spark):
    d = spark.createDataFrame([([0.1] * 8, [(0.0, 1.0)]), ([0.5], []), ([], [(0.0, 1.0)])], "x array<double>, s array<struct<start: double, end: double>>")
    level = signal.loudness(F.col("x"), F.col("s"), 8.0)
    r = d.select(level.alias("l"), signal.normalise(F.col("x"), level).alias("y")).collect()
    assert abs(r[0].l - 0.100001) < 1e-9 and abs(r[0].y[0] - 0.1 * 0.07 / 0.100001) < 1e-9 and r[1].l is None and r[1].y == [0.5] and r[2].l is None
    v = signal.attention_pool(np.eye(3), np.eye(3), np.zeros(3), np.zeros(3), np.array([True, True, False]))
    assert np.allclose(v, [0.5, 0.5, 0])
    m = signal.with_model(spark.createDataFrame([("ab",), (None,)], "t string"), lambda: lambda xs: [float(len(x)) for x in xs], "t", "n", "double")
    assert rows(m) == [("ab", 2.0), (None, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "log.csv").write_bytes("CallID;Prompt\n1;caf\xe9\nnan;\n".encode("latin-1"))
    assert rows(readers.read_log(spark, str(tmp_path / "log.csv"))) == [("1", "caf\xe9"), (None, None)]
    (tmp_path / "20000111265.rttm").write_text("SPEAKER x 1 0.5 1.25 <NA> <NA> 1.0 <NA>\nnoise\nSPEAKER x 1 2\n")
    assert rows(readers.read_rttm(spark, str(tmp_path / "20000111265.rttm"))) == [("x", 0.5, 1.75)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "20000111265.json").write_text('{"segments": [{"start": 0.0, "end": 1.0, "text": "hi", "words": [{"word": "hi", "start": 0.0, "end": 1.0, "speaker": "A"}]}]}')
    m = readers.read_mixed(spark, str(tmp_path / "j")).first()
    assert m.CallID == "20000111265" and m.words[0].speaker == "A"
    p = spark.createDataFrame([("a/x20000111265_output.wav",), ("a/20000111265_user.wav",), (None,)], "p string")
    assert rows(readers.audio_pairs(p, "p")) == [("20000111265", "a/x20000111265_output.wav", "a/20000111265_user.wav")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "20000111265.wav").write_bytes(b"RIFF" + (36 + 8).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + (8).to_bytes(4, "little") + bytes(8))
    (tmp_path / "w" / "20000111266.wav").write_bytes(b"RIFX")
    assert rows(readers.read_audio(spark, str(tmp_path / "w")).select("filecode", "frames", "reason")) == [("20000111265", 4, None), ("20000111266", None, "unreadable")]
    (tmp_path / "grid.txt").write_text("1 a\n2 b\n")
    assert readers.read_config(spark, str(tmp_path / "grid.txt"), 2) == ["2", "b"]
    with pytest.raises(ValueError):
        readers.read_kind(spark, "no", "x")
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    for _ in range(2):
        assert writers.once(spark, str(tmp_path / "once"), make).count() == 3
    assert made == [1]


def test_user_sheet_keeps_times_and_text(spark):
    d = spark.createDataFrame([("c", "user", 1.234, None, "hi")], "CallID string, Speaker string, StartTime double, EndTime double, Transcript string")
    assert rows(writers.user_sheet(d)) == [("c", "user", "1.23", None, "hi")]
