import random

import pytest
from pyspark.sql import functions as F

from turnwright.llm.turns import resolve, spoken, turn_texts, turns

CASES = [
    ("user", "hm right now", "user", "right now"),
    ("USER", "00:00:08,619 --> 00:00:08,708 hm right now", "user", "right now"),
    (None, "[00:04] User: yes please", "user", "yes please"),
    ("nan", "SYSTEM: next bus", "agent", "next bus"),
    ("?", "[other] at 6:10", "other", "at 6:10"),
    ("", "Caller> 5:15", "user", "5:15"),
    ("NA", "[background music] the one before that", "user", "the one before that"),
    (None, "at 2:55 hm", "user", "at 2:55"),
    (None, "bystander - mom which bus", "other", "mom which bus"),
    (None, "A: where to", "agent", "where to"),
    ("third party", "turn the radio down", "other", "turn the radio down"),
    ("Caller:", "from uh juniper depot", "user", "from juniper depot"),
    ("user_1", "*door slams*", "user", None),
    ("usr", "uh... um, [NOISE] ((static))", "user", None),
    ("U", "<37.66>", "user", None),
    ("SYS", "User:", "agent", None),
    ("bot", " ", "agent", None),
    (" user", "nan", "user", None),
    ("user", None, "user", None),
    ("user", "...", "user", None),
    ("somebody", "I AM at Um, UMBER MILL", "other", "I AM at UMBER MILL"),
    ("user", "(0:11.8) the 17K", "user", "the 17K"),
    ("user", "that's wrong [10.2s]", "user", "that's wrong"),
    ("user", "ohm " * 5000, "user", ("ohm " * 5000).strip()),
]


def test_roles_and_speech(spark):
    d = spark.createDataFrame([(i, "c", s, t, "clash") for i, (s, t, _, _) in enumerate(CASES)], "i int, call string, sp string, tx string, roles string")
    got = {r.i: r for r in spoken(d, "call", "sp", "tx").collect()}
    for i, (s, t, role, speech) in enumerate(CASES):
        assert (got[i].speaker_role, got[i].speech) == (role, speech), (s, t)


def test_variants_of_a_label():
    got = resolve(["user", "usr", "u", "caler", "callr", "agnt", "bystandr", "background noise", "tp", "zebra"])
    assert got == {"user": "user", "usr": "user", "u": "user", "caler": "user", "callr": "user", "agnt": "agent", "bystandr": "other", "background noise": "other", "tp": "other"}


def test_unknown_labels_that_resemble_each_other_share_a_role():
    got = resolve(["bystander", "bystanderrr", "bystanderrrrrr", "zebrafinch", "zebrafinche"])
    assert got == {"bystander": "other", "bystanderrr": "other", "bystanderrrrrr": "other"}
    assert resolve(["passengerrr", "passengerrrrrr"]) == {"passengerrr": "user", "passengerrrrrr": "user"}


def brute(rows, pause=1500):
    out, by = [], {}
    for call, k, s, t, role, text in {(r[0], r[1]): r for r in rows}.values():
        if call is not None and s is not None and t is not None and t > s and text is not None:
            by.setdefault(call, []).append((s, t, k, role))
    for call, v in by.items():
        now = None
        for s, t, _, role in sorted(v):
            if now and now[0] == role and s <= now[2] + pause:
                now[2] = max(now[2], t)
            else:
                if now:
                    out.append((call, *now))
                now = [role, s, t]
        out.append((call, *now))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        s = rng.randrange(0, 3_000_000) if rng.random() < 0.5 else rng.randrange(590_000, 620_000)
        rows.append((rng.choice(["a", "b", None]), k, rng.choice([s, s, s, None]), s + rng.choice([-5, 0, 400, 2000, 1_300_000 if k % 50 == 0 else 900]), rng.choice(["user", "user", "agent"]), rng.choice(["x", "x", None])))
    rows += rows[:40]
    d = spark.createDataFrame(rows, "call string, k bigint, s bigint, t bigint, speaker_role string, speech string")
    cut = turns(d, "call", "k", "s", "t", block_rows=20)
    assert sorted(map(tuple, cut.select("call_id", "speaker_role", "start_ms", "end_ms").collect())) == brute(rows)
    parts = turn_texts(d, "call", "k", "s", "t", part_rows=3, block_rows=50).collect()
    assert sorted((r.call_id, r.speaker_role, r.start_ms, r.end_ms) for r in parts if r.part_no == 1) == brute(rows)
    assert sum(r.text.count("x") for r in parts) == sum(r.n_rows for r in parts if r.part_no == 1) and max(r.text.count("x") for r in parts) == 3
    got = turns(d, "call", "k", "s", "t")
    assert sorted(map(tuple, got.select("call_id", "speaker_role", "start_ms", "end_ms").collect())) == brute(rows)
    assert got.agg(F.sum("n_rows")).first()[0] == len({(r[0], r[1]) for r in rows if r[0] and r[2] is not None and r[3] > r[2] and r[5]})


def test_no_rows(spark):
    d = spark.createDataFrame([], "call string, k bigint, s bigint, t bigint, sp string, tx string")
    assert turns(spoken(d, "call", "sp", "tx"), "call", "k", "s", "t").count() == 0
