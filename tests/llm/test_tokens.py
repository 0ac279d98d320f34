import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwright.llm.packing import Windows, pack
from turnwright.llm.pieces import cut, places, split_texts
from turnwright.llm.tokens import codec, decode_column, divides, encode_column

TEXTS = ["", " ", "\n\n  \n", "a", "hello world. How are you?\n\nFine,  thanks.", "<|endoftext|> it's 's", "日本語の文章。" * 40, "x" * 3000, "é \U0001f600 ​    z", " \t\n" * 500, "don't I'll we've " * 200, "123456789" * 300]


@pytest.mark.parametrize("leaf", [2, 7, 64, 4096])
def test_tree_encoding_is_the_encoding(leaf):
    c = codec("byte_bpe_50k", leaf=leaf)
    for t in TEXTS:
        assert c.encode(t) == c.plain(t)
        assert c.decode(c.encode(t)) == t
    assert c.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sZ1 \n\t  .,é中\U0001f600"), max_size=80), st.integers(2, 9))
def test_tree_encoding_of_any_text(text, leaf):
    c = codec("byte_bpe_50k", leaf=leaf)
    assert c.encode(text) == c.plain(text)


def test_other_vocabulary_and_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    c = codec("byte_bpe_50k", leaf=16)
    assert all(c.encode(x) == t.encode(x, add_special_tokens=False).ids for x in TEXTS)
    m = codec("byte_bpe_multi_50k", leaf=16)
    assert all(m.decode(m.encode(x)) == x for x in TEXTS)


def test_columns(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x", ""), (99, None, ""), (0, "", "")]
    d = spark.createDataFrame(rows, "k bigint, text string, ids string")
    e = encode_column(d, "k", "text", leaf=32)
    got = [(r.k, r.ids) for r in e.collect()]
    assert len(got) == len(rows) and (99, []) in got and got.count((0, [])) == 2
    back = {r.k: r.text for r in decode_column(e, "k", "ids").collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert encode_column(d.limit(0), "k", "text").count() == 0


def packed(df):
    got, fill = defaultdict(list), defaultdict(int)
    for r in df.collect():
        got[r.i].append(r)
        fill[r.container] += r.n_tokens
    return got, fill


@pytest.mark.parametrize(("per_task", "full"), [(4000, 0.97), (5, 0.95)])  # tasks of five containers leave nearly all to be merged
def test_packing(spark, monkeypatch, per_task, full):
    monkeypatch.setattr("turnwright.llm.packing.PER_TASK", per_task)
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 1, 7, 40, 99, 100, 101, 250, rng.randint(1, 100)]), "clash") for i in range(2500)] + [(9000, None, "")]
    got, fill = packed(pack(spark.createDataFrame(sizes, "i bigint, n int, container string"), "i", "n", 100))
    assert set(got) == {s[0] for s in sizes} and max(fill.values()) <= 100
    for i, n, _ in sizes:
        v = sorted(got[i], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in v) == (n or 0) and (len(v) == 1 or n > 100)
        assert [r.first_token for r in v] == [100 * k for k in range(len(v))]
    total = sum(n or 0 for _, n, _ in sizes)
    assert total / (100 * len(fill)) > full
    again, _ = packed(pack(spark.createDataFrame(sizes[::-1], "i bigint, n int, container string"), "i", "n", 100))
    assert {(r.i, r.piece_no, r.container) for v in again.values() for r in v} == {(r.i, r.piece_no, r.container) for v in got.values() for r in v}


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], "i bigint, n int"), "i", "n", 10).count() == 0
    assert pack(spark.createDataFrame([(1, 0)], "i bigint, n int"), "i", "n", 10).count() == 1


def test_windows_take_the_fullest_that_fits():
    w = Windows(10, 0, most=2)
    assert [w.put(x) for x in (6, 7, 3, 5, 10, 1)] == [0, 1, 1, 2, 3, 2]


@pytest.mark.parametrize(("limit", "overlap"), [(40, 5), (64, 0), (30, 10)])
def test_pieces(limit, overlap):
    c = codec("byte_bpe_50k")
    texts = [*TEXTS, "One two three four. " * 100, ("Para one is here.\n\n" + "word " * 30) * 9, "家" * 500, "\U0001f600" * 200, "a [SEP] " * 100]
    for t in texts:
        p = cut(t, c, limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(t)
        for a, b, s, e, own, _ in p:
            assert own == len(c.plain(t[a:b])) <= limit and (len(p) == 1 or e > s)
        for x, y in zip(p, p[1:], strict=False):
            assert overlap <= x[3] - y[2] <= overlap + 3 and y[0] <= x[1] < y[1] and y[0] > x[0]
    kinds = {x[5] for x in cut("One two three four. " * 100, c, limit, overlap)}
    assert kinds <= {"sentence", "end", "word"} and "sentence" in kinds


def test_split_texts(spark):
    d = spark.createDataFrame([(1, "word " * 900, "q"), (2, "", "q"), (3, None, "q"), (4, "short", "q")], "k bigint, text string, cut_kind string")
    got = defaultdict(list)
    for r in split_texts(d, "k", "text", 128, 16).collect():
        got[r.k].append(r)
    assert len(got[1]) > 7 and [len(got[k]) for k in (2, 3, 4)] == [1, 1, 1] and got[4][0].text == "short" and got[3][0].n_tokens == 0
    with pytest.raises(ValueError):
        split_texts(d, "k", "text", 40, 20)
    assert split_texts(d.limit(0), "k", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.,!?)\"\n\n \t 　。、é😀[SEP]"))
def test_places_are_those_of_the_patterns(text):
    patterns = (r"\S(?=[^\S\n]*\n\s*\n)", r"\[SEP\]|\S(?=[^\S\n]*\n)", r"[.!?…][\"'”’)\]]*(?=\s)|[。！？]", r"[,;:](?=\s)|[，；、]", r"\S(?=\s)")
    found, must = places(text)
    for p, at in zip(patterns, found, strict=True):
        assert at.tolist() == [m.end() for m in re.finditer(p, text)]
    assert must.tolist() == [x for x in range(1, len(text)) if divides(text, x)]
