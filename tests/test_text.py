import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnwright.functions import text as X


@pytest.mark.parametrize(
    ("text", "output", "key"),
    [
        ("61A", "sixty one A", "sixty one a"),
        ("at 9am", "at nine am", "at nine am"),
        ("at 5 p.m. today", "at five p . m. today", "at five p m today"),
        ("10:30 am", "ten:thirty a m", "ten thirty a m"),
        ("10:30am", "ten:thirty am", "ten thirty am"),
        ("10:30", "ten thirty", "ten thirty"),
        ("8:00", "eight", "eight"),
        ("8:05", "eight oh five", "eight oh five"),
        ("105", "one oh five", "one oh five"),
        ("100", "one hundred", "one hundred"),
        ("123", "one hundred and twenty three", "one hundred and twenty three"),
        ("", "", ""),
    ],
)
def test_spoken_form(text, output, key):
    assert X.spoken_form(text) == (text, output, key)


def test_number_words():
    assert X.number_words("1234") == "one thousand, two hundred and thirty four"
    assert X.number_words("007") == "seven" and X.number_words("x") == "x" and X.number_words("1005") == "one thousand and five"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_ratio(a, b):
    assert X.lcs(a, b) == plain_lcs(a, b)
    assert X.ratio(a, b) == X.ratio(b, a) and 0 <= X.ratio(a, b) <= 100


def test_ratio_values():
    assert abs(X.ratio("kitten", "sitting") - 61.5385) < 1e-3 and X.ratio("", "") == 100 and X.ratio("abc", "xyz") == 0


def test_columns(spark):
    d = spark.createDataFrame([("NEXT BUS 61c CMU, OK", "Hello , World !  Bye", "request[a] (b)"), (None, None, None), ("", "", " semantic no match")], "a string, p string, s string")
    r = d.select(X.clean_agent(F.col("a")), X.prompt_key(F.col("p")), X.first_key(F.col("s")), X.has_word(F.col("s"), "REQUEST")).collect()
    assert tuple(r[0]) == ("Next Bus 61C CMU, Ok", "hello, world! bye", "request", True)
    assert tuple(r[1]) == (None, None, None, False)
    assert tuple(r[2]) == ("", "", "semantic_no_match", False)


def test_clean_agent_words(spark):
    cases = {"take the 61c, THEN (STOP)": "take the 61C, Then (stop)", "CMU. I B2 A1B, x9y": "CMU. I B2 A1b, x9Y", "61c/62d": "61c/62d", "from 28x-54c now": "from 28x-54c now", "plain words": "plain words", "ÉTÉ 7e": "Été 7E", "12a!": "12A!"}
    d = spark.createDataFrame(list(cases.items()), "a string, want string")
    assert [(r.a, r.got) for r in d.select("a", X.clean_agent(F.col("a")).alias("got"), "want").collect()] == list(cases.items())


def test_names():
    assert X.model_tag("a/all-MiniLM-L6") == "sbert" and X.model_tag("a/all-MiniLM-L6", False) == "all_MiniLM_L6" and X.pca_tag(0.9) == "9" and X.pca_tag(None) == ""
