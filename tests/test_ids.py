from pyspark.sql import functions as F

from turnwright.functions.ids import call_id, millis, present, seconds


def values(spark, column, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in d.orderBy("i").select(column(F.col("t"))).collect()]


def test_spellings_of_a_call(spark):
    same = ["20000111265", "2000111265", "20000111265.0", "2000111265.0", "2.0000111265e+10", "2.000111265e+09", "'20000111265", "20000111-265", "LGP-20000111265", " 20000111265\t", " 20000111265", "20000111265  "]
    assert values(spark, call_id, same) == ["20000111265"] * len(same)


def test_no_call(spark):
    none = [None, "", " ", "-", "nan", "NA", "None", "unknown", "\\N", "<NA>", "00000000000", "0000000000", "123", "call 7", "200001112650"]
    assert values(spark, call_id, none) == [None] * len(none)


def test_seconds(spark):
    given = {"7.2": 7.2, " 21.4": 21.4, "43,48": 43.48, "3.752e+01": 37.52, "0:01:18": 78.0, "2:49:44": 10184.0, "1:05": 65.0, "10.2s": 10.2, "12.16 sec": 12.16, "+13.5": 13.5, "165": 165.0, "1500 ms": 1.5, "2 min": 120.0, ".5": 0.5}
    got = values(spark, seconds, list(given))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, given.values(), strict=True))
    none = [None, "", "0", "0.00", "00:00:00", "-1", "-999", "inf", "nan", "NaN ", "E607", "ERR 12", "<100?>", "see note", "#VALUE!", "--", "1.2.3"]
    assert values(spark, seconds, none) == [None] * len(none)


def test_present_and_millis(spark):
    assert values(spark, present, ["a ", " ", "NA", None, "?"]) == ["a", None, None, None, None]
    d = spark.sql("select * from values (8.6194D), (cast('nan' as double)), (cast(null as double)), (cast('inf' as double)) t(x)")
    assert [r[0] for r in d.select(millis(F.col("x"))).collect()] == [8619, None, None, None]
