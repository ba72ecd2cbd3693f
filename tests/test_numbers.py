"""Keys stay what they are, default rules keep real shares."""

from civicflow import functions as cf
from civicflow.operators import clean


def test_integers_from_text(spark):
    cases = {"9007199254740993": 9007199254740993, "9007199254740993.0": 9007199254740993, "9223372036854775807": 9223372036854775807, "10001.0": 10001,
             "10001-123": None, "10001.5": None, "": None, " 42 ": 42, "1e3": 1000, "nan": None, "Infinity": None, "9223372036854775808": None, "1e25": None, "-7": -7, None: None,
             "0.000000000000000000000001": None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["t"]: r["n"] for r in df.select("t", cf.to_int_or_null("t").alias("n")).collect()}
    assert got == cases
    numbers = spark.createDataFrame([(1.0,), (2.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(cf.to_int_or_null("x")).collect()] == [1, None, None, None]


def test_digits_or_zero(spark):
    cases = {"123": 123, "007": 7, "1" * 20: 0, "12a": 0, "": 0, None: 0, "-3": 0}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", cf.digits_or_zero("t").alias("n")).collect()} == cases


def test_shares_above_one_are_valid_by_default(spark):
    df = spark.createDataFrame([(0.9, 0.4), (1.2, 0.0)], "a double, b double")
    assert [r["is_valid"] for r in clean.quarantine(df, clean.ticket_rules(shares=["a", "b"])).collect()] == [True, False]
    strict = clean.ticket_rules(shares=["a", "b"], shares_add_up=True)
    assert [r["failed_rules"] for r in clean.quarantine(df, strict).collect()][0] == ["shares_add_up"]
