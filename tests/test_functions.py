
import pytest
from pyspark.sql import functions as F

from txnclean.functions.amounts import amount_stages
from txnclean.functions.dates import date_stages
from txnclean.functions.keys import amount_key, amount_text, is_float_text, two_places
from txnclean.functions.text import clean_text, is_null_like, text_key

DATES = [
    ("2026/04/16", "2026-04-16", 1), ("16-04-2026", "2026-04-16", 1),
    ("2026-04-16T12:30:00Z", "2026-04-16", 1), ("31/02/2026", None, 0),
    ("2026-02-31", "2026-02-31", 0), ("2026/13/01", None, 0), ("03/04/2026", "2026-04-03", 1),
    ("04/13/2026", "2026-04-13", 1), ("13/13/2026", None, 0), ("0/5/2026", None, 0),
    ("1/1/99", "2099-01-01", 1), ("123/04/2026", "2026-04-23", 1), ("20260416", None, 0),
    ("16-Apr-2026", None, 0), ("16th April 2026", None, 0), ("16 Apr 26", None, 0),
    ("Sept 16 2026", None, 0), ("Thursday 16 April 2026", "2026-04-16", 1),
    ("Apr 16, 2026", "2026-04-16", 1), ("16 APR 2026", "2026-04-16", 1),
    ("  2026-04-16  ", "2026-04-16", 0), ("nan", None, 0), (" NULL ", None, 0), (None, None, 0),
    ("2026.04.17", "2026-04-17", 1), ("17 Apr 2026", "2026-04-17", 1), ("13/04/26", "2026-04-13", 1),
    ("May 5 2026", "2026-05-05", 1), ("5 may 2026", "2026-05-05", 1), ("0000-01-01", "0000-01-01", 0),
    ("0000/01/01", None, 0), ("1/2/202", "0202-02-01", 1), ("on 2026/4/5 at noon", "2026-04-05", 1),
    ("2026-4-18", "2026-04-18", 1), ("18/4/2026", "2026-04-18", 1), ("29/02/2024", "2024-02-29", 1),
    ("December 31, 1999", "1999-12-31", 1), ("32 Jan 2026", None, 0),
    ("16\u00a0Apr\u3000 2026", "2026-04-16", 1), ("x\tApr 16 ,\t2026", None, 0),
    ("Apr 16,\u00a02026", "2026-04-16", 1),
]

AMOUNTS = [
    ("₹1,234.50", 1234.5, 1), ("(€5,000.00)", -5000.0, 1), ("$", None, 1), ("$-5", 5.0, 1),
    ("-$5", -5.0, 1), ("-(5)", -5.0, 0), ("₹(5)", 5.0, 1), ("5-", 5.0, 0), (".5", 5.0, 0),
    ("1.234,56", 1.23456, 0), ("1e5", 1.0, 0), ("12.34.56", 12.34, 0), ("15%", 15.0, 0),
    ("1 234", 1234.0, 0), ("1 234", 1.0, 0), ("9.99 USD", 9.99, 0), ("12abc", 12.0, 0),
    ("nan", None, 0), ("", None, 0), (None, None, 0), ("€ 45.50", 45.5, 1), ("$$12", 12.0, 2),
    ("( 7 )", -7.0, 0), ("()", None, 0), ("-0", -0.0, 0), ("abc", None, 0),
]


def _run(spark, rows, stages_fn, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    for st in stages_fn("v", "out", "extra", "__t_"):
        df = df.withColumns(st)
    return [(r["v"], r["out"], r["extra"]) for r in df.select("v", "out", "extra").collect()]


def test_date_rules(spark):
    got = _run(spark, [d[0] for d in DATES], date_stages)
    for (raw, exp, fixed), (_, out, fx) in zip(DATES, got):
        assert (out, fx) == (exp, fixed), raw


def test_amount_rules(spark):
    got = _run(spark, [a[0] for a in AMOUNTS], amount_stages)
    for (raw, exp, cnt), (_, out, c) in zip(AMOUNTS, got):
        assert c == cnt, raw
        if exp is None:
            assert out is None, raw
        else:
            assert out == pytest.approx(exp), raw
            assert (str(out)[0] == "-") == (str(exp)[0] == "-"), raw


def test_null_like_and_text(spark):
    vals = ["", "  ", "nan", "NaN", "NA", "null", "None", " none ", "n/a", "-", "?", " Coffee  Shop ", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = df.select(is_null_like(F.col("v")).alias("n"), clean_text(F.col("v")).alias("t"),
                    text_key(F.col("v")).alias("k")).collect()
    assert [r.n for r in got] == [True] * 8 + [False] * 4 + [True]
    assert got[11].t == "Coffee  Shop" and got[11].k == "coffee shop"
    assert got[8].t == "n/a" and got[12].k == ""


def test_keys_and_output_text(spark):
    vals = [1200.0, 45.5, 0.0, -0.0, -0.004, 0.125, 100.0, 10.1, None, 1e16]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(amount_key(F.col("x")).alias("k"), amount_text(F.col("x")).alias("t")).collect()
    assert [r.k for r in got] == ["1200.00", "45.50", "0.00", "-0.00", "-0.00", "0.12", "100.00",
                                  "10.10", "", "10000000000000000.00"]
    assert [r.t for r in got][:8] == ["1200", "45.5", "0", "-0", "-0", "0.12", "100", "10.1"]
    assert got[8].t is None
    _ = two_places


def test_float_text(spark):
    vals = {"1.5": True, " 2 ": True, "1_000": True, "1e5": True, ".5": True, "5.": True,
            "inf": True, "-Infinity": True, "nan": True, "1d": False, "abc": False, "": False,
            "1__0": False, "0x10": False, "+3": True, "2026-04-16": False}
    df = spark.createDataFrame([(k,) for k in vals], "v string")
    got = {r.v: r.ok for r in df.select("v", is_float_text(F.col("v")).alias("ok")).collect()}
    assert got == vals


def test_halves_are_rounded_by_their_exact_value(spark):
    import random
    from pyspark.sql import functions as F
    from txnclean.functions.keys import round_two, two_places

    rnd = random.Random(2)
    values = [10.005, 2.675, 1.005, 0.125, 0.375, -2.675, 0.005, -0.005, 1e12 + 0.125, 5e-324, 1e300, -1e300, 0.0, 123456789.125, 9999999999.995]
    values += [rnd.choice([1, -1]) * (rnd.randrange(10 ** rnd.randrange(1, 13)) * 10 + 5) / 1000 for _ in range(10_000)]
    values += [rnd.uniform(-1e6, 1e6) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", round_two(F.col("x")).alias("r"), two_places(F.col("x")).alias("t")).collect():
        assert r["r"] == round(r["x"], 2), r
        assert abs(r["x"]) > 1e15 or r["t"] == f"{round(r['x'], 2):.2f}", r
