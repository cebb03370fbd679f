from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as x


def one(spark, column, *values, schema=None):
    df = spark.createDataFrame([(v,) for v in values], schema or "v string")
    return [r[0] for r in df.select(column.alias("out")).collect()]


def test_proper_first_trims_blanks_only_and_touches_one_letter(spark):
    got = one(spark, x.proper_first("v"), " MUMBAI ", "new delhi", "x", "", None, "\tab")
    assert got == ["Mumbai", "New delhi", "X", "", None, "\tab"]


def test_title_words_upper_cases_every_letter_run(spark):
    texts = ["HR", " \tsales ops\n", "o'neil", "a1b", "quality-assurance", "", None]
    got = one(spark, x.title_words("v", {"Hr": "HR"}), *texts)
    assert got == ["HR", "Sales Ops", "O'Neil", "A1B", "Quality-Assurance", "", None]


@pytest.mark.parametrize("text", ["hello world", "it's", "x2y z", "É cole", "a--b", "don't stop"])
def test_title_words_agrees_with_python(spark, text):
    assert one(spark, x.title_words("v"), text) == [text.strip().title()]


def test_blank_to(spark):
    assert one(spark, x.blank_to("v", "Unknown"), None, "", "  ", " Express ") == ["Unknown"] * 3 + ["Express"]


def test_iso_date_never_fails(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-1-5", "2024-01", "20240105", "x", "", None, "2024-01-05 10:00:00", "2024-01-05T10", "2024-01-05x"]
    day = date(2024, 1, 5)
    assert one(spark, x.iso_date("v"), *texts) == [date(2024, 2, 29), *[None] * 7, day, day, None]


def test_round_away(spark):
    got = one(spark, x.round_away("v", 1), 0.25, -0.25, 0.04, -0.04, 2.5, None, schema="v double")
    assert got == [0.3, -0.3, 0.0, 0.0, 2.5, None]
    assert str(got[3]) == "0.0"
    assert one(spark, x.round_away("v"), 0.5, 1.5, -2.5, schema="v double") == [1.0, 2.0, -3.0]


def test_division_by_zero_is_null(spark):
    assert one(spark, x.ratio("v", F.lit(0)), 1.0, schema="v double") == [None]
    assert one(spark, x.percent("v", F.lit(0)), 1.0, schema="v double") == [None]
    assert one(spark, x.percent("v", F.lit(8)), 1.0, schema="v double") == [12.5]


def test_months(spark):
    assert one(spark, x.month_key(F.col("v").cast("date")), "2024-03-09") == ["2024-03"]
    got = one(spark, x.month_number("v") - x.month_number(F.lit("2023-11")), "2024-02", "2023-11", "2023-01")
    assert got == [3, 0, -10]


def test_portable_types(spark):
    df = spark.sql("SELECT 1 AS i, CAST(2.50 AS DECIMAL(9,2)) AS d, DATE'2024-01-02' AS t, 'x' AS s, true AS b")
    out = x.portable(df)
    assert dict(out.dtypes) == {"i": "bigint", "d": "double", "t": "string", "s": "string", "b": "boolean"}
    assert tuple(out.first()) == (1, 2.5, "2024-01-02", "x", True)
    assert df.first()["d"] == Decimal("2.50")


def test_long_texts_keep_their_end(spark):
    text = "ab" * 1_000_000
    row = spark.createDataFrame([(text,)], "t string").select(x.proper_first("t").alias("t")).first()
    assert row.t == "A" + text[1:]
