from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tableinsight.functions.parsing import stripped, to_date_time, to_number
from tableinsight.operators.clean import clean


def _column(spark, values, name="v"):
    # A key column keeps equal values from being taken for duplicate rows.
    rows = [(f"k{i:03}", v) for i, v in enumerate(values)]
    cleaned = clean(spark.createDataFrame(rows, f"key string, `{name}` string"))
    values = [r[1] for r in cleaned.frame.orderBy("key").collect()]
    return dict(cleaned.frame.dtypes)[name], values, cleaned


@pytest.mark.parametrize(
    "values, kind, expected",
    [
        (["7", "41", "-6"], "bigint", [7, 41, -6]),
        (["10", None, "30"], "double", [10.0, None, 30.0]),
        (["10", "2.5", "-3e2"], "double", [10.0, 2.5, -300.0]),
        (["3,125", "-0,5", "901,75"], "double", [3.125, -0.5, 901.75]),
        (["007", "41", "0090"], "string", ["007", "41", "0090"]),
        (["1d", "2f", "NaN"], "string", ["1d", "2f", "NaN"]),
        (["1", "2", "x"], "string", ["1", "2", "x"]),
        (["1"] * 19 + ["x"], "double", [1.0] * 19 + [None]),
        (["1,5", "a,b", "c"], "string", ["1,5", "a,b", "c"]),
        (["  Alice  ", "", "Bob", " "], "string", ["Alice", None, "Bob", None]),
    ],
)
def test_conversions(spark, values, kind, expected):
    assert _column(spark, values)[:2] == (kind, expected)


def test_decimal_column_with_gaps_still_converts(spark):
    kind, values, cleaned = _column(spark, ["1,5", None, None, "2,5"])
    assert (kind, values) == ("double", [1.5, None, None, 2.5])
    report = cleaned.report.first()
    assert report.columns_converted_decimal == ["v"] and report.missing_values == {"v": 2}


def test_iso_dates_are_not_swapped(spark):
    kind, values, cleaned = _column(spark, ["2023-03-04", "2023-11-02", "2023-12-10"], "date_arrivee")
    assert kind == "timestamp"
    assert values == [datetime(2023, 3, 4), datetime(2023, 11, 2), datetime(2023, 12, 10)]
    assert cleaned.report.first().columns_converted_date == ["date_arrivee"]


def test_dates_need_a_date_like_name(spark):
    assert _column(spark, ["2024-01-05", "2024-02-09"], "other")[0] == "string"


# Texts and their reading, day before month where both are possible.
DATES = {
    "05/01/2024": datetime(2024, 1, 5),
    "01/25/2024": datetime(2024, 1, 25),
    "25.12.2023": datetime(2023, 12, 25),
    "12-25-2023": datetime(2023, 12, 25),
    "5/1/2024 10:30": datetime(2024, 1, 5, 10, 30),
    "05/01/24": datetime(2024, 1, 5),
    "2024/01/05": datetime(2024, 1, 5),
    "2024-1-5": datetime(2024, 1, 5),
    "20240105": datetime(2024, 1, 5),
    "2024-01": datetime(2024, 1, 1),
    "2024-01-05T10:20:30Z": datetime(2024, 1, 5, 10, 20, 30),
    "05/01/2024 02:30 PM": datetime(2024, 1, 5, 14, 30),
    "1/25/2024 9:05:07 am": datetime(2024, 1, 25, 9, 5, 7),
    "05/01/2024 10:30:15.123": datetime(2024, 1, 5, 10, 30, 15, 123000),
    "05/01/2024 10:30:15.123456": datetime(2024, 1, 5, 10, 30, 15, 123456),
    "5 Jan 2024": datetime(2024, 1, 5),
    "January 5, 2024": datetime(2024, 1, 5),
    "5 janvier 2024": None,
    "31/02/2024": None,
    "soon": None,
}


def test_date_formats(spark):
    df = spark.createDataFrame([(d,) for d in DATES], ["t"])
    parsed = {r.t: r.d for r in df.select("t", to_date_time(F.col("t")).alias("d")).collect()}
    assert parsed == DATES


def test_numbers_and_strip(spark):
    texts = ["+5", "5.", ".5", "1e3", "inf", "1_000", "0x10", "1d", "1,5", "--1"]
    df = spark.createDataFrame([(t,) for t in texts], ["t"])
    numbers = [r[0] for r in df.select(to_number(F.col("t"))).collect()]
    assert numbers == [5.0, 5.0, 0.5, 1000.0, float("inf"), None, None, None, None, None]
    spaced = spark.createDataFrame([("\t a b　\x1f",)], ["t"])
    assert spaced.select(stripped(F.col("t"))).first()[0] == "a b"


def test_empty_rows_columns_duplicates_and_headers(spark):
    df = spark.createDataFrame(
        [("8", "u", None), ("9", "v", None), ("8", "u", None), (None, None, None), ("8", "u", None)],
        "` a ` string, b string, unused string",
    )
    cleaned = clean(df)
    report = cleaned.report.first()
    assert cleaned.frame.columns == ["a", "b"]
    assert sorted(tuple(r) for r in cleaned.frame.collect()) == [(8, "u"), (9, "v")]
    assert (report.original_rows, report.original_cols) == (5, 3)
    assert (report.final_rows, report.final_cols) == (2, 2)
    assert (report.empty_rows_removed, report.duplicates_removed) == (1, 2)
    assert report.missing_values == {}


def test_blank_rows_are_not_empty_rows(spark):
    cleaned = clean(spark.createDataFrame([("a", "b"), (" ", " ")], "x string, y string"))
    report = cleaned.report.first()
    assert (report.empty_rows_removed, report.final_rows) == (0, 2)
    assert report.missing_values == {"x": 1, "y": 1}


def test_typed_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    assert dict(clean(df).frame.dtypes) == {"n": "int", "t": "string"}
