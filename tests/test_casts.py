import math

import pytest
from pyspark.sql import functions as F

from weirline.functions import field, parse_date, strict_cast

NUMBERS = [
    (" 12 ", 12, 12.0),
    ("+7", 7, 7.0),
    ("12.5", None, 12.5),
    ("1e2", None, 100.0),
    ("0x1", None, None),
    ("1_000", None, None),
    ("99999999999", None, 99999999999.0),
    ("Infinity", None, math.inf),
    ("abc", None, None),
    ("", None, None),
    (None, None, None),
]


def test_numbers(spark, either_ansi):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "i int, t string")
    got = df.select("i", strict_cast(F.col("t"), "int").alias("n"), strict_cast(F.col("t"), "double").alias("d"))
    assert [(r.n, r.d) for r in got.orderBy("i").collect()] == [(n, d) for _, n, d in NUMBERS]


def test_nan_is_a_double_and_not_an_int(spark, either_ansi):
    row = spark.range(1).select(
        strict_cast(F.lit("NaN"), "double").alias("d"), strict_cast(F.lit("NaN"), "int").alias("n")
    ).first()
    assert math.isnan(row.d) and row.n is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2023-01-15", "2023-01-15"),
        ("2024-02-29", "2024-02-29"),
        ("2023-02-30", None),
        ("2023-1-5", None),
        ("2023-01-15 00:00:00", None),
        ("bad", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, either_ansi, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_date(F.col("t")).cast("string")).first()[0] == expected


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Pacific/Apia", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2018-11-04",), ("2011-12-29",)], "t string")
        assert [str(r[0]) for r in df.select(parse_date(F.col("t"))).collect()] == ["2018-11-04", "2011-12-29"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_field_takes_names_literally(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert tuple(df.select(field("a.b"), field("c`d")).first()) == (1, 2)
