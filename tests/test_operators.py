import math
from datetime import date

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weirline.operators import (
    append_column,
    apply_mapping,
    drop_missing,
    filter_rows,
    first_rows,
    grouped_count,
    keys_present,
    make_columns,
    observe_rows,
    observed_types,
    replace_column,
    resolve_choice,
    row_counts,
    select_all,
)


def test_mapping_selects_casts_renames_and_drops(spark, either_ansi):
    df = spark.createDataFrame([("1", "2.5", "x", "gone"), ("q", "r", None, "gone")], "a string, b string, c string, d string")
    got = apply_mapping(df, [("c", "string", "see", "string"), ("a", "string", "a", "int"), ("b", "string", "bee", "double")])
    assert got.dtypes == [("see", "string"), ("a", "int"), ("bee", "double")]
    assert [tuple(r) for r in got.collect()] == [("x", 1, 2.5), (None, None, None)]


def test_mapping_goes_through_the_declared_type(spark, either_ansi):
    df = spark.createDataFrame([(7, 2.5, date(2023, 1, 5))], "a bigint, b double, c date")
    got = apply_mapping(df, [(c, "string", c, t) for c, t in (("a", "int"), ("b", "double"), ("c", "string"))])
    assert tuple(got.first()) == (7, 2.5, "2023-01-05")


def test_mapping_is_one_projection(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    plan = apply_mapping(df, [("b", "string", "b", "int")])._jdf.queryExecution().analyzed().toString()
    assert plan.count("Project") == 1


@pytest.mark.parametrize(
    "mappings",
    [[], [("nope", "string", "n", "int")], [("a", "string", "x", "int"), ("b", "string", "x", "int")]],
)
def test_mapping_refuses(spark, mappings):
    with pytest.raises(ValueError):
        apply_mapping(spark.createDataFrame([("1", "2")], "a string, b string"), mappings)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert replace_column(df, "a", F.col("b") * 10).columns == ["a", "b"]
    assert replace_column(df, "a", F.col("b") * 10).first().a == 20
    assert append_column(df, "c", F.lit(3)).columns == ["a", "b", "c"]
    assert select_all(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        replace_column(df, "c", F.lit(1))
    with pytest.raises(ValueError):
        append_column(df, "a", F.lit(1))


def test_drop_missing_agrees_with_dropna(spark):
    rows = [(1, "a", 1.0), (None, "a", 1.0), (2, None, 1.0), (3, "c", math.nan), (4, "", 2.0), (5, "e", None)]
    df = spark.createDataFrame(rows, "i int, s string, d double")
    for keys in (["i"], ["i", "s"], ["i", "s", "d"], ["d"]):
        mine = sorted(map(str, drop_missing(df, keys).collect()))
        assert mine == sorted(map(str, df.dropna(how="any", subset=keys).collect()))


def test_filter_drops_null(spark):
    df = spark.createDataFrame([("us-east-1",), ("eu-west-1",), (None,)], "region string")
    assert filter_rows(df, "region = 'us-east-1'").count() == 1


def test_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3)], "k string, v int")
    assert {(r.k, r.cnt) for r in grouped_count(df, "k").collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert tuple(row_counts(df, keys_present(df, ["k", "v"])).first()) == (4, 2)
    assert first_rows(df, 3).count() == 3 and first_rows(df).count() == 4


def test_counts_of_nothing(spark):
    df = spark.createDataFrame([], "k string")
    assert tuple(row_counts(df, keys_present(df, ["k"])).first()) == (0, 0)
    assert grouped_count(df, "k").count() == 0


def test_observed_counts_come_with_the_action(spark, tmp_path):
    before, after = Observation(), Observation()
    df = observe_rows(drop_missing(observe_rows(spark.createDataFrame([(1,), (None,)], "i int"), before), ["i"]), after)
    df.write.parquet(str(tmp_path / "out"))
    assert (before.get["rows"], after.get["rows"]) == (2, 1)


MIXED = ["1", "2.5", "x", None, " 3 ", "9999999999", "NaN", "2020-01-01", "true", "", "y", "1d", "2020-01-01 10:30"]


def test_make_columns_puts_each_value_in_one_column(spark, either_ansi):
    df = spark.createDataFrame(list(enumerate(MIXED)), "i int, v string")
    got = make_columns(df, {"v": ["string", "double", "date", "int", "boolean"]})
    assert got.columns == ["i", "v_boolean", "v_int", "v_double", "v_date", "v_string"]
    rows = got.orderBy("i").collect()
    filled = [sum(x is not None for x in list(r)[1:]) for r in rows]
    assert filled == [0 if v is None else 1 for v in MIXED]
    by_value = {v: r for v, r in zip(MIXED, rows)}
    assert by_value["1"].v_int == 1 and by_value[" 3 "].v_int == 3
    assert by_value["2.5"].v_double == 2.5 and by_value["9999999999"].v_double == 9999999999.0
    assert math.isnan(by_value["NaN"].v_double)
    assert by_value["2020-01-01"].v_date == date(2020, 1, 1)
    assert by_value["true"].v_boolean is True
    for text in ("x", "", "y", "1d", "2020-01-01 10:30"):
        assert by_value[text].v_string == text


def test_make_columns_always_keeps_the_rest_as_text(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert make_columns(df, {"v": ["int"]}).columns == ["v_int", "v_string"]


def test_make_columns_of_variants(spark, either_ansi):
    texts = ["1", "1.5", '"a"', "true", "null", '{"k": 1}', "[1, 2]", "9999999999", '"7"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    rows = make_columns(df, {"v": ["boolean", "int", "double", "string"]}).orderBy("i").collect()
    values = [tuple(r)[1:] for r in rows]
    assert values[:5] == [
        (None, 1, None, None),
        (None, None, 1.5, None),
        (None, None, None, "a"),
        (True, None, None, None),
        (None, None, None, None),
    ]
    assert values[5][3] == '{"k":1}' and values[6][3] == "[1,2]"
    assert values[7] == (None, None, 9999999999.0, None)
    assert values[8] == (None, None, None, "7")


def test_resolve_leaves_columns_of_one_type(spark):
    df = spark.createDataFrame([("1", "1", "a"), ("2", "b", "c"), (None, None, None)], "n string, m string, s string")
    assert observed_types(df, ["n", "m", "s"]) == {"n": ["int"], "m": ["int", "string"], "s": ["string"]}
    got = resolve_choice(df, ["n", "m", "s"])
    assert got.columns == ["n", "m_int", "m_string", "s"]
    assert resolve_choice(df).columns == df.columns


def test_make_columns_refuses(spark):
    df = spark.createDataFrame([("1", 1, "x")], "v string, n int, v_int string")
    for choices in ({"n": ["int"]}, {"absent": ["int"]}, {"v": ["int"]}, {"v": ["decimal"]}):
        with pytest.raises(ValueError):
            make_columns(df, choices)
