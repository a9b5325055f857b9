import math
from datetime import date

import pytest
from lake import CLEAN, PARTITIONS, drop
from pyspark.sql import Observation

from weirline.catalog import create_database, register_partitions, register_raw_table
from weirline.config import CurateRules, JobConfig, LakeNames
from weirline.operators import counts_from_footers, grouped_count
from weirline.plans import curate, run_arrivals, run_batch
from weirline.sinks import append_parquet, append_to_table
from weirline.streaming import DiscoveryFailed
from weirline.sources import scan_parquet, scan_raw_csv

RULES = CurateRules()
REGION_COUNTS = {"us-east-1": 4, "us-west-2": 2, "eu-west-1": 1, "ap-southeast-1": 1}


def raw(spark, root):
    return scan_raw_csv(spark, str(root), RULES.raw_columns, PARTITIONS)


def counts(df):
    return {r.region: r.cnt for r in grouped_count(df, "region").collect()}


def test_raw_scan_is_text_only(spark, tmp_path):
    drop(tmp_path, "a.csv", CLEAN)
    df = raw(spark, tmp_path)
    assert {t for _, t in df.dtypes} == {"string"}
    assert df.select("year", "month").distinct().collect() == [("2026", "04")]


def test_clean_rows(spark, tmp_path, either_ansi):
    drop(tmp_path / "raw", "a.csv", CLEAN)
    append_parquet(curate(raw(spark, tmp_path / "raw"), RULES), str(tmp_path / "curated"), ["region"])
    df = scan_parquet(spark, str(tmp_path / "curated"))
    assert df.dtypes == [
        ("customer_id", "int"),
        ("first_name", "string"),
        ("last_name", "string"),
        ("email", "string"),
        ("ssn", "string"),
        ("signup_date", "date"),
        ("annual_spend", "double"),
        ("ingested_at", "timestamp"),
        ("region", "string"),
    ]
    assert df.count() == 8 and counts(df) == REGION_COUNTS
    assert df.where("ingested_at is null").count() == 0
    assert df.selectExpr("min(signup_date)", "max(signup_date)").first() == (date(2021, 3, 4), date(2021, 10, 11))


DIRTY = {
    "empty email": ("1,A,B,,s,r1,2023-01-01,1.0", None),
    "empty id": (",A,B,e,s,r1,2023-01-01,1.0", None),
    "letters in id": ("x,A,B,e,s,r1,2023-01-01,1.0", None),
    "fractional id": ("12.5,A,B,e,s,r1,2023-01-01,1.0", None),
    "large id": ("99999999999,A,B,e,s,r1,2023-01-01,1.0", None),
    "padded id": (" 12 ,A,B,e,s,r1,2023-01-01,1.0", (12, date(2023, 1, 1), 1.0, "r1")),
    "impossible date": ("2,A,B,e,s,r1,2023-02-30,1.0", (2, None, 1.0, "r1")),
    "short date": ("3,A,B,e,s,r1,2023-1-5,1.0", (3, None, 1.0, "r1")),
    "date with time": ("4,A,B,e,s,r1,2023-01-15 00:00:00,1.0", (4, None, 1.0, "r1")),
    "bad spend": ("5,A,B,e,s,r1,2023-01-01,abc", (5, date(2023, 1, 1), None, "r1")),
    "empty region": ("6,A,B,e,s,,2023-01-01,1.0", (6, date(2023, 1, 1), 1.0, None)),
    "short line": ("7,A,B,e", (7, None, None, None)),
    "quoted": ('8,"A, jr","B ""x""",e,s,r1,2023-01-01,1.0', (8, date(2023, 1, 1), 1.0, "r1")),
}


@pytest.mark.parametrize("case", DIRTY)
def test_dirty_rows(spark, tmp_path, either_ansi, case):
    line, expected = DIRTY[case]
    drop(tmp_path, "a.csv", [line])
    got = [
        (r.customer_id, r.signup_date, r.annual_spend, r.region) for r in curate(raw(spark, tmp_path), RULES).collect()
    ]
    assert got == ([] if expected is None else [expected])


def test_nan_spend_is_kept(spark, tmp_path, either_ansi):
    drop(tmp_path, "a.csv", ["1,A,B,e,s,r1,2023-01-01,NaN"])
    assert math.isnan(curate(raw(spark, tmp_path), RULES).first().annual_spend)


def test_missing_region_has_its_own_partition(spark, tmp_path):
    drop(tmp_path / "raw", "a.csv", [*CLEAN, "9,A,B,e,s,,2023-01-01,1.0"])
    append_parquet(curate(raw(spark, tmp_path / "raw"), RULES), str(tmp_path / "c"), ["region"])
    assert (tmp_path / "c" / "region=__HIVE_DEFAULT_PARTITION__").is_dir()
    df = scan_parquet(spark, str(tmp_path / "c"))
    assert counts(df) == {**REGION_COUNTS, None: 1}
    assert df.where("region = 'us-east-1'").count() == 4


def test_append_keeps_what_is_there(spark, tmp_path):
    drop(tmp_path / "raw", "a.csv", CLEAN)
    for _ in range(2):
        append_parquet(curate(raw(spark, tmp_path / "raw"), RULES), str(tmp_path / "c"), ["region"])
    assert scan_parquet(spark, str(tmp_path / "c")).count() == 16


def test_files_are_snappy(spark, tmp_path):
    drop(tmp_path / "raw", "a.csv", CLEAN)
    append_parquet(curate(raw(spark, tmp_path / "raw"), RULES), str(tmp_path / "c"), ["region"])
    names = [p.name for p in (tmp_path / "c").rglob("*.parquet")]
    assert names and all(n.endswith(".snappy.parquet") for n in names)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("rebalance", [True, False])
def test_every_way_of_writing_keeps_all_rows(spark, tmp_path, adaptive, rebalance):
    rows = spark.range(5000, numPartitions=12).selectExpr(
        "cast(id as string) as id", "if(id < 2000, 'hot', concat('r', id % 7)) as region"
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        append_parquet(rows, str(tmp_path / "c"), ["region"], rebalance)
        got = scan_parquet(spark, str(tmp_path / "c"))
        assert got.columns == ["id", "region"]
        assert sorted(got.collect()) == sorted(rows.collect())
        hot_files = len(list((tmp_path / "c" / "region=hot").glob("*.parquet")))
        assert hot_files > 1 or (adaptive == "true" and rebalance)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_adaptive_execution_splits_a_hot_value(spark, tmp_path):
    rows = spark.range(300000, numPartitions=12).selectExpr(
        "sha2(cast(id as string), 256) as text", "if(id % 3 = 0, 'hot', concat('r', id % 50)) as region"
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        written = Observation()
        append_parquet(rows, str(tmp_path / "c"), ["region"], written=written)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "c" / "region=hot").glob("*.parquet"))) > 3
    assert scan_parquet(spark, str(tmp_path / "c")).count() == written.get["rows"] == 300000


def test_table_gains_columns_and_keeps_types(spark, tmp_path, database):
    table = f"{database}.t"
    append_to_table(spark.createDataFrame([(1, "a")], "id int, region string"), table, str(tmp_path / "t"), ["region"])
    append_to_table(
        spark.createDataFrame([("b", 2.5, 2)], "region string, loyalty double, id int"), table, keys=["region"]
    )
    append_to_table(spark.createDataFrame([(3,)], "id int"), table, keys=["region"])
    df = spark.table(table)
    assert df.columns == ["id", "loyalty", "region"]
    assert sorted(df.collect(), key=lambda r: r.id) == [(1, None, "a"), (2, 2.5, "b"), (3, None, None)]
    assert spark.sql(f"SHOW PARTITIONS {table}").count() == 3


def lake(spark, tmp_path, database, **overrides):
    names = LakeNames(database, str(tmp_path / "lake"))
    create_database(spark, names.database, str(tmp_path / "lake-database"))
    config = JobConfig.for_lake(names, **overrides)
    register_raw_table(spark, config.source, names.raw("customers"), RULES.raw_columns, PARTITIONS)
    return config, tmp_path / "lake" / "raw" / "customers"


def test_batch_job(spark, tmp_path, database):
    config, root = lake(
        spark, tmp_path, database, bookmark=False, cleaned_path=str(tmp_path / "lake" / "cleaned"), rebalance=False
    )
    drop(root, "a.csv", [*CLEAN, "x,A,B,e,s,r,2023-01-01,1"])
    register_partitions(spark, config.source)
    report = run_batch(spark, config)
    assert (report.raw_rows, report.clean_rows) == (9, 8)
    assert counts(spark.table(config.target)) == REGION_COUNTS
    assert {r.partition for r in spark.sql(f"SHOW PARTITIONS {config.target}").collect()} == {
        f"region={r}" for r in REGION_COUNTS
    }
    cleaned = scan_parquet(spark, config.cleaned_path, "customer_id int, year string, month string")
    assert cleaned.where("year = '2026' and month = '04'").count() == 8


def test_batch_job_fails_on_a_reordered_file(spark, tmp_path, database):
    config, root = lake(spark, tmp_path, database, bookmark=False)
    drop(root, "a.csv", ["A,1,B,e,s,r,2023-01-01,1"], "first_name,customer_id,last_name,email,ssn,region,signup_date,annual_spend")
    with pytest.raises(DiscoveryFailed, match="header"):
        run_batch(spark, config)
    assert not spark.catalog.tableExists(config.target)


def test_batch_job_without_files(spark, tmp_path, database):
    config, root = lake(spark, tmp_path, database, bookmark=False)
    root.mkdir(parents=True)
    report = run_batch(spark, config)
    assert (report.raw_rows, report.clean_rows) == (0, 0) and spark.table(config.target).count() == 0


def test_batch_and_incremental_jobs_are_kept_apart(spark, tmp_path, database):
    config, _ = lake(spark, tmp_path, database)
    with pytest.raises(ValueError):
        run_batch(spark, config)
    with pytest.raises(ValueError):
        run_arrivals(spark, JobConfig.for_lake(LakeNames("p", "/lake"), bookmark=False))


def test_partition_pruning_and_column_pruning(spark, tmp_path):
    drop(tmp_path / "raw", "a.csv", CLEAN)
    append_parquet(curate(raw(spark, tmp_path / "raw"), RULES), str(tmp_path / "c"), ["region"])
    df = scan_parquet(spark, str(tmp_path / "c"))
    plan = df.where("region = 'us-east-1' and customer_id = 101").select("email")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(region" in text and "EqualTo(customer_id,101)" in text
    assert "ReadSchema: struct<customer_id:int,email:string>" in text
    counted = grouped_count(df, "region")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in counted


def test_null_checks_reach_the_raw_scan(spark, tmp_path):
    drop(tmp_path, "a.csv", CLEAN)
    plan = curate(raw(spark, tmp_path), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(email)" in plan
    assert "year" not in plan.split("ReadSchema")[1]


def test_counts_from_footers_read_no_rows(spark, tmp_path):
    drop(tmp_path / "raw", "a.csv", [*CLEAN, "109,A,B,e@x,s,,2023-01-01,1"])
    append_parquet(curate(raw(spark, tmp_path / "raw"), RULES), str(tmp_path / "out"), ["region"])
    counted = counts_from_footers(spark, str(tmp_path / "out"), "region")
    assert {r.region: r.cnt for r in counted.collect()} == {**REGION_COUNTS, None: 1}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(" in plan and "PushedGroupBy: [region]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
