from dataclasses import replace

import pytest
from lake import CLEAN, PARTITIONS, drop

from weirline.catalog import create_database, register_raw_table
from weirline.config import JobConfig, LakeNames
from weirline.plans import run_arrivals
from weirline.sinks import BATCH_COLUMN, BatchMerges, append_to_table, replace_batch_in_table


def batches(spark, table, rows, location, keys=("region",), first=0):
    """One batch for each row."""
    for n, row in enumerate(rows, first):
        df = spark.createDataFrame([(*row, n)], f"id int, region string, {BATCH_COLUMN} bigint")
        replace_batch_in_table(df, table, location, keys)


def content(spark, table):
    return sorted(map(str, spark.table(table).drop(BATCH_COLUMN).collect()))


def shown(spark, table):
    return sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


ODD = ["a b", "c/d=é'", None]
ROWS = [(i, ODD[i % 3]) for i in range(9)]


@pytest.fixture
def table(spark, tmp_path, database):
    name = f"{database}.t"
    batches(spark, name, ROWS, str(tmp_path / "t"))
    return name


def test_each_value_gets_one_partition(spark, tmp_path, table):
    before = content(spark, table)
    merges = BatchMerges(spark, table, str(tmp_path / "m"))
    assert merges.run(3) == 6
    assert content(spark, table) == before
    assert sorted(p.rsplit("=", 1)[1] for p in shown(spark, table)) == ["6", "7", "8"]
    assert merges.run(3) == 0 and content(spark, table) == before
    assert len(spark.table(table).inputFiles()) == 3


def test_levels_are_merged_once_each(spark, tmp_path, database):
    table = f"{database}.levels"
    for at in range(0, 10, 2):
        batches(spark, table, [(i, "r") for i in range(at, at + 2)], str(tmp_path / "t"), first=at)
        BatchMerges(spark, table, str(tmp_path / "m")).run(2)
        assert [r.id for r in spark.table(table).orderBy("id").collect()] == list(range(at + 2))
        assert len(shown(spark, table)) < 4
    levels = {r.level for r in spark.read.parquet(str(tmp_path / "m" / "plans")).collect()}
    assert levels >= {1, 2, 3}


def test_old_folders_stay_for_readers_until_the_next_call(spark, tmp_path, table):
    reader = spark.table(table)
    reader.inputFiles()
    merges = BatchMerges(spark, table, str(tmp_path / "m"))
    old = list((tmp_path / "t").glob(f"region=*/{BATCH_COLUMN}=*"))
    merges.run(3)
    assert len(old) == 9 and all(p.is_dir() for p in old)
    merges.run(3)
    assert not any(p.exists() for p in old)
    assert len(content(spark, table)) == 9


@pytest.mark.parametrize("after", ["write", "plan", "location"])
def test_a_merge_that_stopped_is_finished_or_has_done_nothing(spark, tmp_path, table, monkeypatch, after):
    before = content(spark, table)

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    merges = BatchMerges(spark, table, str(tmp_path / "m"))
    if after == "write":
        real = merges._write
        monkeypatch.setattr(merges, "_write", lambda *a: (real(*a), stop()))
    elif after == "plan":
        monkeypatch.setattr(merges, "_apply", lambda plan: plan and stop())
    else:
        real_sql = spark.sql
        monkeypatch.setattr(
            type(spark), "sql", lambda self, text, *a, **k: stop() if " DROP IF EXISTS " in text else real_sql(text, *a, **k)
        )
    with pytest.raises(Stopped):
        merges.run(3)
    monkeypatch.undo()
    if after != "location":
        assert content(spark, table) == before
    BatchMerges(spark, table, str(tmp_path / "m")).run(3)
    assert content(spark, table) == before and len(shown(spark, table)) == 3


def test_without_other_partition_columns(spark, tmp_path, database):
    table = f"{database}.plain"
    batches(spark, table, ROWS, str(tmp_path / "t"), keys=())
    before = content(spark, table)
    assert BatchMerges(spark, table, str(tmp_path / "m")).run(4) == 8
    assert content(spark, table) == before and shown(spark, table) == [f"{BATCH_COLUMN}=8"]


def test_columns_added_later_stay(spark, tmp_path, table):
    wide = spark.createDataFrame([(100, "a b", "x", 50)], f"id int, region string, more string, {BATCH_COLUMN} bigint")
    replace_batch_in_table(wide, table, str(tmp_path / "t"), ("region",))
    BatchMerges(spark, table, str(tmp_path / "m")).run(2)
    assert spark.table(table).where("more = 'x'").count() == 1 and spark.table(table).count() == 10


def test_other_tables_are_refused(spark, tmp_path, database):
    df = spark.createDataFrame([(1, "r", 0)], f"id int, region string, {BATCH_COLUMN} bigint")
    append_to_table(df, f"{database}.flat", str(tmp_path / "flat"), ("region",))
    with pytest.raises(ValueError, match="no batches"):
        BatchMerges(spark, f"{database}.flat", str(tmp_path / "m"))
    replace_batch_in_table(df, f"{database}.managed", None, ("region",))
    with pytest.raises(ValueError, match="external"):
        BatchMerges(spark, f"{database}.managed", str(tmp_path / "m"))


def test_the_job_merges_what_it_finished(spark, tmp_path):
    names = LakeNames("m_" + tmp_path.name.replace("-", "_"), str(tmp_path))
    config = JobConfig.for_lake(names, "customers", max_files=1, merge_batches=3)
    create_database(spark, config.source_database, f"{tmp_path}/database")
    register_raw_table(spark, config.source, names.raw("customers"), config.rules.raw_columns, PARTITIONS)
    for i, line in enumerate(CLEAN):
        drop(tmp_path / "raw" / "customers", f"f{i}.csv", [line])
    assert run_arrivals(spark, config).counts.batches == 8
    assert spark.table(config.target).count() == 8
    us_east = [p for p in shown(spark, config.target) if "us-east-1" in p]
    assert len(us_east) == 1
    drop(tmp_path / "raw" / "customers", "late.csv", [CLEAN[0].replace("101", "201")])
    run_arrivals(spark, config)
    assert sorted(r.customer_id for r in spark.table(config.target).collect()) == [*range(101, 109), 201]


def test_the_job_refuses_a_merge_it_cannot_do():
    config = JobConfig.for_lake(LakeNames("x", "/x"))
    for change in ({"merge_batches": 1}, {"merge_batches": 3, "bookmark": False}):
        with pytest.raises(ValueError, match="merge_batches"):
            replace(config, **change)
