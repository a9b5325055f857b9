import shutil

import pytest
from lake import CLEAN, HEADER, PARTITIONS, drop
from pyspark.sql import Observation

from weirline.catalog import (
    KindLedger,
    PartitionLedger,
    add_partitions,
    deleted_partitions,
    discover,
    infer_known,
    register_discovered,
    register_raw_table,
)
from weirline.sources import infer_columns, list_files


def found(spark, tmp_path):
    return discover(spark, str(tmp_path / "raw"), str(tmp_path / "state"))


def types(schema):
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def test_types_of_known_files_are_merged_not_read(spark, tmp_path):
    root = tmp_path / "raw"
    state = str(tmp_path / "state")
    drop(root, "a.csv", ["1,2020-01-01,", "2,2020-01-02,"], "a,b,c")
    drop(root, "none.csv", [], "a,b,c")
    first, second, third = Observation(), Observation(), Observation()
    assert types(infer_known(spark, found(spark, tmp_path), state, read=first)) == {
        "a": "int", "b": "date", "c": "string", "year": "string", "month": "string",
    }
    drop(root, "b.csv", ["3000000000,x,1.5", "4,2020-01-01,7", "short"], "a,c,d", "year=2026/month=05")
    d = found(spark, tmp_path)
    got = infer_known(spark, d, state, read=second)
    assert types(got) == types(infer_columns(spark, d)) and types(got)["a"] == "bigint" and types(got)["c"] == "string"
    assert (first.get["rows"], second.get["rows"]) == (2, 3)
    ledger = KindLedger(spark, f"{state}/kinds")
    assert ledger.refresh(d, PARTITIONS, third) == 0


def test_types_of_files_that_are_gone_or_changed(spark, tmp_path):
    root, state = tmp_path / "raw", str(tmp_path / "state")
    drop(root, "a.csv", ["1"], "a")
    gone = drop(root, "b.csv", ["x"], "a")
    assert types(infer_known(spark, found(spark, tmp_path), state))["a"] == "string"
    gone.unlink()
    assert types(infer_known(spark, found(spark, tmp_path), state))["a"] == "int"
    drop(root, "a.csv", ["1.25"], "a")
    assert types(infer_known(spark, found(spark, tmp_path), state))["a"] == "double"


@pytest.fixture
def table(spark, tmp_path, database):
    name = f"{database}.customers"
    drop(tmp_path / "raw", "a.csv", CLEAN[:2])
    register_raw_table(spark, name, str(tmp_path / "raw"), HEADER.split(","), PARTITIONS)
    return name


def registered(spark, table):
    return sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


def test_partitions_are_added_by_name(spark, tmp_path, table):
    names = [f"year=2026/month={m:02d}" for m in range(1, 13)] + ["year=20%2526/month=a'b"]
    add_partitions(spark, table, str(tmp_path / "raw"), names * 40)
    assert len(registered(spark, table)) == 13
    assert spark.table(table).where("year = '2026' AND month = '04'").count() == 2
    assert spark.table(table).where("year = '20%26'").count() == 0


def test_ledger_registers_what_is_new_and_reports_what_is_gone(spark, tmp_path, table, monkeypatch):
    root, path = tmp_path / "raw", str(tmp_path / "ledger")

    def ledger():
        return PartitionLedger(spark, path, table, str(root))

    listed = list_files(spark, str(root))
    assert ledger().register(listed) == 1 and ledger().register(listed) == 0
    drop(root, "b.csv", CLEAN[2:], partition="year=2026/month=05")
    said = []
    run = spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (said.append(text), run(text, *a, **k))[1])
    assert ledger().register(list_files(spark, str(root))) == 1
    monkeypatch.undo()
    # Neither the tree nor the catalog's partitions are listed.
    assert not any("REPAIR" in text or "SHOW PARTITIONS" in text for text in said) and any("ADD IF NOT EXISTS" in t for t in said)
    assert spark.table(table).where("month = '05'").count() == 6
    shutil.rmtree(root / "year=2026" / "month=04")
    gone = ledger().gone(list_files(spark, str(root)))
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "Command" not in plan and [r.partition for r in gone.collect()] == ["year=2026/month=04"]
    assert [r.partition for r in deleted_partitions(spark, table, list_files(spark, str(root))).collect()] == ["year=2026/month=04"]


def test_ledger_starts_over_with_a_new_table_and_when_lost(spark, tmp_path, table):
    root, path = tmp_path / "raw", tmp_path / "ledger"
    listed = list_files(spark, str(root))
    assert PartitionLedger(spark, str(path), table, str(root)).register(listed) == 1
    spark.sql(f"DROP TABLE {table}")
    register_raw_table(spark, table, str(root), HEADER.split(","), PARTITIONS)
    assert registered(spark, table) == []
    assert PartitionLedger(spark, str(path), table, str(root)).register(listed) == 1
    assert registered(spark, table) == ["year=2026/month=04"]
    shutil.rmtree(path)
    assert PartitionLedger(spark, str(path), table, str(root)).register(listed) == 0


def test_a_second_crawl_lists_and_reads_only_what_is_new(spark, tmp_path, database):
    root, name = tmp_path / "raw", f"{database}.crawled"
    drop(root, "a.csv", CLEAN[:3])
    first, second = Observation(), Observation()
    register_discovered(spark, found(spark, tmp_path), name, first)
    drop(root, "b.csv", CLEAN[3:], partition="year=2026/month=05")
    rows = register_discovered(spark, found(spark, tmp_path), name, second)
    assert (first.get["rows"], second.get["rows"]) == (3, 5)
    assert {r["name"]: r["type"] for r in rows.collect()}["customer_id"] == "int"
    assert spark.table(name).count() == 8
