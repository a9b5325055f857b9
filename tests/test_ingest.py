import os
from datetime import datetime
from dataclasses import replace

import pytest
from lake import CLEAN, HEADER, PARTITIONS, drop

from weirline.catalog import create_database, register_raw_table
from weirline.config import CurateRules, JobConfig, LakeNames
from weirline.operators import grouped_count, observe_rows
from weirline.plans import curate, run_arrivals
from weirline.sources import scan_parquet
from weirline.streaming import RAW_ROWS, AcceptedFiles, DiscoveryFailed, ingest_into, raw_stream

RULES = CurateRules()


class Ingest:
    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.raw = tmp_path / "raw"
        self.raw.mkdir()
        self.out = str(tmp_path / "curated")
        self.checkpoint = str(tmp_path / "checkpoint")

    def run(self, **options):
        stream = raw_stream(self.spark, str(self.raw), RULES.raw_columns, PARTITIONS, **options)
        return ingest_into(curate(observe_rows(stream, RAW_ROWS), RULES), self.checkpoint, self.out, ["region"])

    def rows(self):
        return scan_parquet(self.spark, self.out)


@pytest.fixture
def ingest(spark, tmp_path):
    return Ingest(spark, tmp_path)


def test_each_file_is_taken_once(ingest):
    first = drop(ingest.raw, "a.csv", CLEAN[:2])
    assert ingest.run().raw_rows == 2
    assert ingest.run().raw_rows == 0
    drop(ingest.raw, "b.csv", CLEAN[2:3], partition="year=2026/month=05")
    assert ingest.run().raw_rows == 1
    assert ingest.rows().count() == 3
    drop(ingest.raw, first.name, CLEAN[:2] + CLEAN[4:])
    assert ingest.run().raw_rows == 0
    assert ingest.rows().count() == 3


def test_counts_before_and_after_cleaning(ingest):
    drop(ingest.raw, "a.csv", [*CLEAN, "x,A,B,e,s,r,2023-01-01,1"])
    counts = ingest.run()
    assert (counts.raw_rows, counts.clean_rows) == (9, 8)


def test_late_file_with_an_old_time_is_taken(ingest):
    drop(ingest.raw, "a.csv", CLEAN[:2])
    ingest.run()
    late = drop(ingest.raw, "late.csv", CLEAN[2:3])
    os.utime(late, (1_500_000_000, 1_500_000_000))
    assert ingest.run().raw_rows == 1


def test_backlog_in_several_commits(ingest):
    for i, line in enumerate(CLEAN):
        drop(ingest.raw, f"f{i}.csv", [line])
    counts = ingest.run(max_files=3)
    assert (counts.raw_rows, counts.batches) == (8, 3)
    assert ingest.rows().count() == 8


def test_backlog_in_commits_by_size(ingest):
    for i, line in enumerate(CLEAN):
        drop(ingest.raw, f"f{i}.csv", [line])
    counts = ingest.run(max_bytes=500)
    assert counts.raw_rows == 8 and counts.batches > 1
    assert ingest.rows().count() == 8


def test_other_files_are_left_alone(ingest):
    drop(ingest.raw, "a.csv", CLEAN[:1])
    drop(ingest.raw, "notes.txt", ["x"])
    drop(ingest.raw.parent / "elsewhere", "b.csv", CLEAN[1:])
    assert ingest.run(pattern="*.csv").raw_rows == 1


def test_more_batches_than_progress_entries(ingest, spark):
    for i, line in enumerate(CLEAN):
        drop(ingest.raw, f"f{i}.csv", [line])
    setting = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(setting, "2")
    try:
        counts = ingest.run(max_files=1)
        assert spark.conf.get(setting) == "2"
    finally:
        spark.conf.unset(setting)
    assert (counts.raw_rows, counts.clean_rows, counts.batches) == (8, 8, 8)


def test_reading_tasks_refuse_a_reordered_file(ingest):
    drop(ingest.raw, "a.csv", CLEAN[:1])
    ingest.run()
    reordered = HEADER.replace("customer_id,first_name", "first_name,customer_id")
    bad = drop(ingest.raw, "b.csv", ["A,1,B,e,s,r,2023-01-01,1"], reordered)
    with pytest.raises(Exception, match="header|FAILED|exception"):
        ingest.run()
    assert ingest.rows().count() == 1
    bad.write_text("\n".join([HEADER, CLEAN[1]]) + "\n")
    assert ingest.run().raw_rows == 1
    assert ingest.rows().count() == 2


def test_batch_repeated_after_a_lost_commit_is_not_seen_twice(ingest):
    drop(ingest.raw, "a.csv", CLEAN[:3])
    ingest.run()
    commits = os.path.join(ingest.checkpoint, "commits")
    for name in os.listdir(commits):
        os.unlink(os.path.join(commits, name))
    ingest.run()
    assert ingest.rows().count() == 3
    drop(ingest.raw, "b.csv", CLEAN[3:])
    ingest.run()
    assert ingest.rows().count() == 8


def test_without_adaptive_execution(ingest, spark):
    drop(ingest.raw, "a.csv", CLEAN)
    spark.conf.set("spark.sql.adaptive.streaming.stateless.enabled", "false")
    try:
        assert ingest.run().clean_rows == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.streaming.stateless.enabled")
    assert ingest.rows().count() == 8
    assert "__weirline_salt" not in ingest.rows().columns


class Lake:
    def __init__(self, spark, tmp_path, prefix, **overrides):
        names = LakeNames(prefix, str(tmp_path / "lake"))
        self.spark = spark
        self.config = JobConfig.for_lake(names, **overrides)
        self.raw = tmp_path / "lake" / "raw" / "customers"
        self.raw.mkdir(parents=True)
        create_database(spark, names.database, str(tmp_path / "lake-database"))
        register_raw_table(spark, self.config.source, names.raw("customers"), RULES.raw_columns, PARTITIONS)

    def run(self, **overrides):
        return run_arrivals(self.spark, replace(self.config, **overrides))

    def rows(self):
        return self.spark.table(self.config.target)


def test_arrivals(spark, tmp_path, database):
    lake = Lake(spark, tmp_path, database, cleaned_path=str(tmp_path / "lake" / "cleaned" / "customers"))
    drop(lake.raw, "a.csv", CLEAN[:5])
    report = lake.run()
    assert (report.counts.raw_rows, report.counts.clean_rows, report.cleaned.clean_rows) == (5, 5, 5)
    assert lake.run().counts.raw_rows == 0
    drop(lake.raw, "b.csv", CLEAN[5:], partition="year=2026/month=05")
    assert lake.run(max_files=1).counts.raw_rows == 3
    assert {r.region: r.cnt for r in grouped_count(lake.rows(), "region").collect()} == {
        "us-east-1": 4,
        "us-west-2": 2,
        "eu-west-1": 1,
        "ap-southeast-1": 1,
    }
    assert spark.table(lake.config.source).where("month = '05'").count() == 3
    cleaned = scan_parquet(spark, lake.config.cleaned_path, "customer_id int, year string, month string")
    assert {r.month: r.cnt for r in grouped_count(cleaned, "month").collect()} == {"04": 5, "05": 3}
    plan = lake.rows().where("region = 'us-east-1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan


def test_gate_blocks_the_write_until_the_file_is_gone(spark, tmp_path, database):
    lake = Lake(spark, tmp_path, database)
    drop(lake.raw, "a.csv", CLEAN[:2])
    lake.run()
    drop(lake.raw, "b.csv", CLEAN[2:3])
    alien = drop(lake.raw, "alien.csv", ["1,2"], "sku,price")
    for _ in range(2):
        with pytest.raises(DiscoveryFailed, match="alien.csv"):
            lake.run()
    assert lake.rows().count() == 2
    alien.unlink()
    assert lake.run().counts.raw_rows == 1


def test_added_column_when_allowed(spark, tmp_path, database):
    lake = Lake(spark, tmp_path, database)
    drop(lake.raw, "a.csv", CLEAN[:2])
    lake.run()
    drop(lake.raw, "b.csv", [f"{line},gold" for line in CLEAN[2:]], HEADER + ",loyalty", "year=2026/month=05")
    with pytest.raises(DiscoveryFailed):
        lake.run()
    report = lake.run(added_columns=True)
    assert report.new_columns == ["loyalty"] and report.counts.clean_rows == 6
    assert lake.rows().count() == 8 and "loyalty" not in lake.rows().columns
    assert "loyalty" in spark.table(lake.config.source).columns
    with pytest.raises(Exception, match="header"):
        spark.table(lake.config.source).collect()
    assert lake.run(added_columns=True).counts.raw_rows == 0


def test_file_after_discovery_waits_for_the_next_run(spark, tmp_path, database, monkeypatch):
    lake = Lake(spark, tmp_path, database)
    drop(lake.raw, "a.csv", CLEAN[:2])
    accept = AcceptedFiles.add

    def late(self, *args):
        accept(self, *args)
        drop(lake.raw, "late.csv", ["Z,9,B,e,s,r,2023-01-01,1"], HEADER.replace("customer_id,first_name", "first_name,customer_id"))

    monkeypatch.setattr(AcceptedFiles, "add", late)
    assert lake.run(added_columns=True).counts.raw_rows == 2
    monkeypatch.undo()
    with pytest.raises(DiscoveryFailed, match="late.csv"):
        lake.run(added_columns=True)
    assert lake.rows().count() == 2


def test_batch_repeated_after_a_crash_is_not_seen_twice(spark, tmp_path, database):
    lake = Lake(spark, tmp_path, database, cleaned_path=str(tmp_path / "lake" / "cleaned" / "customers"))
    drop(lake.raw, "a.csv", [*CLEAN, "x,A,B,e,s,r,2023-01-01,1"])
    first = lake.run(max_files=1)
    assert (first.counts.raw_rows, first.counts.clean_rows) == (9, 8)
    commits = os.path.join(lake.config.state_path, "curated", "commits")
    for name in os.listdir(commits):
        os.unlink(os.path.join(commits, name))
    again = lake.run()
    assert again.counts.raw_rows == 9 and lake.rows().count() == 8
    assert scan_parquet(spark, lake.config.cleaned_path).count() == 8
    assert {r.partition.split("/")[0] for r in spark.sql(f"SHOW PARTITIONS {lake.config.target}").collect()} == {
        "region=us-east-1", "region=us-west-2", "region=eu-west-1", "region=ap-southeast-1",
    }


def test_steps_of_a_backlog(spark, tmp_path, database):
    lake = Lake(spark, tmp_path, database)
    for i, line in enumerate(CLEAN):
        drop(lake.raw, f"f{i}.csv", [line])
    counts = lake.run(max_files=3).counts
    assert (counts.raw_rows, counts.batches) == (8, 3)
    assert lake.run(max_bytes=100).counts.batches == 0
    for i, line in enumerate(CLEAN):
        drop(lake.raw, f"g{i}.csv", [line])
    counts = lake.run(max_bytes=500).counts
    assert counts.raw_rows == 8 and counts.batches > 1
    assert lake.rows().count() == 16


def test_removed_partition_is_reported(spark, tmp_path, database):
    lake = Lake(spark, tmp_path, database)
    gone = drop(lake.raw, "a.csv", CLEAN[:2])
    drop(lake.raw, "b.csv", CLEAN[2:], partition="year=2026/month=05")
    assert lake.run().deleted.count() == 0
    gone.unlink()
    assert [r.partition for r in lake.run().deleted.collect()] == ["year=2026/month=04"]
    assert lake.rows().count() == 8


@pytest.mark.parametrize("range_files", [2, 1000])
@pytest.mark.parametrize("bounds,steps", [({"max_files": 3}, [3, 3, 3, 2]), ({"max_bytes": 40}, [4, 4, 3]), ({}, [5, 5, 1])])
def test_steps_by_ranges(spark, tmp_path, monkeypatch, range_files, bounds, steps):
    """Steps are the same however many ranges the files are ordered in."""
    monkeypatch.setattr("weirline.streaming.accepted.STEP_FILES", 5)
    schema = "path string, modificationTime timestamp, length bigint, partition string, header string"
    rows = [(f"f{i:02d}", datetime(2026, 1, 1 + i // 4), 10, "", "a") for i in range(11)]
    accepted = AcceptedFiles(spark, str(tmp_path / "accepted"))
    accepted.add(spark.createDataFrame(rows[::-1], schema).repartition(3), len(rows), range_files=range_files, **bounds)
    got = sorted((r.step, r.path) for r in accepted._known().collect())
    assert [p for _, p in got] == [r[0] for r in rows]
    assert [sum(s == step for s, _ in got) for step in sorted({s for s, _ in got})] == steps
    done = []
    accepted.process(lambda files, number: done.append([r.path for r in files.orderBy("path").collect()]), str(tmp_path / "done"))
    assert [len(d) for d in done] == steps and sorted(p for d in done for p in d) == [r[0] for r in rows]
