from dataclasses import replace

import pytest
from lake import CLEAN, HEADER, PARTITIONS, drop
from pyspark.sql import functions as F

from weirline.catalog import create_database, discover, register_raw_table
from weirline.config import CurateRules, JobConfig, LakeNames
from weirline.plans import run_arrivals, run_batch
from weirline.sources import FAULT, locate, read_layouts, scan_parquet
from weirline.streaming import TooManyFaults

RULES = CurateRules()


def read(spark, tmp_path, root, **options):
    return read_layouts(spark, discover(spark, str(root), str(tmp_path / "state")), **options)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


FAULTY = [
    ("1,x,y", None), ("2", "short"), ("3,x", "short"), ("4,x,y,z", "long"), ("5,a,b,c,d,e,f,g", "long"), ('6,"q,y', "unclosed quote"),
    ('7,x,"q', "unclosed quote"), ('8,"l, o",y', None), ('13,"l""o, w",y', "long"), ("9,,", None), (",,", None), ('10,"",y', None), ('11,"a\\"b",y', None),
    ("12,é \U0001f600,y", None), ("a,b,c", None),
]


@pytest.mark.parametrize("scans", [16, 0])
def test_what_is_wrong_with_a_line(spark, tmp_path, scans):
    path = drop(tmp_path / "raw", "a.csv", [line for line, _ in FAULTY], "a,b,c")
    df = read(spark, tmp_path, tmp_path / "raw", faults=True, scans=scans).cache()
    assert df.columns == ["a", "b", "c", *PARTITIONS, FAULT]
    bad = rows(df.where(F.col(FAULT).isNotNull()), f"{FAULT}.text", f"{FAULT}.kind")
    assert bad == sorted(((t, k) for t, k in FAULTY if k), key=repr)
    assert {r[0].rsplit("/", 1)[1] for r in rows(df.where(F.col(FAULT).isNotNull()), f"{FAULT}.path")} == {path.name}
    # Lines that fit have the values that Spark's own reader gives; others are filled and cut as it does.
    plain = spark.read.schema("a string, b string, c string").option("header", "true").csv(str(path))
    good = df.where(F.col(FAULT).isNull())
    fine = [line.split(",")[0] or None for line, kind in FAULTY if not kind]
    expected = [r for r in rows(plain) if r[0] in fine]
    assert rows(good, "a", "b", "c") == expected
    ragged = df.where(F.col(FAULT)["kind"] != "unclosed quote")
    assert rows(ragged, "a", "b", "c") == [r for r in rows(plain) if r[0] not in ("6", "7") and (r[0] not in fine)]


def test_blank_lines_and_line_ends(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "a.csv").write_bytes(b"a,b\r\n1,2\r\n\r\n3\r\n4,5")
    df = read(spark, tmp_path, root, faults=True)
    assert rows(df, "a", "b") == [("1", "2"), ("3", None), ("4", "5")]
    found = locate(spark, df.where(F.col(FAULT).isNotNull()).select(f"{FAULT}.*"))
    assert rows(found, "line", "kind", "text") == [(4, "short", "3")]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(4000)]
    for at in (0, 1500, 1501, 3999):
        lines[at] = "bad"
    drop(tmp_path / "raw", "a b.csv", lines, "a,b")
    drop(tmp_path / "raw", "fine.csv", ["1,2"], "a,b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = read(spark, tmp_path, tmp_path / "raw", faults=True)
        assert df.rdd.getNumPartitions() > 4
        found = rows(locate(spark, df.where(F.col(FAULT).isNotNull()).select(f"{FAULT}.*")), "line", "text")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([(at + 2, "bad") for at in (0, 1500, 1501, 3999)], key=repr)


def test_two_thousand_headers_are_one_scan(spark, tmp_path):
    names = [f"c{i}" for i in range(12)]
    root = tmp_path / "raw" / "year=2026" / "month=04"
    root.mkdir(parents=True)
    expected = []
    for i in range(2000):
        own = [names[(i + k * (1 + 2 * (i % 5 // 2))) % 12] for k in range(1 + i % 9)]
        own = [f"k{i % 700}", *dict.fromkeys(own)]
        (root / f"f{i}.csv").write_text(",".join(own) + "\n" + ",".join(f"{i}-{c}" for c in own) + "\n")
        expected += [(c, f"{i}-{c}") for c in own]
    found = discover(spark, str(tmp_path / "raw"), str(tmp_path / "state"))
    assert len(found.layouts) > 700
    df = read_layouts(spark, found)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    long = df.unpivot(list(PARTITIONS), [c for c in df.columns if c not in PARTITIONS], "name", "value").where("value IS NOT NULL")
    assert rows(long, "name", "value") == sorted(expected, key=repr)
    assert rows(df.select("month").distinct()) == [("04",)]


def test_one_scan_refuses_files_that_came_or_changed(spark, tmp_path):
    root = tmp_path / "raw"
    drop(root, "a.csv", ["1,2"], "a,b")
    drop(root, "b.csv", ["1,2"], "b,a")
    d = discover(spark, str(root), str(tmp_path / "state"))
    late = drop(root, "late.csv", ["1,2"], "a,c")
    with pytest.raises(Exception, match="late.csv"):
        read_layouts(spark, d, scans=1).collect()
    late.unlink()
    assert read_layouts(spark, d, scans=1).count() == 2
    import os

    drop(root, "a.csv", ["2,1"], "b,a")
    os.utime(root / "year=2026" / "month=04" / "a.csv", (1, 1))
    with pytest.raises(Exception, match="changed after discovery"):
        read_layouts(spark, d, scans=1).collect()


class Lake:
    def __init__(self, spark, tmp_path, **overrides):
        self.spark, self.raw = spark, tmp_path / "lake" / "raw" / "customers"
        names = LakeNames("r" + tmp_path.name.replace("-", "_").lower()[-20:], str(tmp_path / "lake"))
        self.config = JobConfig.for_lake(names, quarantine_path=names.quarantine("customers"), **overrides)
        self.raw.mkdir(parents=True)
        create_database(spark, names.database, str(tmp_path / "database"))
        register_raw_table(spark, self.config.source, str(self.raw), RULES.raw_columns, PARTITIONS)

    def run(self, **overrides):
        config = replace(self.config, **overrides)
        return run_arrivals(self.spark, config).counts if config.bookmark else run_batch(self.spark, config)

    def rows(self):
        return self.spark.table(self.config.target)

    def quarantined(self):
        return rows(scan_parquet(self.spark, self.config.quarantine_path), "line", "kind", "text")


BROKEN = [*CLEAN[:3], "109,Short,Line", CLEAN[3] + ",surplus", '110,"Open,Q,o@mail.test,s,us-east-1,2021-01-01,1', "x,A,B,e,s,r,2023-01-01,1"]
FOUND = [
    (5, "short", BROKEN[3]),
    (6, "long", BROKEN[4]),
    (7, "unclosed quote", BROKEN[5]),
]


@pytest.mark.parametrize("bookmark", [True, False])
def test_faulty_lines_are_quarantined_and_counted(spark, tmp_path, bookmark):
    lake = Lake(spark, tmp_path, bookmark=bookmark)
    drop(lake.raw, "a.csv", BROKEN)
    drop(lake.raw, "b.csv", CLEAN[4:])
    counts = lake.run()
    assert (counts.raw_rows, counts.clean_rows, counts.faults) == (11, 7, 3)
    assert lake.quarantined() == FOUND
    assert rows(lake.rows(), "customer_id") == [(i,) for i in (101, 102, 103, 105, 106, 107, 108)]


@pytest.mark.parametrize("bookmark", [True, False])
def test_a_job_without_quarantine_counts_in_one_pass(spark, tmp_path, bookmark, capsys):
    lake = Lake(spark, tmp_path, bookmark=bookmark)
    drop(lake.raw, "a.csv", BROKEN)
    counts = lake.run(quarantine_path=None)
    assert (counts.raw_rows, counts.clean_rows, counts.faults) == (7, 3, 3)
    assert not lake.config.quarantine_path or not (tmp_path / "lake" / "quarantine").exists()


@pytest.mark.parametrize("bookmark", [True, False])
def test_too_many_faults_write_nothing_but_the_quarantine(spark, tmp_path, bookmark):
    lake = Lake(spark, tmp_path, bookmark=bookmark)
    drop(lake.raw, "a.csv", BROKEN)
    with pytest.raises(Exception, match="3 lines do not fit their header, 2 may") as error:
        lake.run(max_faults=2)
    assert bookmark or error.type is TooManyFaults
    assert not spark.catalog.tableExists(lake.config.target) or lake.rows().count() == 0
    assert lake.quarantined() == FOUND
    # The files are still to be done, and are with a higher limit; a batch's quarantine is replaced.
    counts = lake.run(max_faults=3)
    assert (counts.clean_rows, counts.faults) == (3, 3)
    assert len(lake.quarantined()) == (3 if bookmark else 6)


def test_raw_files_are_parsed_once_for_all_zones(spark, tmp_path):
    """Both zones and the quarantine come from one read of the raw files."""
    lake = Lake(spark, tmp_path, cleaned_path=str(tmp_path / "lake" / "cleaned"))
    drop(lake.raw, "a.csv", BROKEN)
    reads = scans_of_csv(spark, lambda: lake.run())
    assert reads == 1
    cleaned = scan_parquet(spark, str(tmp_path / "lake" / "cleaned"), "customer_id int, year string, month string")
    assert rows(cleaned, "customer_id", "month") == [(101, "04"), (102, "04"), (103, "04")]
    workspaces = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    import pathlib

    assert not list(pathlib.Path(workspaces, "weirline").glob("staged-*"))


def scans_of_csv(spark, run) -> int:
    """How many executed plans of ``run`` scan CSV files."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        listed = store.executionsList()
        return {listed.apply(i).executionId(): listed.apply(i) for i in range(listed.size())}

    before = executions().keys()
    run()
    return sum("Scan csv" in e.physicalPlanDescription() for k, e in executions().items() if k not in before)


def test_choice_columns_come_with_the_types_found(spark, tmp_path):
    mapping = tuple(m._replace(target_type="string") if m.source == "annual_spend" else m for m in RULES.mapping)
    lake = Lake(spark, tmp_path, rules=CurateRules(mapping=mapping), choice_columns=("annual_spend",))

    def spend(line, value):
        return ",".join([*line.split(",")[:-1], value])

    drop(lake.raw, "a.csv", [spend(CLEAN[0], "12"), spend(CLEAN[1], "7")])
    lake.run()
    assert "annual_spend" in lake.rows().columns and "annual_spend_int" not in lake.rows().columns
    drop(lake.raw, "b.csv", [spend(CLEAN[2], "5"), spend(CLEAN[3], "much")])
    lake.run()
    drop(lake.raw, "c.csv", [spend(CLEAN[4], "6")])
    lake.run()
    drop(lake.raw, "d.csv", [spend(CLEAN[5], "1.5")])
    lake.run()
    got = lake.rows()
    assert dict(got.dtypes)["annual_spend_int"] == "int" and dict(got.dtypes)["annual_spend_double"] == "double"
    assert rows(got, "customer_id", "annual_spend", "annual_spend_int", "annual_spend_double", "annual_spend_string") == [
        (101, "12", None, None, None), (102, "7", None, None, None), (103, None, 5, None, None),
        (104, None, None, None, "much"), (105, None, 6, None, None), (106, None, None, 1.5, None),
    ]


def test_arguments(tmp_path):
    argv = ["--PREFIX", "p", "--ROOT", "/r", "--QUARANTINE_PATH", "/q", "--MAX_FAULTS", "5", "--CHOICE_COLUMNS", "a, b"]
    config = JobConfig.from_arguments(argv)
    assert (config.quarantine_path, config.max_faults, config.choice_columns) == ("/q", 5, ("a", "b"))
    assert HEADER
