import gzip
import os
import shutil

import pytest
from lake import CLEAN, HEADER, PARTITIONS, drop

from weirline.catalog import (
    deleted_partitions,
    describe_raw_table,
    discover,
    register_discovered,
    register_partitions,
    register_raw_table,
    update_raw_table,
)
from weirline.catalog.discovery import HeaderLedger
from weirline.config import CurateRules
from weirline.sources import (
    file_access,
    group_compatible,
    infer_columns,
    list_files,
    partition_columns,
    read_layouts,
    require_depth,
    scan_parquet,
)
from weirline.sources.layouts import Layout, wider_type
from weirline.streaming import DiscoveryFailed, require_layouts


def found(spark, tmp_path, root, **options):
    return discover(spark, str(root), str(tmp_path / "state"), **options)


def test_listing_reads_no_content(spark, tmp_path):
    drop(tmp_path, "a.csv", ["1"], "a")
    files = list_files(spark, str(tmp_path))
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in (
        files._jdf.queryExecution().executedPlan().toString()
    )
    assert files.count() == 1


def test_partition_columns(spark, tmp_path):
    drop(tmp_path / "x", "a.csv", ["1"], "a")
    assert partition_columns(list_files(spark, str(tmp_path / "x"))) == ["year", "month"]
    drop(tmp_path / "y", "a.csv", ["1"], "a", partition="")
    assert partition_columns(list_files(spark, str(tmp_path / "y"))) == []
    drop(tmp_path / "x", "b.csv", ["1"], "a", partition="year=2027")
    with pytest.raises(ValueError):
        partition_columns(list_files(spark, str(tmp_path / "x")))


def test_partitions_count_from_the_location(spark, tmp_path, database):
    root = tmp_path / "source=crm"
    drop(root, "a.csv", ["1"], "a")
    for location in (str(root), f"file:{root}", f"file://{root}/"):
        files = list_files(spark, location)
        assert [r.partition for r in files.collect()] == ["year=2026/month=04"]
        assert partition_columns(files) == ["year", "month"]
    drop(root / "flat", "b.csv", ["1"], "a", partition="")
    assert [r.partition for r in list_files(spark, str(root / "flat")).collect()] == [""]
    drop(tmp_path / "odd", "a.csv", ["1"], "a", partition="year=a b=c/month=%2F")
    register_raw_table(spark, f"{database}.odd", str(tmp_path / "odd"), ["a"], PARTITIONS)
    register_partitions(spark, f"{database}.odd")
    assert spark.table(f"{database}.odd").collect() == [("1", "a b=c", "/")]
    assert deleted_partitions(spark, f"{database}.odd", list_files(spark, str(tmp_path / "odd"))).count() == 0


def by_file(headers):
    return {r.path.rsplit("/", 1)[1]: r.header for r in headers.collect()}


@pytest.mark.parametrize("scan", [False, True])
def test_headers_of_every_kind_of_file(spark, tmp_path, scan):
    root = tmp_path / "raw"
    drop(root, "plain.csv", ["1,2"], "a,b")
    drop(root, "with space+plus%.csv", ["1,2"], "a,b")
    drop(root, "only header.csv", [], "a,c")
    (root / "year=2026" / "month=04" / "windows.csv").write_bytes(b"\xef\xbb\xbfa,b\r\n1,2\r\n")
    (root / "year=2026" / "month=04" / "empty.csv").write_bytes(b"")
    drop(root, "long.csv", ["1"], ",".join(f"column_{i}" for i in range(9000)))
    (root / "year=2026" / "month=04" / "packed.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    (root / "year=2026" / "month=04" / "other.txt").write_text("x\n")
    headers = found(spark, tmp_path, root, pattern="*.csv*", scan=scan).headers
    got = by_file(headers)
    assert len(got.pop("long.csv").split(",")) == 9000
    assert got == {
        "plain.csv": "a,b",
        "with space+plus%.csv": "a,b",
        "only header.csv": "a,c",
        "windows.csv": "a,b",
        "packed.csv.gz": "a,b",
    }


def test_ledger_opens_only_new_files(spark, tmp_path):
    root = tmp_path / "raw"
    first = drop(root, "a.csv", ["1"], "a")
    ledger = HeaderLedger(spark, str(tmp_path / "ledger"))

    def listed():
        return list_files(spark, str(root))

    assert [ledger.refresh(listed(), str(root)), ledger.refresh(listed(), str(root))] == [1, 0]
    drop(root, "b.csv", ["1"], "b")
    assert ledger.refresh(listed(), str(root)) == 1
    assert by_file(ledger.current(listed())) == {"a.csv": "a", "b.csv": "b"}
    first.unlink()
    assert ledger.refresh(listed(), str(root)) == 0
    assert by_file(ledger.current(listed())) == {"b.csv": "b"}
    drop(root, "b.csv", ["1"], "rewritten")
    os.utime(root / "year=2026" / "month=04" / "b.csv", (1_600_000_000, 1_600_000_000))
    assert ledger.refresh(listed(), str(root)) == 1
    assert by_file(ledger.current(listed())) == {"b.csv": "rewritten"}


def test_added_column(spark, tmp_path):
    root = tmp_path / "raw"
    drop(root, "a.csv", CLEAN[:3], partition="year=2026/month=04")
    drop(root, "b.csv", [f"{line},gold" for line in CLEAN[3:]], HEADER + ",loyalty", "year=2026/month=05")
    d = found(spark, tmp_path, root)
    assert len(d.layouts) == 2 and len(group_compatible(d.layouts)) == 1
    df = read_layouts(spark, d)
    assert df.columns == [*HEADER.split(","), "loyalty", *PARTITIONS]
    assert {(r.month, r.loyalty) for r in df.collect()} == {("04", None), ("05", "gold")}
    assert df.count() == 8


def test_reordered_headers_in_one_folder(spark, tmp_path):
    root = tmp_path / "raw"
    drop(root, "a.csv", ["1,2", "3,4"], "a,b")
    drop(root, "b.csv", ["20,10"], "b,a")
    drop(root, "c.csv", ["300,100,200"], "c,a,b", "year=2026/month=05")
    d = found(spark, tmp_path, root)
    assert len(group_compatible(d.layouts)) == 1
    df = read_layouts(spark, d)
    got = {(r.a, r.b, r.c, r.month) for r in df.collect()}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert got == {("1", "2", None, "04"), ("3", "4", None, "04"), ("10", "20", None, "04"), ("100", "200", "300", "05")}


def test_unrelated_files_make_another_group(spark, tmp_path):
    drop(tmp_path / "raw", "a.csv", CLEAN)
    drop(tmp_path / "raw", "z.csv", ["1,2"], "sku,price")
    groups = group_compatible(found(spark, tmp_path, tmp_path / "raw").layouts)
    assert sorted(len(g[0].columns) for g in groups) == [2, 8]


def test_files_that_came_after_discovery_do_not_bind_by_position(spark, tmp_path):
    root = tmp_path / "raw"
    drop(root, "a.csv", ["1,2"], "a,b")
    d = found(spark, tmp_path, root)
    drop(root, "late.csv", ["20,10"], "b,a")
    with pytest.raises(Exception, match="header"):
        read_layouts(spark, d).collect()


def test_every_visible_file_counts(spark, tmp_path):
    root = tmp_path / "raw"
    for name in ("a.csv", "b.CSV", "c.txt", "x/d.csv", "x/y.z/e"):
        path = root / name
        drop(path.parent, path.name, ["1"], "a", partition="")
    (root / "f.csv.gz").write_bytes(gzip.compress(b"a\n1\n"))
    (root / ".hidden").write_text("b\n2\n")
    d = found(spark, tmp_path, root)
    assert d.layouts[0].files == 6 and read_layouts(spark, d).count() == 6
    drop(root, "other", ["2,3"], "a,b", partition="x")
    d = found(spark, tmp_path, root)
    assert sorted(map(tuple, read_layouts(spark, d).collect()), key=str) == [("1", None)] * 6 + [("2", "3")]
    only = found(spark, tmp_path, root, pattern="*.txt")
    assert read_layouts(spark, only).count() == 1 and only.pattern == "*.txt"


def test_files_beside_the_partitions_are_refused_by_name(spark, tmp_path):
    root = tmp_path / "raw"
    drop(root, "a.csv", ["1"], "a")
    drop(root, "deep.csv", ["1"], "a", partition="year=2026/month=04/more")
    listed = list_files(spark, str(root))
    with pytest.raises(ValueError, match="deep.csv"):
        require_depth(listed, str(root), PARTITIONS)
    with pytest.raises(ValueError, match="deep.csv"):
        read_layouts(spark, found(spark, tmp_path, root))
    require_depth(listed.where("path NOT LIKE '%deep%'"), str(root), PARTITIONS)


def test_old_line_ends_and_no_line_end(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "mac.csv").write_bytes(b"a,b\r1,2\r" + b"3,4\r" * 100_000)
    (root / "none.csv").write_bytes(b"a,c")
    assert by_file(found(spark, tmp_path, root).headers) == {"mac.csv": "a,b", "none.csv": "a,c"}


def test_a_table_from_what_was_discovered(spark, tmp_path, database):
    root, table = tmp_path / "raw", f"{database}.crawled"
    drop(root, "a.csv", ["1,x"], "id,name")
    rows = register_discovered(spark, found(spark, tmp_path, root), table)
    assert [(r.name, r.type, r.is_partition) for r in rows.collect()] == [
        ("id", "int", False), ("name", "string", False), ("year", "string", True), ("month", "string", True),
    ]
    assert spark.table(table).collect() == [("1", "x", "2026", "04")]
    drop(root, "b.csv", ["5000000000,y,2.5"], "id,name,spend", partition="year=2026/month=05")
    rows = register_discovered(spark, found(spark, tmp_path, root), table)
    assert [r.type for r in rows.collect()][:3] == ["bigint", "string", "double"]
    assert spark.table(table).columns == ["id", "name", "spend", "year", "month"]


def test_inferred_types(spark, tmp_path):
    root = tmp_path / "raw"
    drop(root, "a.csv", ["1,1.5,x,2023-01-05,1"], "i,d,s,t,mixed")
    drop(root, "b.csv", ["3000000000,2,y,2023-01-06,z,true"], "i,d,s,t,mixed,extra", "year=2026/month=05")
    d = found(spark, tmp_path, root)
    schema = infer_columns(spark, d)
    assert [(f.name, f.dataType.simpleString()) for f in schema.fields] == [
        ("i", "bigint"),
        ("d", "double"),
        ("s", "string"),
        ("t", "date"),
        ("mixed", "string"),
        ("extra", "boolean"),
        ("year", "string"),
        ("month", "string"),
    ]


@pytest.mark.parametrize(
    "one, other, wide",
    [("int", "int", "int"), ("int", "double", "double"), ("bigint", "int", "bigint"), ("date", "timestamp", "timestamp"), ("int", "date", "string")],
)
def test_wider_type(one, other, wide):
    assert wider_type(one, other) == wide == wider_type(other, one)


def layout(*columns):
    return Layout(columns, ",".join(columns), 1, "f")


def test_gate():
    assert require_layouts([layout("a", "b")], ["a", "b"]) == ["a", "b"]
    assert require_layouts([], ["a", "b"]) == ["a", "b"]
    for bad in (layout("b", "a"), layout("a"), layout("x", "y"), layout("a", "b", "c")):
        with pytest.raises(DiscoveryFailed):
            require_layouts([layout("a", "b"), bad], ["a", "b"])


def test_gate_with_added_columns():
    short, long = layout("a", "b"), layout("a", "b", "c")
    assert require_layouts([short, long], ["a", "b"], ["a", "b"]) == ["a", "b", "c"]
    assert require_layouts([short], ["a", "b", "c"], ["a", "b"]) == ["a", "b", "c"]
    for bad in ([layout("a")], [layout("a", "c", "b")], [long, layout("a", "b", "d")], [layout("x", "a", "b")]):
        with pytest.raises(DiscoveryFailed):
            require_layouts(bad, ["a", "b"], ["a", "b"])
    with pytest.raises(DiscoveryFailed):
        require_layouts([layout("b", "a", "c", "d")], ["a", "b", "c"], ["a", "b"])


def test_partitions_are_registered_and_reported_when_gone(spark, tmp_path, database):
    root, table = tmp_path / "raw", f"{database}.customers"
    for month in ("04", "05", "06"):
        drop(root, "a.csv", CLEAN, partition=f"year=2026/month={month}")
    register_raw_table(spark, table, str(root), CurateRules().raw_columns, PARTITIONS)
    assert spark.table(table).count() == 0
    register_partitions(spark, table)
    assert spark.table(table).count() == 24
    assert deleted_partitions(spark, table, list_files(spark, str(root))).collect() == []
    shutil.rmtree(root / "year=2026" / "month=05")
    (root / "year=2026" / "month=06" / "a.csv").unlink()
    assert sorted(r.partition for r in deleted_partitions(spark, table, list_files(spark, str(root))).collect()) == [
        "year=2026/month=05",
        "year=2026/month=06",
    ]
    assert spark.sql(f"SHOW PARTITIONS {table}").count() == 3


def test_described_table_with_awkward_columns(spark, tmp_path, database):
    table, columns = f"{database}.t", ["Location", "Provider", "a b"]
    register_raw_table(spark, table, str(tmp_path / "raw"), columns, PARTITIONS)
    described = describe_raw_table(spark, table)
    assert described.location.endswith("/raw")
    assert (described.columns, described.partition_columns) == (columns, list(PARTITIONS))
    register_raw_table(spark, f"{database}.u", str(tmp_path / "raw"), columns)
    assert describe_raw_table(spark, f"{database}.u").partition_columns == []


def test_raw_table_follows_the_headers(spark, tmp_path, database):
    root, table = tmp_path / "raw", f"{database}.customers"
    drop(root, "a.csv", ["1,2"], "a,b")
    register_raw_table(spark, table, str(root), ["a", "b"], PARTITIONS)
    assert update_raw_table(spark, table, [("a", "b")]) == []
    drop(root, "b.csv", ["3,4,5"], "a,b,c", "year=2026/month=05")
    d = found(spark, tmp_path, root)
    assert update_raw_table(spark, table, [x.columns for x in d.layouts]) == ["c"]
    assert spark.table(table).columns == ["a", "b", "c", "year", "month"]
    rows = read_layouts(spark, d).collect()
    assert sorted(map(tuple, rows)) == [("1", "2", None, "2026", "04"), ("3", "4", "5", "2026", "05")]
    with pytest.raises(Exception, match="header"):
        spark.table(table).collect()
    for refused in ([("b", "a")], [("a", "b", "x")]):
        with pytest.raises(ValueError):
            update_raw_table(spark, table, refused)


def test_parquet_drift(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(1,)], "a int").write.mode("append").parquet(path)
    spark.createDataFrame([(2, "x")], "a int, b string").write.mode("append").parquet(path)
    assert sorted(map(tuple, scan_parquet(spark, path, merge_schema=True).collect())) == [(1, None), (2, "x")]


def test_files_are_found_by_any_name_of_their_storage(tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x%20y").write_text("here")
    located = file_access()
    for path in (f"{tmp_path}/a b/x%20y", f"file:{tmp_path}/a b/x%20y", f"file://{tmp_path}/a b/x%20y"):
        system, inner = located(path)
        assert system.open_input_file(inner).read() == b"here"
