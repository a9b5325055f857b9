import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weirline.operators.governance import (
    DESCRIBE,
    EVERY_TABLE,
    SELECT,
    AccessDenied,
    AccessRules,
    ColumnTag,
    Policy,
    TagPolicy,
    describe_governed,
    govern,
    govern_as_view,
)

COLUMNS = ("customer_id", "email", "ssn", "region")
ROWS = [
    (1, "a@x", "900-1", "us-east-1"),
    (2, "b@x", "900-2", "us-west-2"),
    (3, "c@x", "900-3", "us-east-1"),
    (4, "d@x", "900-4", None),
]
VISIBLE = ("customer_id", "email", "region")


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(ROWS, "customer_id int, email string, ssn string, region string")


RULES = AccessRules(
    policies=[
        Policy("alice", EVERY_TABLE),
        Policy("bob", "customers", VISIBLE),
        Policy("bob", "curated_customers", VISIBLE, "region = 'us-east-1'"),
        Policy("carol", "customers", VISIBLE, "ssn = '900-2'"),
        Policy("dan", "customers", VISIBLE, permissions=frozenset({DESCRIBE})),
        Policy("erin", EVERY_TABLE),
        Policy("erin", "customers", VISIBLE),
    ],
    tag_policies=[TagPolicy("tina", frozenset({"public", "internal"})), TagPolicy("theo", frozenset({"confidential"}))],
    tags=[
        ColumnTag("customers", "customer_id", "public"),
        ColumnTag("customers", "email", "internal"),
        ColumnTag("customers", "ssn", "confidential"),
    ],
)


def test_full_read(spark, customers):
    got = govern(spark, RULES, "alice", "customers", customers)
    assert tuple(got.columns) == COLUMNS and got.count() == 4


def test_columns(spark, customers):
    got = govern(spark, RULES, "bob", "customers", customers)
    assert tuple(got.columns) == VISIBLE and got.count() == 4


def test_rows_and_columns(spark, customers):
    got = govern(spark, RULES, "bob", "curated_customers", customers)
    assert tuple(got.columns) == VISIBLE
    assert [tuple(r) for r in got.groupBy("region").count().collect()] == [("us-east-1", 2)]


def test_row_filter_may_use_a_hidden_column(spark, customers):
    got = govern(spark, RULES, "carol", "customers", customers)
    assert [r.customer_id for r in got.collect()] == [2]


ATTEMPTS = {
    "where": lambda v, base: v.where("ssn = '900-1'").collect(),
    "where column": lambda v, base: v.where(F.col("ssn") == "900-1").collect(),
    "order": lambda v, base: v.orderBy("ssn").collect(),
    "sort within": lambda v, base: v.sortWithinPartitions("ssn").collect(),
    "group": lambda v, base: v.groupBy("ssn").count().collect(),
    "select": lambda v, base: v.select("ssn").collect(),
    "select expression": lambda v, base: v.selectExpr("max(ssn)").collect(),
    "parent column": lambda v, base: v.where(base["ssn"] == "900-1").collect(),
    "parent select": lambda v, base: v.select(base["ssn"]).collect(),
    "after projection": lambda v, base: v.select("customer_id").where("ssn is not null").collect(),
    "after rename": lambda v, base: v.toDF("a", "b", "c").orderBy("ssn").collect(),
    "attribute": lambda v, base: v.ssn,
    "files": lambda v, base: v.select("_metadata.file_path").collect(),
    "repartition": lambda v, base: v.repartition(F.col("ssn")).collect(),
    "window": lambda v, base: v.selectExpr("count(1) over (partition by ssn)").collect(),
}


@pytest.mark.parametrize("attempt", ATTEMPTS.values(), ids=ATTEMPTS.keys())
def test_hidden_column_cannot_be_named(spark, customers, tmp_path, attempt):
    customers.write.parquet(str(tmp_path / "customers"))
    base = spark.read.parquet(str(tmp_path / "customers"))
    with pytest.raises((AnalysisException, AttributeError)):
        attempt(govern(spark, RULES, "bob", "customers", base), base)


def test_sql_view(spark, customers):
    govern_as_view(spark, RULES, "bob", "curated_customers", "bob_customers", customers)
    assert spark.sql("SELECT * FROM bob_customers LIMIT 10").columns == list(VISIBLE)
    assert spark.sql("SELECT region, COUNT(*) AS cnt FROM bob_customers GROUP BY region").collect() == [("us-east-1", 2)]
    for sql in ("SELECT ssn FROM bob_customers", "SELECT 1 FROM bob_customers WHERE ssn = 'x'"):
        with pytest.raises(AnalysisException):
            spark.sql(sql)


def test_describe(spark, customers):
    got = describe_governed(spark, RULES, "bob", "customers", customers)
    assert [tuple(r) for r in got.collect()] == [("customer_id", "int"), ("email", "string"), ("region", "string")]


def test_denied(spark, customers):
    for principal, table in (("nobody", "customers"), ("bob", "orders"), ("dan", "customers"), ("tina", "orders")):
        with pytest.raises(AccessDenied):
            govern(spark, RULES, principal, table, customers)
    assert describe_governed(spark, RULES, "dan", "customers", customers).count() == 3


def test_own_policy_goes_before_every_table(spark, customers):
    for spelling in ("customers", "Customers", "CUSTOMERS"):
        assert tuple(govern(spark, RULES, "erin", spelling, customers).columns) == VISIBLE
    assert tuple(govern(spark, RULES, "erin", "other", customers).columns) == COLUMNS


def test_catalog_tables_go_by_full_name(spark, customers, database):
    customers.write.saveAsTable(f"{database}.customers")
    rules = AccessRules([Policy("erin", EVERY_TABLE), Policy("erin", f"{database}.customers", VISIBLE)])
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(database)
    try:
        for spelling in ("customers", f"{database}.customers", f"{database.upper()}.Customers", f"spark_catalog.{database}.customers"):
            assert tuple(govern(spark, rules, "erin", spelling).columns) == VISIBLE
    finally:
        spark.catalog.setCurrentDatabase(before)


def test_tags(spark, customers):
    assert govern(spark, RULES, "tina", "customers", customers).columns == ["customer_id", "email"]
    assert govern(spark, RULES, "theo", "customers", customers).columns == ["ssn"]


def test_refused_rules():
    with pytest.raises(ValueError):
        AccessRules([Policy("bob", "t"), Policy("bob", "T", ("a",))])
    with pytest.raises(ValueError):
        AccessRules(tags=[ColumnTag("t", "c", "public"), ColumnTag("t", "c", "internal")])
    with pytest.raises(ValueError):
        AccessRules(tag_policies=[TagPolicy("a", frozenset({"public"})), TagPolicy("a", frozenset())])
    with pytest.raises(ValueError):
        ColumnTag("t", "c", "secret")
    with pytest.raises(ValueError):
        TagPolicy("a", frozenset({"secret"}))


def test_unknown_policy_column(spark, customers):
    with pytest.raises(ValueError):
        govern(spark, AccessRules([Policy("bob", "customers", ("absent",))]), "bob", "customers", customers)


def test_rules_from_tables(spark, customers):
    policies = spark.createDataFrame(
        [
            ("alice", "*", None, None, ["SELECT", "DESCRIBE"]),
            ("bob", "customers", list(VISIBLE), "region = 'us-east-1'", ["select"]),
            ("dan", "customers", None, None, ["DESCRIBE"]),
            ("eve", "customers", None, None, None),
        ],
        "principal string, table string, columns array<string>, row_filter string, permissions array<string>",
    )
    tag_policies = spark.createDataFrame(
        [("tina", ["public"], ["SELECT"])], "principal string, values array<string>, permissions array<string>"
    )
    tags = spark.createDataFrame([("customers", "email", "public")], "table string, column string, value string")
    rules = AccessRules.from_tables(policies, tag_policies, tags)
    assert govern(spark, rules, "alice", "customers", customers).columns == list(COLUMNS)
    assert govern(spark, rules, "bob", "customers", customers).count() == 2
    assert govern(spark, rules, "tina", "customers", customers).columns == ["email"]
    assert describe_governed(spark, rules, "dan", "customers", customers).count() == len(COLUMNS)
    for principal, denied in (("dan", govern), ("eve", govern), ("eve", describe_governed), ("tina", describe_governed)):
        with pytest.raises(AccessDenied):
            denied(spark, rules, principal, "customers", customers)
    with pytest.raises(ValueError):
        AccessRules.from_tables(policies.drop("permissions"))


def test_no_view_is_left_behind(spark, customers):
    frame = govern(spark, RULES, "bob", "curated_customers", customers)
    described = describe_governed(spark, RULES, "bob", "curated_customers", customers)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("governed_")]
    assert frame.count() == 2 and described.count() == len(frame.columns)


def test_filters_and_columns_reach_the_scan(spark, customers, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    customers.write.partitionBy("region").parquet(path)
    got = govern(spark, RULES, "bob", "curated_customers", spark.read.parquet(path))
    plan = got.where("customer_id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan
    assert "GreaterThan(customer_id,1)" in plan
    assert "ssn" not in plan.split("ReadSchema")[1]


def test_permissions_are_named_like_grants():
    assert Policy("a", "t").permissions == {SELECT, DESCRIBE}
