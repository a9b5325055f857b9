import uuid

import pytest
from pyspark.errors import AnalysisException, ParseException

from weirline.operators.governance import EVERY_TABLE, AccessDenied, AccessRules, Policy
from weirline.plans import answer, run_governed
from weirline.sinks import ResultStore

SEEN = ("customer_id", "email", "region")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Two databases: customers, curated_customers and orders in one, customers in the other."""
    names = []
    for _ in range(2):
        names.append("g_" + uuid.uuid4().hex[:8])
        spark.sql(f"CREATE DATABASE {names[-1]} LOCATION '{tmp_path_factory.mktemp('db')}/{names[-1]}'")
    one, two = names
    rows = [(1, "a@x", "900-1", "us-east-1"), (2, "b@x", "900-2", "us-west-2"), (3, "c@x", "900-3", "us-east-1")]
    customers = spark.createDataFrame(rows, "customer_id int, email string, ssn string, region string")
    customers.write.saveAsTable(f"{one}.customers")
    customers.write.partitionBy("region").saveAsTable(f"{one}.curated_customers")
    customers.selectExpr("customer_id AS id", "ssn AS secret").write.saveAsTable(f"{two}.customers")
    spark.createDataFrame([(1, 10), (3, 30), (3, 31)], "customer_id int, amount int").write.saveAsTable(f"{one}.orders")
    spark.createDataFrame([(1,)], "x int").write.saveAsTable(f"{one}.payroll")
    rules = AccessRules(
        [
            Policy("alice", EVERY_TABLE),
            Policy("bob", f"{one}.customers", SEEN),
            Policy("bob", f"{one}.curated_customers", SEEN, "region = 'us-east-1'"),
            Policy("bob", f"{one}.orders"),
            Policy("bob", f"{two}.customers", ("id",)),
        ]
    )
    return one, two, rules


def ran(spark, lake, principal, text, names=None):
    one, two, rules = lake
    return run_governed(spark, rules, principal, text.format(g=one, h=two, G=one.upper()), names)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_documented_queries_by_full_name(spark, lake):
    preview = "SELECT * FROM {g}.customers LIMIT 10;\n-- all columns should be visible"
    assert ran(spark, lake, "alice", preview).columns == ["customer_id", "email", "ssn", "region"]
    seen = ran(spark, lake, "bob", "SELECT * FROM {g}.customers LIMIT 10;")
    assert seen.columns == list(SEEN) and seen.count() == 3
    counted = "SELECT region, COUNT(*) as cnt\nFROM {g}.curated_customers\nGROUP BY region;"
    assert rows(ran(spark, lake, "bob", counted)) == [("us-east-1", 2)]
    assert rows(ran(spark, lake, "alice", counted)) == [("us-east-1", 2), ("us-west-2", 1)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("SELECT c.email FROM {g}.customers AS c WHERE c.customer_id = 2", [("b@x",)]),
        ("SELECT customers.email FROM {g}.customers WHERE customers.customer_id = 2", [("b@x",)]),
        ("SELECT {g}.customers.email FROM {g}.customers WHERE {g}.customers.customer_id = 2", [("b@x",)]),
        ("SELECT {G}.customers.* FROM `{g}`.CUSTOMERS WHERE customer_id = 1", [(1, "a@x", "us-east-1")]),
        ("SELECT * FROM spark_catalog.{g}.customers WHERE customer_id = 1", [(1, "a@x", "us-east-1")]),
        ("TABLE {g}.curated_customers", [(1, "a@x", "us-east-1"), (3, "c@x", "us-east-1")]),
        ("FROM {g}.curated_customers |> WHERE customer_id > 1 |> SELECT email", [("c@x",)]),
        (
            "SELECT email, SUM(amount) FROM {g}.curated_customers JOIN {g}.orders USING (customer_id) GROUP BY email",
            [("a@x", 10), ("c@x", 61)],
        ),
        ("SELECT a.customer_id FROM {g}.customers a JOIN {h}.customers b ON a.customer_id = b.id WHERE b.id > 2", [(3,)]),
        ("SELECT customers.id FROM {h}.customers WHERE EXISTS (SELECT 1 FROM {g}.orders o WHERE o.customer_id = customers.id)", [(1,), (3,)]),
        ("SELECT (SELECT COUNT(*) FROM {g}.curated_customers) AS n", [(2,)]),
        ("SELECT COUNT(*) FROM {g}.customers WHERE region IN (SELECT region FROM {g}.curated_customers)", [(2,)]),
        ("WITH customers AS (SELECT * FROM {g}.curated_customers) SELECT COUNT(*) FROM customers", [(2,)]),
        ("WITH x AS (TABLE {g}.orders), y AS (SELECT MAX(amount) AS m FROM x) SELECT m FROM y", [(31,)]),
        ("SELECT COUNT(*) FROM (SELECT * FROM {g}.customers UNION ALL SELECT * FROM {g}.curated_customers)", [(5,)]),
        ("SELECT x FROM VALUES (1), (2) AS t(x) UNION SELECT id FROM range(2)", [(0,), (1,), (2,)]),
        ("SELECT email, v FROM {g}.customers LATERAL VIEW explode(array(1, 2)) t AS v WHERE customer_id = 1", [("a@x", 1), ("a@x", 2)]),
        ("SELECT 'é \U0001f600 {g}.payroll', email FROM {g}.customers WHERE customer_id = 1 -- {g}.payroll", None),
    ],
)
def test_queries_over_what_bob_may_see(spark, lake, text, expected):
    got = rows(ran(spark, lake, "bob", text))
    assert got == expected if expected is not None else got[0][1] == "a@x" and got[0][0].endswith("payroll")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM {g}.payroll",
        "SELECT * FROM {g}.customers JOIN {g}.payroll ON true",
        "SELECT (SELECT MAX(x) FROM {g}.payroll) FROM {g}.customers",
        "SELECT * FROM {g}.customers WHERE EXISTS (SELECT 1 FROM {g}.payroll)",
        "WITH p AS (SELECT * FROM {g}.payroll) SELECT 1",
        "SELECT * FROM {g}.customers, LATERAL (SELECT * FROM {g}.payroll)",
        "SELECT * FROM (WITH payroll AS (SELECT 1 AS x) SELECT * FROM payroll) JOIN {g}.payroll USING (x)",
        "SELECT * FROM {g}.no_such_table",
        "SELECT * FROM IDENTIFIER('{g}.payroll')",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT * FROM {g}.customers VERSION AS OF 1",
        "SELECT * FROM STREAM {g}.customers",
        "INSERT INTO {g}.orders SELECT 1, 1",
        "CREATE TABLE {g}.mine AS SELECT * FROM {g}.customers",
        "CREATE TEMP VIEW v AS SELECT * FROM {g}.payroll",
        "DROP TABLE {g}.orders",
        "DESCRIBE TABLE {g}.payroll",
        "SHOW TABLES IN {g}",
        "EXPLAIN SELECT * FROM {g}.customers",
        "SET spark.sql.ansi.enabled = false",
        "EXECUTE IMMEDIATE 'SELECT * FROM {g}.payroll'",
        "BEGIN SELECT * FROM {g}.payroll; END",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT input_file_name() FROM {g}.customers",
    ],
)
def test_refusals(spark, lake, text):
    with pytest.raises(AccessDenied):
        ran(spark, lake, "bob", text)
    assert spark.table(f"{lake[0]}.orders").count() == 3


@pytest.mark.parametrize("text", ["SELECT ssn FROM {g}.customers", "SELECT * FROM {g}.customers WHERE ssn = '900-1'",
                                  "SELECT secret FROM {h}.customers", "SELECT _metadata FROM {g}.customers",
                                  "SELECT * FROM {g}.customers ORDER BY ssn"])
def test_hidden_columns_do_not_exist(spark, lake, text):
    with pytest.raises(AnalysisException):
        ran(spark, lake, "bob", text)


def test_bare_names(spark, lake):
    one, _, _ = lake
    spark.table(f"{one}.payroll").createOrReplaceTempView("customers")
    try:
        names = {"customers": f"{one}.customers"}
        assert ran(spark, lake, "bob", "SELECT email FROM Customers WHERE customer_id = 1", names).collect()[0][0] == "a@x"
        again = "WITH customers AS (SELECT * FROM customers WHERE customer_id = 2) SELECT email FROM customers"
        assert rows(ran(spark, lake, "bob", again, names)) == [("b@x",)]
        # The analyst's session does not know other sessions' views.
        with pytest.raises(AccessDenied):
            ran(spark, lake, "bob", "SELECT * FROM customers")
        # A name that a subquery defines stands for nothing outside it.
        with pytest.raises((AccessDenied, AnalysisException)):
            ran(spark, lake, "bob", "SELECT * FROM (WITH payroll AS (SELECT 1) SELECT * FROM payroll), payroll")
    finally:
        spark.catalog.dropTempView("customers")
    spark.catalog.setCurrentDatabase(one)
    try:
        assert ran(spark, lake, "bob", "SELECT * FROM customers").columns == list(SEEN)
        outside = "SELECT * FROM (WITH payroll AS (SELECT 1) SELECT * FROM payroll), payroll"
        with pytest.raises((AccessDenied, AnalysisException)):
            ran(spark, lake, "bob", outside)
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_settings_and_faulty_text(spark, lake):
    with pytest.raises(ParseException):
        ran(spark, lake, "bob", "SELEC 1")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert rows(ran(spark, lake, "bob", "SELECT CAST('x' AS INT)")) == [(None,)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_answers_name_any_table(spark, lake, tmp_path):
    one, _, rules = lake
    store = ResultStore(str(tmp_path))
    text = f"SELECT email, amount FROM {one}.customers JOIN {one}.orders USING (customer_id)"
    location = answer(spark, rules, "bob", None, text, store, "amounts")
    assert rows(store.read(spark, location, "email string, amount int")) == [("a@x", 10), ("c@x", 30), ("c@x", 31)]
    with pytest.raises(AccessDenied):
        answer(spark, rules, "bob", f"{one}.customers", f"SELECT * FROM {one}.payroll", store, "leak")
    with pytest.raises(AccessDenied):
        answer(spark, rules, "mallory", f"{one}.customers", "SELECT * FROM customers", store, "leak")
