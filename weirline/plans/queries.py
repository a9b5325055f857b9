"""Every operator as a query over the provided tables.

The tables hold no raw customer files, so these queries first write some: text
rendered from the tables, with faults that follow from the row's own values.
All of them read whole tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirline.catalog import (
    create_database,
    deleted_partitions,
    discover,
    fit_to_table,
    register_discovered,
    register_partitions,
    register_raw_table,
    schema_rows,
    update_raw_table,
)
from weirline.config import CurateRules, JobConfig, LakeNames
from weirline.functions import field, parse_date
from weirline.operators import (
    append_column,
    apply_mapping,
    counts_from_footers,
    drop_missing,
    first_rows,
    grouped_count,
    keys_present,
    make_columns,
    observe_rows,
    replace_column,
    resolve_choice,
    row_counts,
    select_all,
)
from weirline.operators.governance import (
    EVERY_TABLE,
    AccessRules,
    ColumnTag,
    Policy,
    TagPolicy,
    describe_governed,
    govern,
)
from weirline.plans.analyst import answer
from weirline.plans.arrival import run_arrivals
from weirline.plans.curate import curate, run_batch, shape
from weirline.plans.governed import run_governed
from weirline.scratch import new_workspace
from weirline.sinks import ResultStore, append_parquet, append_to_table, spread_for_partitions
from weirline.sources import (
    group_compatible,
    infer_columns,
    list_files,
    read_layouts,
    scan_parquet,
    scan_raw_csv,
    scan_table,
)
from weirline.streaming import RAW_ROWS, DiscoveryFailed, ingest_into, raw_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RULES = CurateRules()
YEAR_MONTH = ("year", "month")


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        ORACLE[key] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str | Column) -> Column:
    return (field(column) if isinstance(column, str) else column).cast("string")


def _drop_csv(df: DataFrame, location: str, partitions: tuple[str, ...] = (), mode: str = "append") -> None:
    # An overwrite replaces the whole folder, whatever the session prefers.
    writer = spread_for_partitions(df, partitions).write.mode(mode).option("partitionOverwriteMode", "static")
    writer = writer.option("header", "true")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.csv(location)


# Raw customers: text with faults in the id, e-mail, date, spend and region.

RAW_CUSTOMERS = """
  SELECT CASE c_nationkey WHEN 3 THEN c_custkey::VARCHAR || '.5'
                          WHEN 8 THEN 'x' || c_custkey::VARCHAR
                          WHEN 11 THEN ' ' || c_custkey::VARCHAR || ' '
                          WHEN 13 THEN '99999999999'
                          ELSE c_custkey::VARCHAR END AS customer_id,
         split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         CASE WHEN c_nationkey = 17 THEN NULL
              ELSE lower(c_mktsegment) || c_custkey::VARCHAR || '@example.com' END AS email,
         split_part(c_name, '#', 2) || '-' || c_nationkey::VARCHAR AS ssn,
         CASE WHEN c_nationkey = 20 THEN NULL ELSE c_mktsegment END AS region,
         CASE c_nationkey WHEN 5 THEN '2023-02-30'
                          WHEN 6 THEN '2023-1-5'
                          WHEN 7 THEN '2023-01-15 00:00:00'
                          ELSE '20' || lpad(c_nationkey::VARCHAR, 2, '0') || '-07-'
                               || lpad((c_nationkey + 1)::VARCHAR, 2, '0') END AS signup_date,
         CASE WHEN c_nationkey = 9 THEN 'abc' ELSE c_acctbal::VARCHAR END AS annual_spend,
         '2026' AS year,
         CASE WHEN c_nationkey < 12 THEN '04' ELSE '05' END AS month,
         c_acctbal, c_custkey, c_nationkey
  FROM customer
"""

CURATED_CUSTOMERS = f"""
  SELECT TRY_CAST(trim(customer_id) AS INTEGER) AS customer_id, first_name, last_name, email, ssn, region,
         CASE WHEN regexp_full_match(signup_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}')
              THEN TRY_CAST(signup_date AS DATE) END AS signup_date,
         CASE WHEN annual_spend <> 'abc' THEN c_acctbal END AS annual_spend,
         year, month
  FROM ({RAW_CUSTOMERS}) raw
  WHERE regexp_full_match(trim(customer_id), '[+-]?\\d+')
    AND TRY_CAST(trim(customer_id) AS INTEGER) IS NOT NULL
    AND email IS NOT NULL
"""


def _render_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = _text("c_custkey"), field("c_nationkey")
    number = F.split_part("c_name", F.lit("#"), F.lit(2))
    return _table(spark, sf_dir, "customer").select(
        F.when(nation == 3, F.concat(key, F.lit(".5")))
        .when(nation == 8, F.concat(F.lit("x"), key))
        .when(nation == 11, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(nation == 13, F.lit("99999999999"))
        .otherwise(key)
        .alias("customer_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        number.alias("last_name"),
        F.when(nation != 17, F.concat(F.lower("c_mktsegment"), key, F.lit("@example.com"))).alias("email"),
        F.concat(number, F.lit("-"), _text(nation)).alias("ssn"),
        F.when(nation != 20, field("c_mktsegment")).alias("region"),
        F.when(nation == 5, F.lit("2023-02-30"))
        .when(nation == 6, F.lit("2023-1-5"))
        .when(nation == 7, F.lit("2023-01-15 00:00:00"))
        .otherwise(
            F.concat(
                F.lit("20"),
                F.lpad(_text(nation), 2, "0"),
                F.lit("-07-"),
                F.lpad(_text(nation + 1), 2, "0"),
            )
        )
        .alias("signup_date"),
        F.when(nation == 9, F.lit("abc")).otherwise(_text("c_acctbal")).alias("annual_spend"),
        F.lit("2026").alias("year"),
        F.when(nation < 12, F.lit("04")).otherwise(F.lit("05")).alias("month"),
    )


def _raw_customers(spark: SparkSession, sf_dir: str, workspace: str) -> DataFrame:
    location = f"{workspace}/raw/customers"
    _drop_csv(_render_customers(spark, sf_dir), location, YEAR_MONTH)
    return scan_raw_csv(spark, location, RULES.raw_columns, YEAR_MONTH)


def _curated_customers(spark: SparkSession, sf_dir: str, workspace: str) -> DataFrame:
    location = f"{workspace}/curated/customers"
    append_parquet(curate(_raw_customers(spark, sf_dir, workspace), RULES), location, ["region"])
    return scan_parquet(spark, location)


@query(f"SELECT region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) curated GROUP BY region")
def curated_region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = new_workspace(spark, "curated-region-count")
    return grouped_count(_curated_customers(spark, sf_dir, workspace), "region")


@query(
    "SELECT customer_id, first_name, last_name, email, ssn, region, signup_date, annual_spend, TRUE AS stamped "
    f"FROM ({CURATED_CUSTOMERS}) curated"
)
def curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = _curated_customers(spark, sf_dir, new_workspace(spark, "curated-rows"))
    return curated.withColumn("stamped", field(RULES.stamp).isNotNull()).drop(RULES.stamp)


# Projections, scalar functions, filters.

ORDERS_AS_TEXT = """
  SELECT CASE o_orderstatus WHEN 'P' THEN o_orderkey::VARCHAR || '.5' ELSE o_orderkey::VARCHAR END AS order_key,
         CASE o_orderpriority WHEN '5-LOW' THEN 'n/a' ELSE o_totalprice::VARCHAR END AS total,
         o_orderstatus AS status, o_totalprice
  FROM orders
"""


@query(
    f"""
    SELECT CASE WHEN regexp_full_match(order_key, '[+-]?\\d+') THEN TRY_CAST(order_key AS INTEGER) END AS order_id,
           CASE WHEN total <> 'n/a' THEN o_totalprice END AS total_price, status
    FROM ({ORDERS_AS_TEXT}) t
    """,
    name="apply_mapping",
)
def apply_mapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _text("o_orderkey")
    raw = _table(spark, sf_dir, "orders").select(
        F.when(field("o_orderstatus") == "P", F.concat(key, F.lit(".5"))).otherwise(key).alias("order_key"),
        F.when(field("o_orderpriority") == "5-LOW", F.lit("n/a")).otherwise(_text("o_totalprice")).alias("total"),
        field("o_orderstatus").alias("status"),
        field("o_orderpriority").alias("unmapped"),
    )
    return apply_mapping(
        raw,
        [
            ("order_key", "string", "order_id", "int"),
            ("total", "string", "total_price", "double"),
            ("status", "string", "status", "string"),
        ],
    )


@query(
    """
    SELECT o_orderkey,
           CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(t AS DATE) END AS order_date
    FROM (SELECT o_orderkey,
                 CASE o_orderpriority WHEN '1-URGENT' THEN '2023-02-30'
                                      WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%-m-%-d')
                                      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t
          FROM orders) raw
    """,
    name="parse_date",
)
def parse_date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = field("o_orderpriority")
    raw = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(priority == "1-URGENT", F.lit("2023-02-30"))
        .when(priority == "2-HIGH", F.date_format("o_orderdate", "yyyy-M-d"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
    )
    return replace_column(raw, "order_date", parse_date(field("order_date")))


@query("SELECT o_orderkey, TRUE AS stamped FROM orders")
def ingest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamp lies between the call and now, and is one for the whole query."""
    begun = F.lit(datetime.datetime.now(datetime.timezone.utc))
    stamped = append_column(_table(spark, sf_dir, "orders"), RULES.stamp, F.current_timestamp())
    soon = begun + F.make_dt_interval(F.lit(1))
    return stamped.select("o_orderkey", field(RULES.stamp).between(begun, soon).alias("stamped"))


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
    """
)
def drop_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _table(spark, sf_dir, "orders").select(
        F.when(field("o_orderstatus") != "P", field("o_orderkey")).alias("o_orderkey"),
        "o_custkey",
        F.when(field("o_orderpriority") != "5-LOW", field("o_orderpriority")).alias("o_orderpriority"),
    )
    return drop_missing(keyed, ["o_orderkey", "o_orderpriority"])


RAW_AND_CLEAN = f"""
  SELECT (SELECT COUNT(*) FROM customer) AS raw_rows, (SELECT COUNT(*) FROM ({CURATED_CUSTOMERS}) c) AS clean_rows
"""


@query(RAW_AND_CLEAN)
def raw_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both counts from the write itself."""
    workspace = new_workspace(spark, "raw-clean-counts")
    raw_rows, clean_rows = Observation(), Observation()
    shaped = shape(_raw_customers(spark, sf_dir, workspace), RULES)
    location = f"{workspace}/curated/customers"
    append_parquet(shaped, location, ["region"], written=clean_rows, arrived=raw_rows, required=RULES.keys)
    return spark.createDataFrame(
        [(raw_rows.get["rows"], clean_rows.get["rows"])], "raw_rows bigint, clean_rows bigint"
    )


@query(RAW_AND_CLEAN)
def raw_clean_counts_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both counts from one aggregate over the raw text, exact under task reruns."""
    raw = _raw_customers(spark, sf_dir, new_workspace(spark, "raw-clean-one-pass"))
    typed = apply_mapping(raw, RULES.mapping)
    return row_counts(typed, keys_present(typed, RULES.keys))


# Mixed types.

MIXED_EVENTS = """
  SELECT event_id, event_type, value,
         CASE event_type WHEN 'click' THEN user_id::VARCHAR
                         WHEN 'view' THEN value::VARCHAR
                         WHEN 'error' THEN NULL
                         ELSE event_type END AS payload, user_id
  FROM events
"""


@query(
    f"""
    SELECT event_id,
           CASE WHEN event_type = 'click' THEN user_id::INTEGER END AS payload_int,
           CASE WHEN event_type = 'view' THEN value END AS payload_double,
           CASE WHEN event_type NOT IN ('click', 'view') THEN payload END AS payload_string
    FROM ({MIXED_EVENTS}) mixed
    """
)
def resolve_make_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = field("event_type")
    mixed = _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", _text("user_id"))
        .when(kind == "view", _text("value"))
        .when(kind != "error", kind)
        .alias("payload"),
    )
    return make_columns(mixed, {"payload": ["string", "double", "int"]})


@query(
    """
    SELECT event_id,
           CASE WHEN event_type = 'signup' THEN value > 20 END AS payload_boolean,
           CASE WHEN event_type = 'click' THEN user_id::INTEGER END AS payload_int,
           CASE WHEN event_type = 'view' THEN floor(value) + 0.5 END AS payload_double,
           CASE WHEN event_type = 'purchase' THEN event_type END AS payload_string
    FROM events
    """
)
def resolve_variant_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed JSON values; which types occur is found in the data first."""
    kind = field("event_type")
    payload = (
        F.when(kind == "signup", _text(field("value") > 20))
        .when(kind == "click", _text("user_id"))
        .when(kind == "view", _text(F.floor("value") + F.lit(0.5)))
        .when(kind == "error", F.lit("null"))
        .otherwise(F.concat(F.lit('"'), kind, F.lit('"')))
    )
    mixed = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json(payload).alias("payload"))
    return resolve_choice(mixed, types=("boolean", "int", "double", "string"))


# Partitioned files, limits.


def _orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.to_date("o_orderdate").alias("o_orderdate"),
        "o_orderpriority",
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.date_format("o_orderdate", "MM").alias("month"),
    )


ORDERS_PER_MONTH = """
  SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, COUNT(*) AS cnt
  FROM orders GROUP BY 1, 2
"""


@query(ORDERS_PER_MONTH)
def partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = new_workspace(spark, "partitioned-roundtrip") + "/orders"
    append_parquet(_orders_by_month(spark, sf_dir), location, YEAR_MONTH)
    kept = scan_parquet(spark, location, "o_orderkey bigint, year string, month string")
    return grouped_count(kept, *YEAR_MONTH)


@query("SELECT * FROM (SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment) t LIMIT 10")
def region_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are fewer segments than the limit lets through, so the result is settled."""
    return first_rows(select_all(grouped_count(_table(spark, sf_dir, "customer"), "c_mktsegment")), 10)


@query("SELECT COUNT(*) AS cnt FROM (SELECT * FROM orders LIMIT 10) t")
def orders_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a limit gives is open, so only their number is compared."""
    return grouped_count(first_rows(select_all(_table(spark, sf_dir, "orders")), 10))


# Governance.

_LIMITED_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
_NOT_SENSITIVE = tuple(c for c in RULES.raw_columns if c != "ssn")


def _rules() -> AccessRules:
    return AccessRules(
        policies=[
            Policy("full", EVERY_TABLE),
            Policy("columns", "customer", _LIMITED_COLUMNS),
            Policy("rows", "customer", None, "c_mktsegment = 'BUILDING'"),
            Policy("cells", "customer", _LIMITED_COLUMNS, "c_mktsegment = 'BUILDING' AND c_acctbal > 0"),
            Policy("cells", "curated_customers", _NOT_SENSITIVE, "region = 'BUILDING'"),
        ],
        tag_policies=[TagPolicy("tagged", frozenset({"public", "internal"}))],
        tags=[
            ColumnTag("customer", "c_custkey", "public"),
            ColumnTag("customer", "c_name", "internal"),
            ColumnTag("customer", "c_acctbal", "confidential"),
            ColumnTag("customer", "c_mktsegment", "public"),
        ],
    )


def _governed(spark: SparkSession, sf_dir: str, principal: str) -> DataFrame:
    return govern(spark, _rules(), principal, "customer", _table(spark, sf_dir, "customer"))


@query(f"SELECT region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c GROUP BY region")
def footer_region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region count of the curated files, from their footers: no row is read."""
    location = f"{new_workspace(spark, 'footers')}/curated/customers"
    append_parquet(curate(_raw_customers(spark, sf_dir, new_workspace(spark, "footers-raw")), RULES), location, ("region",))
    return counts_from_footers(spark, location, "region")


@query("SELECT * FROM customer")
def governed_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_all(_governed(spark, sf_dir, "full"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def governed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "columns")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def governed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "rows")


@query(
    """
    SELECT c_mktsegment, COUNT(*) AS cnt FROM customer
    WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 GROUP BY c_mktsegment
    """
)
def governed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_count(_governed(spark, sf_dir, "cells"), "c_mktsegment")


@query(
    f"SELECT region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) curated WHERE region = 'BUILDING' GROUP BY region"
)
def governed_curated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restricted reader's count on the partitioned curated table."""
    curated = _curated_customers(spark, sf_dir, new_workspace(spark, "governed-curated"))
    return grouped_count(govern(spark, _rules(), "cells", "curated_customers", curated), "region")


@query(
    """
    SELECT 'c_custkey' AS column_name, 'bigint' AS data_type, COUNT(c_custkey) AS visible_values FROM customer
    UNION ALL SELECT 'c_name', 'string', COUNT(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', COUNT(c_nationkey) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', COUNT(c_mktsegment) FROM customer
    """
)
def governed_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What DESCRIBE shows, beside the number of values behind each column."""
    customer = _table(spark, sf_dir, "customer")
    described = describe_governed(spark, _rules(), "columns", "customer", customer)
    visible = _governed(spark, sf_dir, "columns")
    counted = visible.agg(*[F.count(field(c)).alias(c) for c in visible.columns])
    return described.join(counted.unpivot([], visible.columns, "column_name", "visible_values"), "column_name")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def governed_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "tagged")


# Discovery and catalog.


@query(
    """
    SELECT * FROM (
      SELECT 1 AS ordinal, 'o_orderkey' AS name,
             CASE WHEN MAX(o_orderkey) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type, FALSE AS is_partition
      FROM orders
      UNION ALL
      SELECT 2, 'o_custkey', CASE WHEN MAX(o_custkey) <= 2147483647 THEN 'int' ELSE 'bigint' END, FALSE FROM orders
      UNION ALL
      VALUES (3, 'o_orderstatus', 'string', FALSE), (4, 'o_totalprice', 'double', FALSE),
             (5, 'o_orderdate', 'date', FALSE), (6, 'o_orderpriority', 'string', FALSE),
             (7, 'year', 'string', TRUE), (8, 'month', 'string', TRUE)
    ) t
    """
)
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = new_workspace(spark, "infer-schema")
    location = f"{workspace}/raw/orders"
    _drop_csv(_orders_by_month(spark, sf_dir), location, YEAR_MONTH)
    found = discover(spark, location, f"{workspace}/state")
    schema = infer_columns(spark, found, YEAR_MONTH)
    return schema_rows(spark, schema, YEAR_MONTH)


SUPPLIERS_WITH_GAP = """
  SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 13 THEN NULL ELSE s_acctbal END AS s_acctbal
  FROM supplier
"""
_SUPPLIER_MAPPING = [
    ("s_suppkey", "string", "s_suppkey", "bigint"),
    ("s_name", "string", "s_name", "string"),
    ("s_nationkey", "string", "s_nationkey", "int"),
    ("s_acctbal", "string", "s_acctbal", "double"),
]


def _supplier_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier = _table(spark, sf_dir, "supplier")
    return supplier.where("s_nationkey < 13").drop("s_acctbal"), supplier.where("s_nationkey >= 13")


def _database(spark: SparkSession, workspace: str) -> str:
    name = "weirline_" + workspace.rsplit("-", 1)[1]
    create_database(spark, name, f"{workspace}/database")
    return name


@query(SUPPLIERS_WITH_GAP)
def merge_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated table gains a column with its second load."""
    workspace = new_workspace(spark, "merge-new-columns")
    table = f"{_database(spark, workspace)}.supplier"
    for part in _supplier_parts(spark, sf_dir):
        append_to_table(part, table, f"{workspace}/curated/supplier")
    return scan_table(spark, table)


@query(SUPPLIERS_WITH_GAP)
def merge_parquet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same drift read from the files alone."""
    location = new_workspace(spark, "merge-parquet-files") + "/curated/supplier"
    for part in _supplier_parts(spark, sf_dir):
        append_parquet(part, location)
    return scan_parquet(spark, location, merge_schema=True).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(SUPPLIERS_WITH_GAP)
def inherit_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw table gains a column; its older partition reads it as null."""
    workspace = new_workspace(spark, "inherit-from-table")
    location = f"{workspace}/raw/supplier"
    older, newer = _supplier_parts(spark, sf_dir)
    _drop_csv(older.select("*", F.lit("2025").alias("year"), F.lit("12").alias("month")), location, YEAR_MONTH)
    table = f"{_database(spark, workspace)}.supplier"
    register_raw_table(spark, table, location, older.columns, YEAR_MONTH)
    _drop_csv(newer.select("*", F.lit("2026").alias("year"), F.lit("01").alias("month")), location, YEAR_MONTH)
    found = discover(spark, location, f"{workspace}/state")
    update_raw_table(spark, table, [x.columns for x in found.layouts])
    rows = fit_to_table(read_layouts(spark, found, partitions=YEAR_MONTH), spark.table(table).schema)
    return apply_mapping(rows, _SUPPLIER_MAPPING)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def combine_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reordered headers beside files of another kind: only the former combine."""
    workspace = new_workspace(spark, "combine-compatible")
    location = f"{workspace}/raw"
    supplier = _table(spark, sf_dir, "supplier")
    _drop_csv(supplier.where("s_nationkey < 13"), location)
    _drop_csv(supplier.where("s_nationkey >= 13").select(*reversed(supplier.columns)), location)
    _drop_csv(_table(spark, sf_dir, "part"), location)
    found = discover(spark, location, f"{workspace}/state")
    wanted = next(g for g in group_compatible(found.layouts) if "s_suppkey" in g[0].columns)
    return apply_mapping(read_layouts(spark, found, wanted), _SUPPLIER_MAPPING)


def _registered_orders(spark: SparkSession, sf_dir: str, workspace: str) -> tuple[str, str, DataFrame]:
    location = f"{workspace}/raw/orders"
    orders = _orders_by_month(spark, sf_dir)
    _drop_csv(orders, location, YEAR_MONTH)
    table = f"{_database(spark, workspace)}.orders"
    register_raw_table(spark, table, location, [c for c in orders.columns if c not in YEAR_MONTH], YEAR_MONTH)
    register_partitions(spark, table)
    return table, location, orders


@query(
    f"SELECT 'year=' || year || '/month=' || month AS partition, cnt FROM ({ORDERS_PER_MONTH}) t",
    name="register_partitions",
)
def register_partitions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _, _ = _registered_orders(spark, sf_dir, new_workspace(spark, "register-partitions"))
    counted = grouped_count(scan_table(spark, table), *YEAR_MONTH).select(
        F.concat(F.lit("year="), field("year"), F.lit("/month="), field("month")).alias("partition"), "cnt"
    )
    return spark.sql(f"SHOW PARTITIONS {table}").join(counted, "partition")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = new_workspace(spark, "catalog-scan")
    table = f"{_database(spark, workspace)}.supplier"
    append_to_table(_table(spark, sf_dir, "supplier"), table, f"{workspace}/curated/supplier", ["s_nationkey"])
    return scan_table(spark, table)


@query(
    """
    SELECT DISTINCT 'year=' || strftime(o_orderdate, '%Y') || '/month=' || strftime(o_orderdate, '%m') AS partition
    FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
    """,
    name="deleted_partitions",
)
def deleted_partitions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months are registered, then the files are replaced by older months only."""
    table, location, orders = _registered_orders(spark, sf_dir, new_workspace(spark, "deleted-partitions"))
    _drop_csv(orders.where("o_orderdate < '2000-01-01'"), location, YEAR_MONTH, mode="overwrite")
    return deleted_partitions(spark, table, list_files(spark, location))


# Incremental ingest.

EVENT_RULES = CurateRules(
    mapping=(
        ("event_id", "string", "event_id", "bigint"),
        ("ts", "string", "ts", "timestamp_ntz"),
        ("user_id", "string", "user_id", "bigint"),
        ("event_type", "string", "event_type", "string"),
        ("value", "string", "value", "double"),
        ("props", "string", "props", "string"),
    ),
    dates=(),
    keys=("event_id",),
)
_EVENT_COLUMNS = EVENT_RULES.raw_columns


def _ingest_events(spark: SparkSession, sf_dir: str, workspace: str) -> tuple[DataFrame, list[int]]:
    """Two drops and three runs; the second run finds nothing new."""
    location, state = f"{workspace}/raw/events", f"{workspace}/state"
    table = f"{_database(spark, workspace)}.curated_events"
    events = _table(spark, sf_dir, "events").select(*[_text(c).alias(c) for c in _EVENT_COLUMNS])
    first_half = field("ts") < "2024-01-16"

    def run() -> int:
        stream = observe_rows(raw_stream(spark, location, _EVENT_COLUMNS), RAW_ROWS)
        curated = curate(stream, EVENT_RULES)
        return ingest_into(curated, state, f"{workspace}/curated/events", ["event_type"], table).raw_rows

    _drop_csv(events.where(first_half), location)
    rows = [run(), run()]
    _drop_csv(events.where(~first_half), location)
    rows.append(run())
    return scan_table(spark, table), rows


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _ = _ingest_events(spark, sf_dir, new_workspace(spark, "incremental-ingest"))
    return target.select(*_EVENT_COLUMNS)


@query(
    """
    SELECT 1 AS run, COUNT(*) AS new_rows FROM events WHERE ts < TIMESTAMP '2024-01-16'
    UNION ALL SELECT 2, 0
    UNION ALL SELECT 3, COUNT(*) FROM events WHERE ts >= TIMESTAMP '2024-01-16'
    """
)
def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _ingest_events(spark, sf_dir, new_workspace(spark, "incremental-runs"))
    return spark.createDataFrame(list(enumerate(rows, start=1)), "run int, new_rows bigint")


def _lake(spark: SparkSession, workspace: str, table: str, **overrides) -> JobConfig:
    config = JobConfig.for_lake(LakeNames("weirline_" + workspace.rsplit("-", 1)[1], workspace), table, **overrides)
    create_database(spark, config.source_database, f"{workspace}/database")
    register_raw_table(spark, config.source, f"{workspace}/raw/{table}", RULES.raw_columns, YEAR_MONTH)
    return config


@query(
    f"""
    SELECT 'customer' AS source, TRUE AS accepted, COUNT(*) AS rows_written FROM ({CURATED_CUSTOMERS}) c
    UNION ALL SELECT 'customer and supplier', FALSE, 0
    """
)
def discovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of raw customers, and one into which supplier files got mixed."""
    outcome = []
    alien = _table(spark, sf_dir, "supplier").withColumns({"year": F.lit("2026"), "month": F.lit("06")})
    for source in ("customer", "customer and supplier"):
        workspace = new_workspace(spark, "discovery-gate")
        config = _lake(spark, workspace, "customers")
        location = f"{workspace}/raw/customers"
        _drop_csv(_render_customers(spark, sf_dir), location, YEAR_MONTH)
        if source != "customer":
            _drop_csv(alien, location, YEAR_MONTH)
        try:
            outcome.append((source, True, run_arrivals(spark, config).counts.clean_rows))
        except DiscoveryFailed:
            outcome.append((source, False, 0))
    return spark.createDataFrame(outcome, "source string, accepted boolean, rows_written bigint")


@query(f"SELECT region, signup_date, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c GROUP BY region, signup_date")
def arrival_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole incremental job, run after each of two drops."""
    workspace = new_workspace(spark, "arrival-run")
    config = _lake(spark, workspace, "customers")
    customers = _render_customers(spark, sf_dir)
    for part in (customers.where("month = '04'"), customers.where("month = '05'")):
        _drop_csv(part, f"{workspace}/raw/customers", YEAR_MONTH)
        run_arrivals(spark, config)
    return grouped_count(scan_table(spark, config.target), "region", "signup_date")


@query(f"SELECT region, signup_date, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c GROUP BY region, signup_date")
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch job, from a registered raw table to a curated one."""
    workspace = new_workspace(spark, "batch-run")
    config = _lake(spark, workspace, "customers", bookmark=False)
    _drop_csv(_render_customers(spark, sf_dir), f"{workspace}/raw/customers", YEAR_MONTH)
    run_batch(spark, config)
    return grouped_count(scan_table(spark, config.target), "region", "signup_date")


_COUNTED = f"SELECT region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c GROUP BY region"


@query(_COUNTED)
def batch_run_after_a_late_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month that arrives after the table was registered is curated as well."""
    workspace = new_workspace(spark, "batch-late-month")
    config = _lake(spark, workspace, "customers", bookmark=False)
    customers = _render_customers(spark, sf_dir)
    _drop_csv(customers.where("month = '04'"), f"{workspace}/raw/customers", YEAR_MONTH)
    register_partitions(spark, config.source)
    _drop_csv(customers.where("month = '05'"), f"{workspace}/raw/customers", YEAR_MONTH)
    run_batch(spark, config)
    return grouped_count(scan_table(spark, config.target), "region")


@query(
    f"""
    SELECT 'refused' AS what, 0 AS rows_written
    UNION ALL SELECT 'repaired', COUNT(*) FROM ({CURATED_CUSTOMERS}) c
    """
)
def batch_reordered_after_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with swapped columns, after one with an added column, stops the batch job until it is repaired."""
    workspace = new_workspace(spark, "batch-reordered")
    config = _lake(spark, workspace, "customers", bookmark=False, added_columns=True)
    return _refused_then_repaired(spark, sf_dir, config, workspace, lambda: run_batch(spark, config).clean_rows)


@query(
    f"""
    SELECT 'refused' AS what, 0 AS rows_written
    UNION ALL SELECT 'repaired', COUNT(*) FROM ({CURATED_CUSTOMERS}) c
    """
)
def late_reordered_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the incremental job: nothing is written, and the run after the repair is complete."""
    workspace = new_workspace(spark, "late-reordered")
    config = _lake(spark, workspace, "customers", added_columns=True)
    return _refused_then_repaired(spark, sf_dir, config, workspace, lambda: run_arrivals(spark, config).counts.clean_rows)


def _refused_then_repaired(
    spark: SparkSession, sf_dir: str, config: JobConfig, workspace: str, run: Callable[[], int]
) -> DataFrame:
    location = f"{workspace}/raw/customers"
    customers = _render_customers(spark, sf_dir)
    april, may = customers.where("month = '04'"), customers.where("month = '05'")
    first, second, *rest = RULES.raw_columns
    _drop_csv(april.select(*RULES.raw_columns, F.lit("x").alias("added"), *YEAR_MONTH), location, YEAR_MONTH)
    _drop_csv(may.select(second, first, *rest, *YEAR_MONTH), location, YEAR_MONTH)
    outcome = []
    for what in ("refused", "repaired"):
        if what == "repaired":
            wide = april.select(*RULES.raw_columns, F.lit("x").alias("added"), *YEAR_MONTH)
            _drop_csv(wide, location, YEAR_MONTH, mode="overwrite")
            _drop_csv(may, location, YEAR_MONTH)
        try:
            run()
        except DiscoveryFailed:
            pass
        written = spark.table(config.target).count() if spark.catalog.tableExists(config.target) else 0
        outcome.append((what, written))
    return spark.createDataFrame(outcome, "what string, rows_written bigint")


@query("SELECT DISTINCT 'region=' || COALESCE(region, '__HIVE_DEFAULT_PARTITION__') AS partition FROM"
       f" ({CURATED_CUSTOMERS}) c")  # fmt: skip
def incremental_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog knows the partitions of an incremental target."""
    workspace = new_workspace(spark, "incremental-partitions")
    config = _lake(spark, workspace, "customers")
    customers = _render_customers(spark, sf_dir)
    for part in (customers.where("month = '04'"), customers.where("month = '05'")):
        _drop_csv(part, f"{workspace}/raw/customers", YEAR_MONTH)
        run_arrivals(spark, config)
    shown = spark.sql(f"SHOW PARTITIONS {config.target}")
    return shown.select(F.split_part("partition", F.lit("/"), F.lit(1)).alias("partition")).distinct()


@query(
    f"""
    SELECT region, COUNT(*) AS cnt, SUM(customer_id)::BIGINT AS ids, 1 AS batches FROM ({CURATED_CUSTOMERS}) c GROUP BY region
    """
)
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small batches, merged by the job into one partition a region: the same rows, by the table's name."""
    workspace = new_workspace(spark, "merged-batches")
    config = _lake(spark, workspace, "customers", max_files=1, merge_batches=2)
    customers = _render_customers(spark, sf_dir)
    for n in range(2):
        _drop_csv(customers.where(F.pmod(F.hash("ssn"), F.lit(2)) == n), f"{workspace}/raw/customers", YEAR_MONTH)
    run_arrivals(spark, config)
    shown = spark.sql(f"SHOW PARTITIONS {config.target}").select(F.split_part("partition", F.lit("/"), F.lit(1)).alias("p"))
    named = F.concat(F.lit("region="), F.coalesce("region", F.lit("__HIVE_DEFAULT_PARTITION__")))
    curated = scan_table(spark, config.target).groupBy("region", named.alias("p"))
    rows = curated.agg(F.count("*").alias("cnt"), F.sum("customer_id").alias("ids"))
    return rows.join(shown.groupBy("p").agg(F.count("*").cast("int").alias("batches")), "p").drop("p")


@query(
    """
    SELECT job, COUNT(*) AS rows_read FROM customer, (VALUES ('arrivals'), ('batch')) j(job) GROUP BY job
    """
)
def every_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of any name, packed or not, at any depth, in both jobs."""
    outcome = []
    for job in ("arrivals", "batch"):
        workspace = new_workspace(spark, "every-file")
        names = LakeNames("weirline_" + workspace.rsplit("-", 1)[1], workspace)
        config = JobConfig.for_lake(names, "customers", bookmark=job == "arrivals")
        create_database(spark, config.source_database, f"{workspace}/database")
        location = f"{workspace}/raw/customers"
        register_raw_table(spark, config.source, location, RULES.raw_columns)
        customers = _render_customers(spark, sf_dir).select(*RULES.raw_columns, F.hash("ssn").alias("h"))
        for n, (folder, packed) in enumerate([("", "none"), ("", "gzip"), ("/sub", "none"), ("/sub/Deep.D", "gzip")]):
            part = customers.where(F.pmod("h", F.lit(4)) == n).drop("h")
            # Below the folder of an append, names end in .csv or .csv.gz.
            part.write.mode("append").option("header", "true").option("compression", packed).csv(location + folder)
        counts = run_arrivals(spark, config).counts if job == "arrivals" else run_batch(spark, config)
        outcome.append((job, counts.raw_rows))
    return spark.createDataFrame(outcome, "job string, rows_read bigint")


@query(
    f"""
    SELECT zone, region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c, (VALUES ('cleaned'), ('curated')) z(zone)
    GROUP BY zone, region
    """
)
def both_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental job with a cleaned zone: both hold the same rows."""
    workspace = new_workspace(spark, "both-zones")
    config = _lake(spark, workspace, "customers", cleaned_path=f"{workspace}/cleaned/customers")
    _drop_csv(_render_customers(spark, sf_dir), f"{workspace}/raw/customers", YEAR_MONTH)
    run_arrivals(spark, config)
    cleaned = scan_parquet(spark, config.cleaned_path, "region string, year string, month string")
    zones = [("cleaned", cleaned), ("curated", scan_table(spark, config.target))]
    counted = [grouped_count(df, "region").select(F.lit(zone).alias("zone"), "region", "cnt") for zone, df in zones]
    return counted[0].unionByName(counted[1])


# Lines that do not fit their header: every customer whose nation leaves 0 to 2 when divided by 7.

_BROKEN = """
  SELECT *, CASE c_nationkey % 7 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'unclosed quote' END AS kind,
         CASE c_nationkey % 7
              WHEN 0 THEN c_custkey::VARCHAR || ',' || c_name
              WHEN 1 THEN c_custkey::VARCHAR || ',' || c_name || ',' || c_nationkey::VARCHAR || ',' || c_mktsegment || ',more'
              WHEN 2 THEN c_custkey::VARCHAR || ',"' || c_name || ',' || c_nationkey::VARCHAR || ',' || c_mktsegment
              ELSE c_custkey::VARCHAR || ',' || c_name || ',' || c_nationkey::VARCHAR || ',' || c_mktsegment END AS line
  FROM customer
"""
_BROKEN_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
_BROKEN_RULES = CurateRules(
    mapping=(
        ("c_custkey", "string", "c_custkey", "bigint"),
        ("c_name", "string", "c_name", "string"),
        ("c_nationkey", "string", "c_nationkey", "int"),
        ("c_mktsegment", "string", "region", "string"),
    ),
    dates=(),
    keys=("c_custkey",),
)


def _broken_lake(spark: SparkSession, sf_dir: str, workspace: str, **overrides) -> JobConfig:
    """Raw customers by nation, some lines too short, too long, or with a quote that stays open."""
    names = LakeNames("weirline_" + workspace.rsplit("-", 1)[1], workspace)
    config = JobConfig.for_lake(names, "customers", rules=_BROKEN_RULES, bookmark=False, **overrides)
    create_database(spark, config.source_database, f"{workspace}/database")
    location = names.raw("customers")
    register_raw_table(spark, config.source, location, _BROKEN_COLUMNS, ("nation",))
    columns = [_text(c) for c in _BROKEN_COLUMNS]
    nation = field("c_nationkey") % 7
    second = F.when(nation == 2, F.concat(F.lit('"'), columns[1])).otherwise(columns[1])
    short = F.concat_ws(",", columns[0], second)
    line = F.when(nation == 0, short).otherwise(F.concat_ws(",", short, *columns[2:], F.when(nation == 1, F.lit("more"))))
    # One file a nation, with the header line on top and the lines in order below.
    lines = _table(spark, sf_dir, "customer").select(_text("c_nationkey").alias("nation"), line.alias("value"), field("c_custkey").alias("at"))
    headers = lines.select("nation", F.lit(",".join(_BROKEN_COLUMNS)).alias("value"), F.lit(-1).cast("bigint").alias("at")).distinct()
    whole = lines.unionByName(headers).repartition("nation").sortWithinPartitions("nation", "at")
    whole.select("nation", "value").write.partitionBy("nation").text(location)
    return config


@query(
    f"""
    SELECT 'nation=' || c_nationkey::VARCHAR AS folder,
           1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, kind, line AS text
    FROM ({_BROKEN}) b QUALIFY kind IS NOT NULL
    """
)
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not fit their header, by file and line number, as the batch job sets them aside."""
    workspace = new_workspace(spark, "quarantine")
    config = _broken_lake(spark, sf_dir, workspace, quarantine_path=f"{workspace}/quarantine/customers")
    run_batch(spark, config)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")
    return scan_parquet(spark, config.quarantine_path).select(folder, "line", "kind", "text")


@query(
    f"""
    SELECT c_mktsegment AS region, COUNT(*) AS cnt, MAX(c_custkey) AS newest,
           (SELECT COUNT(*) FROM ({_BROKEN}) f WHERE kind IS NOT NULL) AS faults
    FROM ({_BROKEN}) b WHERE kind IS NULL GROUP BY c_mktsegment
    """
)
def faults_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated rows beside them, and their number, from one pass."""
    config = _broken_lake(spark, sf_dir, new_workspace(spark, "faults"))
    faults = run_batch(spark, config).faults
    counted = scan_table(spark, config.target).groupBy("region")
    counted = counted.agg(F.count(F.lit(1)).alias("cnt"), F.max("c_custkey").alias("newest"))
    return counted.withColumn("faults", F.lit(faults).cast("bigint"))


@query(
    """
    SELECT l_returnflag, l_linestatus, l_quantity::INTEGER % 40 AS layout, COUNT(*) AS cnt,
           COUNT(l_shipdate) AS shipped, SUM(l_orderkey)::BIGINT AS orders, MAX(l_partkey) AS part
    FROM lineitem GROUP BY ALL
    """
)
def forty_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty column orders in one folder, too many for a scan each: one scan looks headers up."""
    workspace = new_workspace(spark, "forty-layouts")
    names = ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]
    lines = _table(spark, sf_dir, "lineitem").select(
        (field("l_quantity").cast("int") % 40).alias("layout"), *[_text(c).alias(c) for c in names]
    )
    # Layout k starts with its own column, and then has the others turned by k places, and back to front if k is large.
    orders = []
    for k in range(40):
        turned = names[k % 6 :] + names[: k % 6]
        orders.append(turned[::-1] if k >= 20 else turned)
    tagged = [F.concat_ws(",", *[field(c) for c in order], F.lit(str(k))) for k, order in enumerate(orders)]
    line = F.element_at(F.array(*tagged), field("layout") + 1)
    heads = spark.createDataFrame([(k, ",".join(order) + f",tag_{k}", -1) for k, order in enumerate(orders)], "layout int, value string, at int")
    heads = heads.join(lines.select("layout").distinct(), "layout").unionByName(lines.select("layout", line.alias("value"), F.lit(0).alias("at")))
    ordered = heads.repartition("layout").sortWithinPartitions("layout", "at")
    ordered.select("layout", "value").write.partitionBy("layout").text(f"{workspace}/raw")
    found = discover(spark, f"{workspace}/raw", f"{workspace}/state")
    rows = read_layouts(spark, found, partitions=("layout",))
    return rows.groupBy("l_returnflag", "l_linestatus", field("layout").cast("int").alias("layout")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count("l_shipdate").alias("shipped"),
        F.sum(field("l_orderkey").cast("bigint")).alias("orders"),
        F.max(field("l_partkey").cast("bigint")).alias("part"),
    )


@query(
    """
    SELECT c_custkey,
           CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END AS code,
           CASE WHEN c_custkey % 2 = 1 AND c_nationkey % 3 = 0 THEN c_nationkey END AS code_int,
           CASE WHEN c_custkey % 2 = 1 AND c_nationkey % 3 = 1 THEN c_nationkey + 0.5::DOUBLE END AS code_double,
           CASE WHEN c_custkey % 2 = 1 AND c_nationkey % 3 = 2 THEN 'n' || c_nationkey::VARCHAR END AS code_string
    FROM customer
    """
)
def choice_in_the_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that turns mixed with the second drop: its types become columns of the target."""
    workspace = new_workspace(spark, "choice")
    rules = CurateRules(
        mapping=(("c_custkey", "string", "c_custkey", "bigint"), ("code", "string", "code", "string")),
        dates=(),
        keys=("c_custkey",),
    )
    names = LakeNames("weirline_" + workspace.rsplit("-", 1)[1], workspace)
    config = JobConfig.for_lake(names, "codes", rules=rules, partition_keys=(), choice_columns=("code",))
    create_database(spark, config.source_database, f"{workspace}/database")
    register_raw_table(spark, config.source, names.raw("codes"), ("c_custkey", "code"))
    number = field("c_nationkey")
    mixed = F.when(number % 3 == 0, number.cast("string")).when(number % 3 == 1, F.concat(number, F.lit(".5")))
    customer = _table(spark, sf_dir, "customer")
    for odd, code in ((0, number.cast("string")), (1, mixed.otherwise(F.concat(F.lit("n"), number)))):
        _drop_csv(customer.where(field("c_custkey") % 2 == odd).select(_text("c_custkey").alias("c_custkey"), code.alias("code")), names.raw("codes"))
        run_arrivals(spark, config)
    return scan_table(spark, config.target).select("c_custkey", "code", "code_int", "code_double", "code_string")


@query(
    """
    SELECT o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY o_orderstatus
    """
)
def crawl_and_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to a query by name; no column is named before."""
    workspace = new_workspace(spark, "crawl")
    location = f"{workspace}/raw/orders"
    _drop_csv(_orders_by_month(spark, sf_dir), location, YEAR_MONTH)
    table = f"{_database(spark, workspace)}.orders"
    register_discovered(spark, discover(spark, location, f"{workspace}/state"), table)
    return spark.sql(f"SELECT o_orderstatus, COUNT(*) AS cnt FROM {table} GROUP BY o_orderstatus")


@query(
    """
    SELECT 'first' AS run, COUNT(*) AS rows_read, CASE WHEN MAX(o_custkey) FILTER (WHERE early) <= 2147483647 THEN 'int'
           ELSE 'bigint' END AS type_of_customer, COUNT(DISTINCT strftime(o_orderdate, '%Y-%m')) AS partitions
    FROM (SELECT *, o_orderdate < TIMESTAMP '2000-01-01' AS early FROM orders) o WHERE early
    UNION ALL
    SELECT 'second', COUNT(*), 'string', (SELECT COUNT(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders)
    FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
    """
)
def crawl_what_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls of a growing table: the second reads only new files, and merges their types with what is known."""
    workspace = new_workspace(spark, "crawl-new")
    location = f"{workspace}/raw/orders"
    table = f"{_database(spark, workspace)}.orders"
    orders = _orders_by_month(spark, sf_dir)
    old = field("o_orderdate") < "2000-01-01"
    # From 2000 on customers are named by letters.
    newer = orders.where(~old).withColumn("o_custkey", F.concat(F.lit("c"), "o_custkey"))
    outcome = []
    for run, drop in (("first", orders.where(old)), ("second", newer)):
        _drop_csv(drop, location, YEAR_MONTH)
        read = Observation()
        found = discover(spark, location, f"{workspace}/state")
        rows = register_discovered(spark, found, table, read)
        types = {r["name"]: r["type"] for r in rows.collect()}
        partitions = spark.sql(f"SHOW PARTITIONS {table}").count()
        outcome.append((run, read.get["rows"], types["o_custkey"], partitions))
    return spark.createDataFrame(outcome, "run string, rows_read bigint, type_of_customer string, partitions bigint")


@query(
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
    GROUP BY 1 HAVING FALSE
    """
)
def partition_of_an_empty_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition that holds only an empty file is not reported as gone."""
    workspace = new_workspace(spark, "empty-file")
    table, location, orders = _registered_orders(spark, sf_dir, workspace)
    newest = orders.where("o_orderdate >= '2001-01-01'")
    _drop_csv(orders.where("o_orderdate < '2001-01-01'"), location, YEAR_MONTH, mode="overwrite")
    # Files of one empty line each stand where the newest months were.
    empty = newest.select(F.lit("").alias("value"), *YEAR_MONTH).distinct()
    empty.write.mode("append").partitionBy(*YEAR_MONTH).text(location)
    gone = deleted_partitions(spark, table, list_files(spark, location))
    return gone.select(F.col("partition").alias("month"))


# Further sinks.


@query("SELECT c_mktsegment, COUNT(*) AS cnt FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_mktsegment")
def governed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restricted analyst's SQL text, its result read back from the store."""
    workspace = new_workspace(spark, "governed-sql")
    table = f"{_database(spark, workspace)}.customer"
    append_to_table(_table(spark, sf_dir, "customer"), table, f"{workspace}/curated/customer")
    rules = AccessRules([Policy("rows", table, None, "c_mktsegment = 'BUILDING'")])
    store = ResultStore(f"{workspace}/results")
    text = "SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment"
    location = answer(spark, rules, "rows", table, text, store, "segments")
    return store.read(spark, location, "c_mktsegment string, cnt bigint")


@query(f"SELECT region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c WHERE region = 'BUILDING' GROUP BY region")
def governed_full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restricted analyst's count on the curated table, by its full name in the text."""
    workspace = new_workspace(spark, "governed-full-name")
    database = _database(spark, workspace)
    curated = curate(_raw_customers(spark, sf_dir, workspace), RULES)
    append_to_table(curated, f"{database}.curated_customers", f"{workspace}/curated/customers", ("region",))
    rules = AccessRules([Policy("bob", f"{database}.curated_customers", _NOT_SENSITIVE, "region = 'BUILDING'")])
    text = f"SELECT region, COUNT(*) as cnt\nFROM {database}.curated_customers\nGROUP BY region;"
    return run_governed(spark, rules, "bob", text)


@query(
    """
    SELECT o_orderpriority, COUNT(*) AS orders, COUNT(DISTINCT c_custkey) AS customers, MAX(o_totalprice) AS largest
    FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'P'
      AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    GROUP BY o_orderpriority
    """
)
def governed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several governed tables in one text: a common table expression, a join and a subquery."""
    workspace = new_workspace(spark, "governed-join")
    database = _database(spark, workspace)
    for name in ("customer", "orders", "nation"):
        append_to_table(_table(spark, sf_dir, name), f"{database}.{name}", f"{workspace}/curated/{name}")
    rules = AccessRules(
        [
            Policy("analyst", f"{database}.customer", ("c_custkey", "c_nationkey"), "c_mktsegment = 'BUILDING'"),
            Policy("analyst", f"{database}.orders", None, "o_orderstatus <> 'P'"),
            Policy("analyst", f"{database}.nation", ("n_nationkey", "n_regionkey")),
        ]
    )
    text = f"""
        WITH customer AS (
          SELECT * FROM {database}.customer
          WHERE c_nationkey IN (SELECT n_nationkey FROM {database}.nation WHERE {database}.nation.n_regionkey = 1)
        )
        SELECT o_orderpriority, COUNT(*) AS orders, COUNT(DISTINCT c_custkey) AS customers, MAX(o_totalprice) AS largest
        FROM customer JOIN {database}.orders o ON c_custkey = o.o_custkey GROUP BY o_orderpriority
    """
    return run_governed(spark, rules, "analyst", text)


@query("SELECT c_mktsegment, c_nationkey, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment, c_nationkey")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = new_workspace(spark, "result-sink")
    table = f"{_database(spark, workspace)}.customer"
    append_to_table(_table(spark, sf_dir, "customer"), table, f"{workspace}/curated/customer")
    store = ResultStore(f"{workspace}/results")
    location = answer(
        spark,
        _rules(),
        "full",
        table,
        lambda frame: grouped_count(frame, "c_mktsegment", "c_nationkey"),
        store,
        "segment-counts",
    )
    return store.read(spark, location, "c_mktsegment string, c_nationkey int, cnt bigint")


@query(
    f"""
    SELECT year, month, region, COUNT(*) AS cnt FROM ({CURATED_CUSTOMERS}) c GROUP BY year, month, region
    """
)
def cleaned_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = new_workspace(spark, "cleaned-zone")
    location = f"{workspace}/cleaned/customers"
    cleaned = curate(_raw_customers(spark, sf_dir, workspace), RULES, YEAR_MONTH)
    append_parquet(cleaned, location, YEAR_MONTH)
    kept = scan_parquet(spark, location, "region string, year string, month string")
    return grouped_count(kept, "year", "month", "region")
