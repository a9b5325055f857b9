"""Databases, raw tables and their partitions in Spark's catalog."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weirline.catalog.kinds import infer_known
from weirline.catalog.names import quoted, quoted_column, text_literal, unescaped
from weirline.catalog.partitions import PartitionLedger
from weirline.functions import field
from weirline.sources.files import partition_columns, require_depth
from weirline.sources.layouts import Discovery, infer_columns, merged_columns


def create_database(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)} LOCATION {text_literal(location)}")


def register_raw_table(
    spark: SparkSession,
    table: str,
    location: str,
    columns: Sequence[str],
    partition_columns: Sequence[str] = (),
) -> None:
    """External table of text columns over CSV files that have a header line.

    Partition columns are text as well, so that ``month=04`` stays ``04``. CSV
    columns bind by position, so reading tasks compare each header line with the
    table and fail where they differ.
    """
    fields = ", ".join(f"{quoted_column(c)} STRING" for c in (*columns, *partition_columns))
    partitioned = (
        f"PARTITIONED BY ({', '.join(quoted_column(c) for c in partition_columns)})" if partition_columns else ""
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({fields}) USING csv "
        f"OPTIONS (header 'true', enforceSchema 'false') {partitioned} LOCATION {text_literal(location)}"
    )


class RawTable(NamedTuple):
    location: str
    columns: list[str]
    partition_columns: list[str]


def describe_raw_table(spark: SparkSession, table: str) -> RawTable:
    names = spark.table(table).columns
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").collect()
    # The columns come first; partition columns are then listed again, and the
    # table's details follow, each under a heading.
    headings = [r.col_name for r in rows]
    details = headings.index("# Detailed Table Information", len(names))
    location = next(r.data_type for r in rows[details:] if r.col_name == "Location")
    again = set(headings[len(names) : details])
    return RawTable(location, [c for c in names if c not in again], [c for c in names if c in again])


def register_partitions(spark: SparkSession, table: str) -> None:
    """Add the partitions found under the table's location; none is ever dropped."""
    spark.sql(f"MSCK REPAIR TABLE {quoted(table)} ADD PARTITIONS")


def add_new_columns(spark: SparkSession, table: str, incoming: StructType) -> list[str]:
    """Add columns that the table lacks; existing columns keep their type."""
    known = {c.lower() for c in spark.table(table).columns}
    new = [f for f in incoming.fields if f.name.lower() not in known]
    if new:
        listed = ", ".join(f"{quoted_column(f.name)} {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {quoted(table)} ADD COLUMNS ({listed})")
    return [f.name for f in new]


def fit_to_table(df: DataFrame, schema: StructType, beside: Sequence[str] = ()) -> DataFrame:
    """Columns in table order, those the frame lacks null, and then the ones ``beside`` them."""
    present = {c.lower(): c for c in df.columns if c not in beside}

    def fitted(f: StructField):
        if f.name.lower() in present:
            return field(present[f.name.lower()]).alias(f.name)
        return F.lit(None).cast(f.dataType).alias(f.name)

    extra = sorted(set(present) - {f.name.lower() for f in schema.fields})
    if extra:
        raise ValueError(f"the table has no columns {extra}; add them first")
    return df.select(*[fitted(f) for f in schema.fields], *[field(c) for c in beside])


def update_raw_table(
    spark: SparkSession, table: str, layouts: Sequence[Sequence[str]], register: bool = True
) -> list[str]:
    """Bring a registered raw table up to date with the header lines found.

    New columns are added after the existing ones, and new partitions are
    registered; a file without a newer column reads it as null. Files whose
    columns are not the first columns of the table, in table order, are refused
    here, since the table would bind their values to the wrong names; read those
    with ``weirline.sources.read_layouts``. The table itself never binds values
    without comparing headers: a scan of it fails as long as its files' headers
    differ in length, and ``read_layouts`` reads those too. Partitions are found by a
    listing, unless a ``PartitionLedger`` takes them from a listing that is at hand
    (``register=False``).
    """
    _, columns, partitions = describe_raw_table(spark, table)
    longest = max(layouts, key=len, default=columns)
    merged = columns + list(longest[len(columns) :])
    for layout in layouts:
        if list(layout) != merged[: len(layout)]:
            raise ValueError(f"files with header {list(layout)} do not fit table columns {merged}")
    added = StructType([StructField(c, StringType()) for c in merged[len(columns) :]])
    new = add_new_columns(spark, table, added)
    if partitions and register:
        register_partitions(spark, table)
    return new


def register_discovered(
    spark: SparkSession, found: Discovery, table: str, read: Observation | None = None
) -> DataFrame:
    """Create the table of what was discovered, or bring it up to date; gives its schema as rows.

    The table has text columns, named by the header lines, and the partitions of the
    folders. The rows tell the types that the values have. What a discovery with state
    learned before is not read or listed again; ``read`` observes the rows that are.
    """
    partitions = partition_columns(found.headers)
    require_depth(found.headers, found.location, partitions)
    if not spark.catalog.tableExists(table):
        register_raw_table(spark, table, found.location, merged_columns(found.layouts), partitions)
    update_raw_table(spark, table, [x.columns for x in found.layouts], register=found.state_path is None)
    if found.state_path is None:
        return schema_rows(spark, infer_columns(spark, found, partitions), partitions)
    if partitions:
        PartitionLedger(spark, f"{found.state_path}/partitions", table, found.location).register(found.headers)
    return schema_rows(spark, infer_known(spark, found, found.state_path, partitions, read), partitions)


def deleted_partitions(spark: SparkSession, table: str, files: DataFrame) -> DataFrame:
    """Registered partitions to which none of the listed ``files`` belongs.

    A report: the catalog is left as it is. Both sides are names of partitions,
    not data.
    """
    registered = spark.sql(f"SHOW PARTITIONS {quoted(table)}")
    name = unescaped("partition").alias("name")
    listed = files.select(name).distinct()
    return registered.select("partition", name).join(listed, "name", "left_anti").select("partition")


def schema_rows(spark: SparkSession, schema: StructType, partition_columns: Sequence[str] = ()) -> DataFrame:
    """A schema as rows of ``ordinal, name, type, is_partition``."""
    return spark.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), f.name in partition_columns)
            for i, f in enumerate(schema.fields, start=1)
        ],
        "ordinal int, name string, type string, is_partition boolean",
    )
