"""Table and file scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def raw_csv_options(check_header: bool = True) -> dict[str, str]:
    """Reader options shared by batch and stream reads of raw files.

    With ``check_header`` each task compares the header line of the files it
    opens with the schema, so a reordered file fails instead of binding values
    to the wrong names.
    """
    return {"header": "true", "enforceSchema": str(not check_header).lower()}


def literal_path(path: str) -> str:
    """A path that Spark takes as it stands, whatever signs of a pattern it holds."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def scan_raw_csv(
    spark: SparkSession,
    location: str | Sequence[str],
    columns: Sequence[str],
    partition_columns: Sequence[str] = (),
    base_path: str | None = None,
    pattern: str = "*",
    nested: bool = False,
) -> DataFrame:
    """Raw CSV as text columns. Nothing is inferred: ``month=04`` stays ``04``.

    ``nested`` reads folders of any name below a location too; it is for files
    without partition columns, whose folders mean nothing.
    """
    reader = spark.read.schema(text_schema([*columns, *partition_columns])).options(**raw_csv_options())
    reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(nested).lower())
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    return reader.csv(location if isinstance(location, str) else list(location))


def scan_parquet(
    spark: SparkSession, location: str, schema: StructType | str | None = None, merge_schema: bool = False
) -> DataFrame:
    """Parquet files, with the partition columns of their directories.

    Pass ``schema`` where partition values must keep their text. With
    ``merge_schema`` columns that only later files have are added; every footer
    is then read, and a type conflict between files is an error.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("mergeSchema", str(merge_schema).lower()).parquet(location)
