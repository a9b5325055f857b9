"""Partitioned Parquet sinks, with and without a catalog table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weirline.catalog import add_new_columns, fit_to_table
from weirline.functions import field
from weirline.operators.cleaning import drop_missing
from weirline.operators.counts import observe_rows
from weirline.sources.records import FAULT

_COMPRESSION = "snappy"
_SALT = "__weirline_salt"

#: The last partition column of a target that is filled batch by batch.
BATCH_COLUMN = "ingest_batch"


def _adaptive(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    settings = ["spark.sql.adaptive.enabled", "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled"]
    if df.isStreaming:
        settings.append("spark.sql.adaptive.streaming.stateless.enabled")
    return all(conf.get(s) == "true" for s in settings)


def spread_for_partitions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring rows of one partition value together, without making one task hold them.

    Adaptive execution splits a large value over many tasks and merges small ones
    into one, by measured size. Where it is off, each value is spread over a
    third of the shuffle partitions, by the reading task a row comes from: a value
    that holds a third of all rows then gives each task its even share, and so
    does one row that occurs over and over. A rerun after a lost executor sends
    each row to the same place again.
    """
    if not keys:
        return df
    columns = [field(k) for k in keys]
    if _adaptive(df):
        return df.hint("rebalance", *columns)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.spark_partition_id(), F.lit(-(-partitions // 3)))
    return df.withColumn(_SALT, salt).repartition(partitions, *columns, field(_SALT)).drop(_SALT)


def prepare_write(
    df: DataFrame,
    keys: Sequence[str],
    rebalance: bool = True,
    written: Observation | str | None = None,
    arrived: Observation | str | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Spread rows for a partitioned write, drop those without ``required`` values, and count them.

    Rows are counted after the shuffle, before (``arrived``) and after the drop, so
    each is counted once, whichever tasks Spark has to run again. Only then the
    dropped rows are shuffled too. Rows with a ``FAULT`` are dropped as well, and
    counted among those that arrived, as ``faults``.
    """
    if rebalance:
        df = spread_for_partitions(df, keys)
    faulty = {"faults": F.col(FAULT).isNotNull()} if FAULT in df.columns else {}
    if arrived is not None:
        df = observe_rows(df, arrived, **faulty)
    if faulty:
        df = df.where(F.col(FAULT).isNull()).drop(FAULT)
    if required:
        df = drop_missing(df, required)
    return df if written is None else observe_rows(df, written)


def append_parquet(
    df: DataFrame,
    location: str,
    keys: Sequence[str] = (),
    rebalance: bool = True,
    written: Observation | None = None,
    arrived: Observation | None = None,
    required: Sequence[str] = (),
) -> None:
    """Append files. Without ``rebalance`` nothing is shuffled: each task writes
    one file per partition value it meets, which suits few values and large tasks.
    """
    df = prepare_write(df, keys, rebalance, written, arrived, required)
    writer = df.write.mode("append").option("compression", _COMPRESSION)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(location)


def append_to_table(
    df: DataFrame,
    table: str,
    location: str | None = None,
    keys: Sequence[str] = (),
    rebalance: bool = True,
    written: Observation | None = None,
    arrived: Observation | None = None,
    required: Sequence[str] = (),
) -> None:
    """Append and update the catalog: create the table, or add what it lacks.

    Columns the table does not have are added; columns the frame does not have
    are written as null. Needs a table written by this function only, not one
    that a stream writes.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        add_new_columns(spark, table, df.drop(FAULT).schema)
        df = fit_to_table(df, spark.table(table).schema, _beside(df))
    df = prepare_write(df, keys, rebalance, written, arrived, required)
    writer = df.write.format("parquet").mode("append")
    writer = writer.option("compression", _COMPRESSION)
    if keys:
        writer = writer.partitionBy(*keys)
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(table)


def _beside(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == FAULT]


def _prepared_batch(df, keys, rebalance, counted, required) -> DataFrame:
    arrived, written = counted or (None, None)
    return prepare_write(df, keys, rebalance, written, arrived, required)


_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def replace_batch(
    df: DataFrame,
    location: str,
    keys: Sequence[str] = (),
    rebalance: bool = True,
    counted: tuple[Observation, Observation] | None = None,
    required: Sequence[str] = (),
) -> None:
    """Write one batch, replacing what the same batch wrote before.

    The frame has the number of the batch in ``BATCH_COLUMN``. ``counted`` takes the
    rows before and after those without ``required`` values are dropped.
    """
    df = _prepared_batch(df, keys, rebalance, counted, required)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", _COMPRESSION)
    writer.partitionBy(*keys, BATCH_COLUMN).parquet(location)


def replace_batch_in_table(
    df: DataFrame,
    table: str,
    location: str | None = None,
    keys: Sequence[str] = (),
    rebalance: bool = True,
    counted: tuple[Observation, Observation] | None = None,
    required: Sequence[str] = (),
) -> None:
    """The same for a catalog table, whose partitions are registered as they are written."""
    spark = df.sparkSession
    schema = df.drop(FAULT).schema
    if spark.catalog.tableExists(table):
        add_new_columns(spark, table, schema)
    else:
        empty = spark.createDataFrame([], schema).write.format("parquet").mode("ignore")
        empty = empty.option("compression", _COMPRESSION).partitionBy(*keys, BATCH_COLUMN)
        (empty.option("path", location) if location is not None else empty).saveAsTable(table)
    df = fit_to_table(df, spark.table(table).schema, _beside(df))
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        _prepared_batch(df, keys, rebalance, counted, required).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)
