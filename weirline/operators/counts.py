"""Counts, counts taken during a write, and the unordered limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirline.functions import field


def grouped_count(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*[field(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def counts_from_footers(spark: SparkSession, location: str, *keys: str, schema: str | None = None, name: str = "cnt") -> DataFrame:
    """``grouped_count`` of a Parquet folder by partition columns, from the files' footers alone.

    Spark's second Parquet reader answers counts with the number of rows that footers give, so no
    page of data is read. It is asked for in a session of its own; the one given keeps its settings.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    reader = session.read if schema is None else session.read.schema(schema)
    return grouped_count(reader.parquet(location), *keys, name=name)


def first_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows; which ones is not defined, as no order is asked for."""
    return df.limit(n)


def row_counts(df: DataFrame, kept: Column) -> DataFrame:
    """``raw_rows`` and ``clean_rows`` (rows for which ``kept`` holds) in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(kept).alias("clean_rows"),
    )


def observe_rows(df: DataFrame, observation: Observation | str, **further: Column) -> DataFrame:
    """Count the rows flowing past this point of the plan, without another job.

    The number arrives with the action that runs the plan. It is exact where no
    shuffle follows. Upstream of a shuffle, a map stage that Spark reruns after
    losing an executor adds its rows again; write with ``rebalance=False``, or
    use ``row_counts``, where such a figure must be exact even then. ``further`` names
    conditions to count rows by.
    """
    counts = [F.count_if(condition).alias(name) for name, condition in further.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)
