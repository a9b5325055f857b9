"""Column replacement, appending, and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from weirline.functions import field


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Give an existing column a new value, in place."""
    if name not in df.columns:
        raise ValueError(f"no column {name} to replace")
    return df.withColumn(name, value)


def append_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column at the end; an existing name is refused."""
    if name in df.columns:
        raise ValueError(f"column {name} is already there")
    return df.withColumn(name, value)


def keys_present(df: DataFrame, keys: Sequence[str]) -> Column:
    """True where no key is missing. Without keys it is true everywhere."""
    present = F.lit(True)
    for key in keys:
        present = present & field(key).isNotNull()
        if isinstance(df.schema[key].dataType, (DoubleType, FloatType)):
            present = present & ~F.isnan(field(key))
    return present


def drop_missing(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows in which any key is null (or NaN, for a floating-point key).

    Same rows as ``dropna``, but as plain null checks, which reach a file scan.
    """
    return df.where(keys_present(df, keys))


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Keep rows for which a SQL expression is true; false and null are dropped."""
    return df.where(F.expr(expression))
