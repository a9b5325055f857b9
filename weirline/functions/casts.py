"""Scalar expressions whose result does not depend on the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str) -> Column:
    """Column by its literal name; dots and backticks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def strict_cast(column: Column, data_type: str) -> Column:
    """Cast that gives null, never an error, for text that is not a ``data_type``."""
    return column.try_cast(data_type)


def parse_date(column: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that does not match ``pattern`` gives null."""
    return F.try_to_date(column, pattern)
