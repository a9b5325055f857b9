"""Names and values in SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A dotted table name with every part quoted for SQL."""
    return ".".join(quoted_column(part) for part in name.split("."))


def quoted_column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unescaped(partition: str) -> Column:
    """A partition's name without %-escapes, which writers use to different extents."""
    decoded = F.try_url_decode(F.replace(partition, F.lit("+"), F.lit("%2B")))
    return F.coalesce(decoded, F.col(partition))
