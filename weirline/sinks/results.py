"""Query results go below one root that the caller cannot leave."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_QUERY_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


class ResultStore:
    """Writes results as CSV to ``<root>/<query>/<run>``; only ``query`` is chosen."""

    def __init__(self, root: str) -> None:
        self._root = root.rstrip("/")

    def write(self, df: DataFrame, query: str) -> str:
        """Write to a fresh folder and return it. Each task writes its own file."""
        if not _QUERY_NAME.fullmatch(query):
            raise ValueError(f"a query name has letters, digits, - and _ only: {query!r}")
        location = f"{self._root}/{query}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").option("header", "true").csv(location)
        return location

    def read(self, spark: SparkSession, location: str, schema: StructType | str) -> DataFrame:
        if not location.startswith(self._root + "/") or ".." in location.split("/"):
            raise ValueError(f"{location} is not below {self._root}")
        # Null is written as nothing and an empty text as two quotes; a null marker
        # that cannot occur keeps them apart.
        return (
            spark.read.schema(schema)
            .option("header", "true")
            .option("enforceSchema", "false")
            .option("nullValue", "\0")
            .csv(location)
        )
