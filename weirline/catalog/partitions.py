"""Partitions of a raw table as a table: what is registered, what is new, what is gone."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.catalog.names import quoted, quoted_column, text_literal, unescaped

_SCHEMA = "partition string"
_AT_ONCE = 200
_PROPERTY = "weirline.partition_ledger"


def add_partitions(spark: SparkSession, table: str, location: str, names: Sequence[str]) -> None:
    """Register partitions by name, such as ``year=2026/month=04``, a statement for every few hundred.

    Nothing is listed. Partitions that are registered already are left as they are.
    """
    for at in range(0, len(names), _AT_ONCE):
        specs = []
        for name in names[at : at + _AT_ONCE]:
            pairs = [part.split("=", 1) for part in name.split("/")]
            values = ", ".join(f"{quoted_column(k)} = {text_literal(unquote(v))}" for k, v in pairs)
            specs.append(f"PARTITION ({values}) LOCATION {text_literal(location.rstrip('/') + '/' + name)}")
        spark.sql(f"ALTER TABLE {quoted(table)} ADD IF NOT EXISTS {' '.join(specs)}")


class PartitionLedger:
    """A Parquet table with the name of every partition that a table has registered.

    It starts with what the catalog has. From then on what is new and what is gone are joins
    of names in tasks; only names of new partitions come to the driver. The table keeps
    the ledger's place among its properties, so a table made anew, or a ledger that was
    lost, starts over.
    """

    def __init__(self, spark: SparkSession, path: str, table: str, location: str) -> None:
        self._spark = spark
        self._table = table
        self._location = location
        properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(table)}").collect()}
        self._path = properties.get(_PROPERTY, "")
        if not self._path.startswith(f"{path}/") or not self._readable():
            self._path = f"{path}/{uuid.uuid4().hex}"
            spark.sql(f"SHOW PARTITIONS {quoted(table)}").write.parquet(self._path)
            spark.sql(f"ALTER TABLE {quoted(table)} SET TBLPROPERTIES ('{_PROPERTY}' = {text_literal(self._path)})")

    def _readable(self) -> bool:
        try:
            self._known()
        except AnalysisException:
            return False
        return True

    def _known(self) -> DataFrame:
        known = self._spark.read.schema(_SCHEMA).parquet(self._path)
        return known.select("partition", unescaped("partition").alias("name")).dropDuplicates(["name"])

    def register(self, files: DataFrame) -> int:
        """Register the partitions of the listed files that are not registered yet; give their number."""
        listed = files.where("partition <> ''").select("partition", unescaped("partition").alias("name"))
        new = listed.join(self._known().select("name"), "name", "left_anti").dropDuplicates(["name"])
        names = [r.partition for r in new.select("partition").collect()]
        if names:
            add_partitions(self._spark, self._table, self._location, names)
            # One literal, not rows: no Python worker is needed to write them.
            rows = self._spark.range(1).select(F.explode(F.split(F.lit("\n".join(names)), "\n")).alias("partition"))
            rows.write.mode("append").parquet(self._path)
        return len(names)

    def gone(self, files: DataFrame) -> DataFrame:
        """Registered partitions to which none of the listed files belongs. A report: nothing is dropped."""
        listed = files.select(unescaped("partition").alias("name")).distinct()
        return self._known().join(listed, "name", "left_anti").select("partition")
