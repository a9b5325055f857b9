"""Types of the values in each raw file, so that inference reads only new files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirline.operators.counts import observe_rows
from weirline.sources.files import partition_columns
from weirline.sources.layouts import Discovery, kinds_of, merged_columns, read_files, read_layouts, typed
from weirline.sources.records import FAULT, FILE, normal_path

_SCHEMA = "path string, modificationTime timestamp, kinds array<struct<name:string,bits:int>>"
_VERSION = ["path", "modificationTime"]


class KindLedger:
    """A Parquet table with a row per raw file version: which types its columns' values have.

    A file's row is one bit a type and column, and rows of files merge by OR, so the types of
    any set of files are a small aggregate over their rows. Losing the ledger costs one
    read of all files.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path
        spark.createDataFrame([], _SCHEMA).write.mode("ignore").parquet(path)

    def _known(self) -> DataFrame:
        return self._spark.read.schema(_SCHEMA).parquet(self._path)

    def refresh(self, found: Discovery, partitions: Sequence[str], read: Observation | None = None) -> int:
        """Read the found files that are not known yet; give their number. ``read`` observes their rows."""
        files = found.headers.select(*_VERSION, "header")
        new = files.join(self._known().select(*_VERSION), _VERSION, "left_anti")
        # Names of new files, which a scan of them holds as well.
        named = [(r.path, r.header) for r in new.select("path", "header").collect()]
        if not named:
            return 0
        if self._known().isEmpty():
            records = read_layouts(self._spark, found, partitions=partitions, faults=True, files=True)
        else:
            records = read_files(self._spark, named, partitions, found.location, faults=True, paths=True)
        if read is not None:
            records = observe_rows(records, read)
        names = [c for c in records.columns if c not in (*partitions, FAULT, FILE)]
        fine = records.where(F.col(FAULT).isNull()).groupBy(FILE)
        kinds = fine.agg(*[kinds_of(c).alias(str(i)) for i, c in enumerate(names)])
        listed = F.array(*[F.struct(F.lit(c).alias("name"), F.col(str(i)).alias("bits")) for i, c in enumerate(names)])
        kinds = kinds.select(F.col(FILE).alias("_known"), F.filter(listed, lambda k: k["bits"] != 0).alias("kinds"))
        # A file without rows gets one too, or it would be new for ever.
        new = new.withColumn("_known", normal_path(F.col("path")))
        kinds = kinds.withColumn("_known", normal_path(F.col("_known")))
        rows = new.join(kinds, "_known", "left").select(*_VERSION, F.coalesce("kinds", F.array()).alias("kinds"))
        rows.hint("rebalance").write.mode("append").parquet(self._path)
        return len(named)

    def kinds(self, found: Discovery) -> dict[str, int]:
        """Types seen in the files found, by column."""
        current = self._known().join(found.headers.select(*_VERSION), _VERSION, "left_semi")
        each = current.select(F.explode("kinds").alias("k")).groupBy("k.name").agg(F.bit_or("k.bits").alias("bits"))
        return {r["name"]: r["bits"] for r in each.collect()}


def infer_known(
    spark: SparkSession,
    found: Discovery,
    state_path: str,
    partitions: Sequence[str] | None = None,
    read: Observation | None = None,
) -> StructType:
    """Column types from the values, as ``infer_columns`` gives them, reading only files not seen before."""
    if partitions is None:
        partitions = partition_columns(found.headers)
    ledger = KindLedger(spark, f"{state_path}/kinds")
    ledger.refresh(found, partitions, read)
    kinds = ledger.kinds(found)
    names = merged_columns(found.layouts)
    return typed(names, [kinds.get(c) for c in names], partitions)
