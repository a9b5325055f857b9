"""Finished batches of a table merged into fewer partitions and files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weirline.catalog.names import quoted, quoted_column, text_literal
from weirline.catalog.tables import describe_raw_table
from weirline.functions import field
from weirline.sinks.tables import BATCH_COLUMN, spread_for_partitions

_NULL = "__HIVE_DEFAULT_PARTITION__"
_FOLDER = "_merged"
_PLAN = "merge string, partition string, level int, location string, replaced array<string>, folders array<string>"
_MARK = "merge string, what string"
#: Partition values merged by one job.
_AT_ONCE = 200


class BatchMerges:
    """Merges the batches that a table was filled with, once they are finished.

    Batches of one value of the other partition columns become one partition, which has
    the number of the last of them, and as few files as a rebalanced write gives. It
    takes ``at_least`` of a level to merge them into one of the next, so a row is
    rewritten once a level, whatever comes later, and each value keeps fewer than
    ``at_least`` partitions a level.

    Merged rows are written beside the old ones, below ``_merged`` of the table's folder;
    then the plan is kept under ``path``, and only then the catalog is told: the last
    batch's partition gets the new place, the others are dropped. A run that stopped
    before its plan was kept changed nothing, and one that stopped later is finished by
    the next. Old folders stay until the next call, for those who are reading them.

    To be called while nothing writes to the table, and only with batches that will not
    be run again. The catalog has no transaction over partitions: a read that is planned
    between its two calls for a value meets that value's rows twice. Reads by path see
    old folders only, so a merged table is to be read by its name.
    """

    def __init__(self, spark: SparkSession, table: str, path: str) -> None:
        self._spark = spark
        self._table = table
        self._plans, self._marks = f"{path}/plans", f"{path}/marks"
        self._location, _, partitions = describe_raw_table(spark, table)
        self._location = self._location.rstrip("/")
        if not partitions or partitions[-1] != BATCH_COLUMN:
            raise ValueError(f"{table} has no batches: its last partition column is not {BATCH_COLUMN}")
        self._keys = partitions[:-1]
        kinds = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").where("col_name = 'Type'").collect()
        if [r.data_type for r in kinds] != ["EXTERNAL"]:
            raise ValueError(f"{table} is no external table: dropping its partitions would delete files that are read")

    def run(self, at_least: int = 10) -> int:
        """Finish and clear away earlier merges, then merge; gives the number of partitions that went."""
        if at_least < 2:
            raise ValueError("a merge takes two batches or more")
        self._apply(self._unmarked("applied"))
        self._clear(self._unmarked("cleared"))
        gone = 0
        while groups := self._ready(at_least):
            merge, plan = uuid.uuid4().hex, []
            for at in range(0, len(groups), _AT_ONCE):
                plan += self._write(merge, at, groups[at : at + _AT_ONCE])
            self._spark.createDataFrame(plan, _PLAN).coalesce(1).write.mode("append").parquet(self._plans)
            self._apply(plan)
            gone += sum(len(p["replaced"]) for p in plan)
        return gone

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self._spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], schema)

    def _unmarked(self, what: str) -> list[Row]:
        marks = self._read(self._marks, _MARK).where(F.col("what") == what)
        return self._read(self._plans, _PLAN).join(marks, "merge", "left_anti").collect()

    def _mark(self, plan: Iterable[Row | dict], what: str) -> None:
        marks = [(m, what) for m in sorted({p["merge"] for p in plan})]
        if marks:
            self._spark.createDataFrame(marks, _MARK).coalesce(1).write.mode("append").parquet(self._marks)

    def _ready(self, at_least: int) -> list[Row]:
        """Values with enough batches of a level: their lowest such level, and its partitions in order."""
        number = rf"^(?:(.*)/)?{BATCH_COLUMN}=(\d+)$"
        shown = self._spark.sql(f"SHOW PARTITIONS {quoted(self._table)}").select(
            "partition",
            F.regexp_extract("partition", number, 1).alias("value"),
            F.regexp_extract("partition", number, 2).cast("bigint").alias("batch"),
        )
        merged = self._read(self._plans, _PLAN).groupBy("partition")
        merged = merged.agg(F.max(F.struct("level", "location")).alias("now")).select("partition", "now.*")
        place = F.coalesce("location", F.concat(F.lit(f"{self._location}/"), "partition"))
        parts = F.array_sort(F.collect_list(F.struct("batch", "partition", place.alias("folder"))))
        levels = (
            shown.join(merged, "partition", "left")
            .groupBy("value", F.coalesce("level", F.lit(0)).alias("level"))
            .agg(parts.alias("parts"))
            .where(F.size("parts") >= at_least)
        )
        lowest = levels.groupBy("value").agg(F.min(F.struct("level", "parts")).alias("of"))
        return lowest.select("value", "of.level", "of.parts").orderBy("value").collect()

    def _holds(self, value: str) -> Column:
        """Rows whose partition columns have the values that a partition's name tells."""
        pairs = [part.split("=", 1) for part in value.split("/")] if value else []
        tests = [
            field(k).isNull() if v in (_NULL, "null") else field(k).cast("string") == unquote(v) for k, v in pairs
        ]
        return reduce(Column.__and__, tests, F.lit(True))

    def _write(self, merge: str, at: int, groups: Sequence[Row]) -> list[dict]:
        # Levels hold one range of batches each, since only the newest are of the lowest.
        chosen = [
            self._holds(g.value) & F.col(BATCH_COLUMN).between(g.parts[0].batch, g.parts[-1].batch) for g in groups
        ]
        rows = self._spark.table(self._table).where(reduce(Column.__or__, chosen)).drop(BATCH_COLUMN)
        folder = f"{self._location}/{_FOLDER}/{merge}-{at}"
        writer = spread_for_partitions(rows, self._keys).write.option("compression", "snappy")
        (writer.partitionBy(*self._keys) if self._keys else writer).parquet(folder)
        return [
            {
                "merge": merge,
                "partition": g.parts[-1].partition,
                "level": g.level + 1,
                "location": f"{folder}/{g.value}".rstrip("/"),
                "replaced": [p.partition for p in g.parts[:-1]],
                "folders": [p.folder for p in g.parts],
            }
            for g in groups
        ]

    def _spec(self, partition: str) -> str:
        pairs = [part.split("=", 1) for part in partition.split("/")]
        values = ", ".join(
            f"{quoted_column(k)} = {'null' if v in (_NULL, 'null') else text_literal(unquote(v))}" for k, v in pairs
        )
        return f"PARTITION ({values})"

    def _apply(self, plan: Sequence[Row | dict]) -> None:
        for p in plan:
            table = quoted(self._table)
            place = text_literal(p["location"])
            self._spark.sql(f"ALTER TABLE {table} {self._spec(p['partition'])} SET LOCATION {place}")
            self._spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(map(self._spec, p['replaced']))}")
        if plan:
            self._spark.catalog.refreshTable(self._table)
        self._mark(plan, "applied")

    def _clear(self, plan: Sequence[Row]) -> None:
        hadoop = self._spark._jsparkSession.sessionState().newHadoopConf()
        for folder in (f for p in plan for f in p.folders):
            if not folder.startswith(f"{self._location}/"):
                raise ValueError(f"{folder} is not below {self._location}")
            place = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(hadoop).delete(place, True)
        self._mark(plan, "cleared")
