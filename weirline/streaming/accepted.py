"""Files that discovery accepted, as a stream: each is processed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirline.streaming.ingest import MAX_FILE_AGE

#: A step never has more files; the driver holds a step's names, as Spark's scan of the files does.
STEP_FILES = 100_000
#: About as many files are ordered by one task.
RANGE_FILES = 20_000

_SCHEMA = "path string, length bigint, partition string, header string, step bigint"


class AcceptedFiles:
    """A Parquet folder with a row per accepted raw file, by name, and its header line.

    Every file of the folder is one micro-batch of the stream over it. So the
    stream remembers one name for each step of work, not for each raw file.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path
        spark.createDataFrame([], _SCHEMA).write.mode("ignore").partitionBy("step").parquet(path)

    def _known(self) -> DataFrame:
        return self._spark.read.schema(_SCHEMA).parquet(self._path)

    def without(self, headers: DataFrame) -> DataFrame:
        """The listed files that were not accepted before."""
        return headers.join(self._known().select("path"), "path", "left_anti")

    def add(
        self,
        headers: DataFrame,
        count: int,
        max_files: int | None = None,
        max_bytes: int | None = None,
        range_files: int = RANGE_FILES,
    ) -> None:
        """Accept ``count`` files, in steps of at most so many files or about so many bytes.

        Steps follow the files' times and names. They never hold more than ``STEP_FILES``
        files, so that neither the driver nor a task sees all names of a large backlog.
        """
        rows = headers.select("path", "length", "partition", "header", "modificationTime")
        if max_bytes is None or max_files is not None:
            max_files = min(max_files or STEP_FILES, STEP_FILES)
        if max_files is not None and count <= max_files:
            rows = rows.withColumn("step", F.lit(0).cast("bigint"))
        else:
            rows = self._in_steps(rows, count, max_files, max_bytes, range_files)
        # All rows of a step are in one task, which writes one file for it.
        rows = rows.drop("modificationTime").repartition("step")
        rows.write.mode("append").partitionBy("step").parquet(self._path)

    def _in_steps(
        self, rows: DataFrame, count: int, max_files: int | None, max_bytes: int | None, range_files: int
    ) -> DataFrame:
        """Files with their step, by how many files or bytes come before them.

        Files are dealt to ranges of times and names; what comes before a range is a sum
        over ranges, and what comes before a file in its range a window over that range.
        """
        order = ["modificationTime", "path"]
        ranges = -(-count // range_files)
        ranged = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
        if ranges > 1:
            # Where a range ends is drawn from a sample, so ranges are kept, not drawn again.
            place = f"{self._path}-ranges/{uuid.uuid4().hex}"
            ranged.write.parquet(place)
            ranged = self._spark.read.schema(ranged.schema).parquet(place)
        size = F.lit(1).cast("bigint") if max_files is not None else F.col("length")
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        totals = ranged.groupBy("_range").agg(F.sum(size).alias("_total"))
        totals = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
        within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum(size).over(within), F.lit(0)) + F.col("_before")
        placed = ranged.join(F.broadcast(totals), "_range")  # one row for each range
        by_size = placed.withColumn("step", F.floor(at / (max_files or max_bytes)).cast("bigint")).drop("_range", "_before")
        if max_files is not None:
            return by_size
        # A step by size of very small files still has a bounded number of names.
        of_step = F.row_number().over(Window.partitionBy("step").orderBy(*order)) - 1
        return by_size.withColumn("_part", F.floor(of_step / STEP_FILES)).withColumn(
            "step", (F.col("step") * (count // STEP_FILES + 1) + F.col("_part")).cast("bigint")
        ).drop("_part")

    def process(self, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
        """Call ``work`` with the files of each step not yet done, and its number; then stop.

        A step that failed half-way is given again with the same number and files.
        """

        def unless_empty(files: DataFrame, number: int) -> None:
            if not files.isEmpty():
                work(files, number)

        stream = (
            self._spark.readStream.schema(_SCHEMA)
            .option("maxFilesPerTrigger", 1)
            .option("maxFileAge", MAX_FILE_AGE)
            .parquet(self._path)
        )
        writer = stream.writeStream.foreachBatch(unless_empty).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
