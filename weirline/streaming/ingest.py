"""Incremental ingest: each raw file is processed once, then remembered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weirline.sinks.tables import prepare_write
from weirline.sources.scans import raw_csv_options, text_schema

# Spark's own default forgets files a week older than the newest one and would
# skip a late arrival that kept its old time. The price is driver memory for the
# names of all files ever seen.
MAX_FILE_AGE = "36500d"

_POLL_SECONDS = 5
_KEPT_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
# More batches than can end between two looks at the progress.
_PROGRESS_ENTRIES = 10_000

# Names under which a run's progress reports its row counts.
RAW_ROWS = "raw"
_CLEAN_ROWS = "clean"


@dataclass(frozen=True)
class RunCounts:
    """Rows seen and rows written in one run, summed over its micro-batches.

    ``faults`` are those of the rows seen whose lines do not fit their header.
    """

    raw_rows: int
    clean_rows: int
    batches: int
    faults: int = 0

    @classmethod
    def of(cls, batches: Sequence[tuple[int, ...]]) -> RunCounts:
        raw, clean, faults = (sum(part) for part in zip(*((*b, 0)[:3] for b in batches), strict=True)) if batches else (0, 0, 0)
        return cls(raw, clean, len(batches), faults)


def raw_stream(
    spark: SparkSession,
    location: str,
    columns: Sequence[str],
    partition_columns: Sequence[str] = (),
    check_header: bool = True,
    pattern: str = "*",
    max_files: int | None = None,
    max_bytes: int | None = None,
    max_file_age: str = MAX_FILE_AGE,
) -> DataFrame:
    """Files that arrive below ``location``, as text columns.

    A file is taken once, by name: one rewritten under the same name is not read
    again. Without partition columns, folders below are read too. Either ``max_files`` or ``max_bytes`` bounds a micro-batch; a first run
    over a large backlog then commits its progress along the way.
    """
    reader = (
        spark.readStream.schema(text_schema([*columns, *partition_columns]))
        .options(**raw_csv_options(check_header))
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(not partition_columns).lower())
        .option("maxFileAge", max_file_age)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.csv(location)


def _drain(query: StreamingQuery) -> RunCounts:
    # Spark keeps the last progress entries only, so they are read as they come.
    rows: dict[int, tuple[int, int]] = {}
    finished = False
    while not finished:
        finished = query.awaitTermination(_POLL_SECONDS)
        for progress in query.recentProgress:
            metrics = progress.observedMetrics
            if RAW_ROWS in metrics and _CLEAN_ROWS in metrics:
                rows[progress.batchId] = (metrics[RAW_ROWS].rows, metrics[_CLEAN_ROWS].rows)
    return RunCounts.of(list(rows.values()))


def ingest_into(
    curated: DataFrame,
    checkpoint: str,
    location: str,
    keys: Sequence[str] = (),
    table: str | None = None,
    rebalance: bool = True,
) -> RunCounts:
    """Write what is new to Parquet at ``location``, then stop.

    ``curated`` is a streaming frame on which the rows read are observed under
    the name ``RAW_ROWS``. The sink's own log lists the files of committed batches, so a
    batch that is run again after a crash is not seen twice. With ``table`` the
    location is also a catalog table. The folder belongs to this one stream.
    """
    writer = (
        prepare_write(curated, keys, rebalance, _CLEAN_ROWS)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("compression", "snappy")
        .option("path", location)
        .trigger(availableNow=True)
    )
    if keys:
        writer = writer.partitionBy(*keys)
    conf = curated.sparkSession.conf
    before = conf.get(_KEPT_PROGRESS)
    conf.set(_KEPT_PROGRESS, max(int(before), _PROGRESS_ENTRIES))
    try:
        return _drain(writer.toTable(table) if table else writer.start())
    finally:
        conf.set(_KEPT_PROGRESS, before)
