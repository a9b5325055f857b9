"""Discover what has arrived, check it, and curate exactly what was accepted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirline.catalog import PartitionLedger, describe_raw_table, known_headers, update_raw_table
from weirline.config import JobConfig
from weirline.plans.curate import Sinks, curate_into
from weirline.sinks import BATCH_COLUMN, BatchMerges, replace_batch, replace_batch_in_table
from weirline.sources import find_layouts, list_files, read_files, require_depth
from weirline.streaming import AcceptedFiles, RunCounts, require_layouts


@dataclass(frozen=True)
class RunReport:
    """What one arrival-driven run did. ``deleted`` is a lazy report."""

    counts: RunCounts
    cleaned: RunCounts | None
    new_columns: list[str]
    deleted: DataFrame | None


def _listing(spark: SparkSession, location: str, config: JobConfig) -> DataFrame:
    """The one listing of a run, kept beside its state so that all of the run sees the same files."""
    return _kept(list_files(spark, location, config.raw_pattern), f"{config.state_path}/listing")


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_arrivals(spark: SparkSession, config: JobConfig) -> RunReport:
    """One run: discover, stop if a new file does not belong, else curate the new files.

    Run it on any schedule; without new files it adds nothing. Files are accepted
    first, by name, and only accepted files are read, each by its own header line,
    so a file that comes in meanwhile waits for the next run. A failed run leaves
    what it accepted to the next one. A batch of files that is run again replaces
    what it wrote before: the target has the number of the batch as its last
    partition column.
    """
    if not config.bookmark:
        raise ValueError("a job without bookmark is run by run_batch")
    location, columns, partitions = describe_raw_table(spark, config.source)
    listed = _listing(spark, location, config)
    require_depth(listed, location, partitions)
    ledger = PartitionLedger(spark, f"{config.state_path}/partitions", config.source, location) if partitions else None
    accepted = AcceptedFiles(spark, f"{config.state_path}/accepted")
    headers = known_headers(spark, location, config.state_path, config.raw_pattern, None, accepted.without(listed))
    # What is waiting may be read several times below; none of that goes back to all that was ever seen.
    waiting = _kept(headers, f"{config.state_path}/waiting")
    layouts = find_layouts(waiting)
    new_columns: list[str] = []
    if layouts:
        require_layouts(layouts, columns, config.rules.raw_columns if config.added_columns else None)
        new_columns = update_raw_table(spark, config.source, [x.columns for x in layouts], register=False)
        if partitions:
            ledger.register(waiting)
        accepted.add(waiting, sum(x.files for x in layouts), config.max_files, config.max_bytes)

    counts: list[tuple[RunCounts, RunCounts | None]] = []

    def curate_batch(files: DataFrame, batch: int) -> None:
        session = files.sparkSession
        named = [(r.path, r.header) for r in files.select("path", "header").collect()]
        raw = read_files(session, named, partitions, location, faults=True)
        number = F.lit(batch).cast("bigint").alias(BATCH_COLUMN)
        options = {"rebalance": config.rebalance, "required": config.rules.keys}

        def curated(df: DataFrame, *counted: Observation) -> None:
            keys = config.partition_keys
            replace_batch_in_table(df.select("*", number), config.target, config.target_path, keys, counted=counted, **options)

        def cleaned(df: DataFrame, *counted: Observation) -> None:
            replace_batch(df.select("*", number), config.cleaned_path, config.cleaned_partition_keys, counted=counted, **options)

        def quarantine(lines: DataFrame) -> None:
            replace_batch(lines.select("*", number), config.quarantine_path)

        sinks = Sinks(curated, cleaned if config.cleaned_path else None, quarantine if config.quarantine_path else None)
        counts.append(curate_into(config, raw, sinks))

    accepted.process(curate_batch, f"{config.state_path}/curated")
    if counts:
        # Batches ran in a session of the stream, so this one may remember the table as it was.
        spark.catalog.refreshTable(config.target)
    if config.merge_batches and spark.catalog.tableExists(config.target):
        # Every batch is committed by now, so none of them will be run again.
        BatchMerges(spark, config.target, f"{config.state_path}/merges").run(config.merge_batches)
    deleted = ledger.gone(listed) if ledger is not None else None
    cleaned = _summed([c for _, c in counts]) if config.cleaned_path else None
    return RunReport(_summed([c for c, _ in counts]), cleaned, new_columns, deleted)


def _summed(counts: Sequence[RunCounts]) -> RunCounts:
    return RunCounts.of([(c.raw_rows, c.clean_rows, c.faults) for c in counts])
