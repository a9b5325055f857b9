"""Raw text rows to curated rows, and the batch job around it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirline.catalog import PartitionLedger, describe_raw_table, discover, update_raw_table
from weirline.config import CurateRules, JobConfig
from weirline.functions import field, parse_date
from weirline.operators import (
    FieldMapping,
    append_column,
    apply_mapping,
    drop_missing,
    make_columns,
    observed_types,
    replace_column,
)
from weirline.operators.resolve import SPECIFICITY
from weirline.scratch import discard, new_workspace
from weirline.sinks import append_parquet, append_to_table
from weirline.sources import FAULT, list_files, locate, read_layouts, require_depth, text_schema
from weirline.streaming import RunCounts, TooManyFaults, require_layouts


def shape(raw: DataFrame, rules: CurateRules, carry: Sequence[str] = ()) -> DataFrame:
    """Map and cast, parse dates, and stamp.

    ``carry`` names columns outside the mapping to keep, such as the partition
    columns of the raw files. What is wrong with a line stays beside its row.
    Works on batch and streaming frames.
    """
    kept = [FieldMapping(c, "string", c, "string") for c in carry]
    df = apply_mapping(raw, [*rules.mapping, *kept], [FAULT] if FAULT in raw.columns else [])
    for name, pattern in rules.dates:
        df = replace_column(df, name, parse_date(field(name), pattern))
    return append_column(df, rules.stamp, F.current_timestamp())


def curate(raw: DataFrame, rules: CurateRules, carry: Sequence[str] = ()) -> DataFrame:
    """``shape``, and drop rows without their keys."""
    return drop_missing(shape(raw, rules, carry), rules.keys)


@dataclass(frozen=True)
class Sinks:
    """Where the rows of one run or batch go: each takes a frame, and the observations of a counted write."""

    curated: Callable[..., None]
    cleaned: Callable[..., None] | None = None
    quarantine: Callable[[DataFrame], None] | None = None


def resolved(df: DataFrame, columns: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Mixed columns split by the types found now, and by those the target has columns of.

    A type once seen keeps its column, so later rows go on landing where earlier ones did.
    """
    present = {c.lower() for c in target}
    found = observed_types(df, columns, SPECIFICITY)
    mixed = {}
    for name, kinds in found.items():
        known = [t for t in SPECIFICITY if f"{name}_{t}".lower() in present]
        if known or len(kinds) > 1:
            mixed[name] = sorted({*kinds, *known}, key=SPECIFICITY.index)
    return make_columns(df, mixed) if mixed else df


def curate_into(config: JobConfig, raw: DataFrame, sinks: Sinks) -> tuple[RunCounts, RunCounts | None]:
    """Shape raw rows and write them; what was counted for the curated and for the cleaned zone.

    With one sink this is one pass over the raw files. Where a job has more to do with
    the rows, they are shaped once, written to the shared folder, and all else goes from
    there: raw files are read and parsed once.
    """
    spark = raw.sparkSession
    carry = [c for c in config.cleaned_partition_keys if c not in config.rules.raw_columns] if config.cleaned_path else []
    shaped = shape(raw, config.rules, carry)
    stage = new_workspace(spark, "staged") if config.staged else None
    if stage is not None:
        shaped.write.parquet(stage)
        shaped = spark.read.schema(shaped.schema).parquet(stage)
    try:
        if stage is not None and FAULT in shaped.columns:
            _quarantine(config, shaped.where(F.col(FAULT).isNotNull()).select(f"{FAULT}.*"), sinks)
        if config.choice_columns:
            target = spark.table(config.target).columns if spark.catalog.tableExists(config.target) else ()
            shaped = resolved(shaped, config.choice_columns, target)
        counts = [_counted(sinks.curated, shaped.drop(*carry))]
        if sinks.cleaned is not None:
            counts.append(_counted(sinks.cleaned, shaped))
    finally:
        if stage is not None:
            discard(spark, stage)
    return counts[0], counts[1] if sinks.cleaned is not None else None


def _counted(sink: Callable[..., None], df: DataFrame) -> RunCounts:
    arrived, written = Observation(), Observation()
    sink(df, arrived, written)
    seen = arrived.get
    return RunCounts(seen["rows"], written.get["rows"], 1, seen.get("faults", 0))


def _quarantine(config: JobConfig, faults: DataFrame, sinks: Sinks) -> None:
    n = faults.count()
    if n and sinks.quarantine is not None:
        sinks.quarantine(locate(faults.sparkSession, faults))
    if config.max_faults is not None and n > config.max_faults:
        examples = [f"{r.kind} in {r.path}: {r.text[:80]!r}" for r in faults.orderBy("path", "text").limit(3).collect()]
        raise TooManyFaults(f"{n} lines do not fit their header, {config.max_faults} may: {'; '.join(examples)}")


def run_batch(spark: SparkSession, config: JobConfig) -> RunCounts:
    """Discover, stop if a file does not belong, curate all files and append them to the target.

    What discovery accepted is read, each file by its own header line, and new
    columns and partitions are registered first. Lines that do not fit their header
    are counted and left out.
    """
    if config.bookmark:
        raise ValueError("a bookmarked job is run by run_arrivals; its target must not get other writes")
    location, columns, partitions = describe_raw_table(spark, config.source)
    listed = list_files(spark, location, config.raw_pattern)
    require_depth(listed, location, partitions)
    state = config.state_path or new_workspace(spark, "discovery")
    found = discover(spark, location, state, config.raw_pattern, listed=listed)
    require_layouts(found.layouts, columns, config.rules.raw_columns if config.added_columns else None)
    update_raw_table(spark, config.source, [x.columns for x in found.layouts], register=config.state_path is None)
    if partitions and config.state_path is not None:
        PartitionLedger(spark, f"{state}/partitions", config.source, location).register(found.headers)
    if found.layouts:
        source = read_layouts(spark, found, partitions=partitions, faults=True)
    else:
        source = spark.createDataFrame([], text_schema([*columns, *partitions]))
    options = {"rebalance": config.rebalance, "required": config.rules.keys}

    def curated(df: DataFrame, arrived: Observation, written: Observation) -> None:
        append_to_table(df, config.target, config.target_path, config.partition_keys, written=written, arrived=arrived, **options)

    def cleaned(df: DataFrame, arrived: Observation, written: Observation) -> None:
        append_parquet(df, config.cleaned_path, config.cleaned_partition_keys, written=written, arrived=arrived, **options)

    def quarantine(lines: DataFrame) -> None:
        append_parquet(lines, config.quarantine_path)

    sinks = Sinks(curated, cleaned if config.cleaned_path else None, quarantine if config.quarantine_path else None)
    return curate_into(config, source, sinks)[0]
