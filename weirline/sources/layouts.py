"""Header lines of raw CSV files: which columns each file has, and in what order."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.functions import field
from weirline.sources.files import partition_columns, require_depth
from weirline.sources.records import FAULT, FILE, normal_path, parse_known, parse_own, plain_path, scan_lines, union_of
from weirline.sources.scans import literal_path

HEADER_SCHEMA = "path string, modificationTime timestamp, length bigint, partition string, header string"

_FILES_PER_TASK = 64
_MAX_TASKS = 10_000

_OPENED_BY_ARROW = {
    "file": "file",
    "hdfs": "hdfs",
    "s3": "s3",
    "s3a": "s3",
    "gs": "gs",
    "abfs": "abfs",
    "abfss": "abfss",
}


@dataclass(frozen=True)
class Layout:
    """One header line, how many files start with it, and one of them."""

    columns: tuple[str, ...]
    header: str
    files: int
    example: str


@dataclass(frozen=True)
class Discovery:
    """The files of a location with their header lines, and the different layouts."""

    location: str
    headers: DataFrame
    layouts: list[Layout]
    pattern: str = "*"
    state_path: str | None = None  #: where what was found out about files is kept


def _arrow_access() -> tuple[Callable, Callable]:
    """How a task finds a file and reads its first line.

    Built as closures, which Spark sends to its workers whole, so that workers
    need no copy of this package.
    """
    schemes = dict(_OPENED_BY_ARROW)
    filesystems: dict[str, tuple[fs.FileSystem, str]] = {}

    def located(path: str) -> tuple[fs.FileSystem, str]:
        """The file system of a Spark path, and the path within it."""
        scheme, colon, rest = path.partition(":")
        if not colon:
            scheme, rest = "file", path
        authority, _, inner = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest)
        root = f"{schemes[scheme]}://{authority}/"
        if root not in filesystems:
            filesystems[root] = fs.FileSystem.from_uri(root)
        filesystem, base = filesystems[root]
        return filesystem, f"{base.rstrip('/')}/{inner.lstrip('/')}"

    def first_line(path: str) -> str:
        filesystem, inner = located(path)
        line = bytearray()
        with filesystem.open_input_stream(inner, compression="detect") as stream:
            while block := stream.read(64 * 1024):
                end = min((i for i in (block.find(b"\n"), block.find(b"\r")) if i >= 0), default=-1)
                if end >= 0:
                    line += block[:end]
                    break
                line += block
        return line.decode("utf-8-sig")

    def with_first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = pa.array([first_line(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, headers], names=[*batch.schema.names, "header"])

    return located, with_first_lines


def file_access() -> Callable[[str], tuple[fs.FileSystem, str]]:
    """How a task finds a file by a path as Spark writes it: the file system, and the path within it.

    Spark's names for object stores are taken too, such as ``s3a://``.
    """
    return _arrow_access()[0]


def can_open(path: str) -> bool:
    """Whether this process reaches a file without going through the JVM."""
    located, _ = _arrow_access()
    try:
        filesystem, inner = located(path)
        return filesystem.get_file_info(inner).type == fs.FileType.File
    except (KeyError, OSError, pa.ArrowException):
        return False


def _headers_by_opening(files: DataFrame, count: int) -> DataFrame:
    # A listing is small in bytes, so Spark would keep it in few tasks; opening
    # the files is what takes time, and tasks are sized by that.
    tasks = min(-(-count // _FILES_PER_TASK), _MAX_TASKS)
    _, with_first_lines = _arrow_access()
    return files.repartition(tasks, "path").mapInArrow(with_first_lines, HEADER_SCHEMA)


def _headers_by_scanning(spark: SparkSession, files: DataFrame, location: str, pattern: str) -> DataFrame:
    # Files older than the oldest one asked for are pruned from the scan.
    oldest = files.agg(F.min("modificationTime")).first()[0]
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(location)
        .where(F.col("_metadata.file_modification_time") >= F.lit(oldest))
        .select("value", F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("start"))
        .where("start = 0")
        .withColumn("row", F.monotonically_increasing_id())
        .groupBy("url")
        .agg(F.min_by("value", "row").alias("header"))
    )
    # The metadata column gives the path as a URL, the listing as plain text.
    first = lines.select(plain_path(F.col("url")).alias("k"), "header")
    joined = files.withColumn("k", normal_path(F.col("path"))).join(first, "k")
    header = F.regexp_replace(F.regexp_replace("header", "^﻿", ""), "\r$", "")
    return joined.select(*files.columns, header.alias("header"))


def file_headers(
    spark: SparkSession, location: str, files: DataFrame, count: int, pattern: str = "*", scan: bool = False
) -> DataFrame:
    """The first line of each of the ``count`` listed files: the listing and ``header``.

    Tasks open the files and read one block of each. With ``scan``, for storage
    that only the JVM can reach, all lines of files as young as these are read
    instead, and the first of each file kept.
    """
    return _headers_by_scanning(spark, files, location, pattern) if scan else _headers_by_opening(files, count)


def parse_header(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([header]), []))


def find_layouts(headers: DataFrame) -> list[Layout]:
    """The different header lines, those seen first coming first."""
    found = (
        headers.groupBy("header")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min("modificationTime").alias("seen"),
            F.min("path").alias("example"),
        )
        .orderBy("seen", "example")
        .collect()
    )
    return [Layout(parse_header(r.header), r.header, r.files, r.example) for r in found]


def group_compatible(layouts: Sequence[Layout], share: float = 0.5) -> list[list[Layout]]:
    """Put layouts that describe the same kind of record into one group.

    A layout joins the first group with which it has more than ``share`` of its
    own, or of the group's, columns in common, whatever their order.
    """
    groups: list[tuple[set[str], list[Layout]]] = []
    for layout in layouts:
        names = set(layout.columns)
        for columns, members in groups:
            if len(names & columns) > share * min(len(names), len(columns)):
                members.append(layout)
                columns |= names
                break
        else:
            groups.append((set(names), [layout]))
    return [members for _, members in groups]


def merged_columns(layouts: Sequence[Layout]) -> list[str]:
    """Columns of the first layout, then the ones later layouts add."""
    return list(dict.fromkeys(c for layout in layouts for c in layout.columns))


def _layout_paths(found: Discovery) -> dict[str, list[str]]:
    """What to read for each header: whole directories, or files where mixed.

    Every scan keeps its file list on the driver; this is the same list, folded
    to directories wherever all files of one directory agree, and to the
    location itself where all files do.
    """
    if len(found.layouts) == 1:
        return {found.layouts[0].header: [found.location]}
    placed = found.headers.select("header", "path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"))
    kinds = placed.groupBy("directory").agg(F.min("header").alias("low"), F.max("header").alias("high"))
    whole = kinds.where("low = high").select(F.col("low").alias("header"), F.col("directory").alias("path"))
    mixed = placed.join(kinds.where("low <> high").select("directory"), "directory", "left_semi")
    paths: dict[str, list[str]] = {}
    for row in whole.union(mixed.select("header", "path")).collect():
        paths.setdefault(row.header, []).append(row.path)
    return paths


#: More headers than this are read by one scan, which looks each file's header up.
SCANS = 16


def read_layouts(
    spark: SparkSession,
    found: Discovery,
    layouts: Sequence[Layout] | None = None,
    partitions: Sequence[str] | None = None,
    faults: bool = False,
    files: bool = False,
    scans: int = SCANS,
) -> DataFrame:
    """One frame over files with different headers, each value under its own name.

    It has every column that occurs, null where a file lacks it. No rows are shuffled: a
    few headers are a scan each, whose tasks compare header lines once more, and any
    larger number is one scan joined with the headers' small table. By default all layouts
    found are read. A file without partition columns may lie in any folder; one outside
    the partition columns is refused.

    A line that does not fit its header is cut and filled; with ``faults`` a column
    ``FAULT`` tells what is wrong with it, and with ``files`` a column ``FILE`` where it is.
    """
    if layouts is None:
        layouts = found.layouts
    if not layouts:
        raise ValueError("there is no layout to read")
    if partitions is None:
        partitions = partition_columns(found.headers)
    require_depth(found.headers, found.location, partitions)
    if len(layouts) <= scans:
        paths = _layout_paths(found)
        records = _by_name(spark, paths, layouts, partitions, found.location, found.pattern)
    else:
        records = _in_one_scan(spark, found, layouts, partitions)
    return _with(records, faults, files)


def _with(records: DataFrame, faults: bool, files: bool) -> DataFrame:
    return records.drop(*([] if faults else [FAULT]), *([] if files else [FILE]))


def read_files(
    spark: SparkSession,
    files: Sequence[tuple[str, str]],
    partitions: Sequence[str],
    location: str,
    faults: bool = False,
    paths: bool = False,
    scans: int = SCANS,
) -> DataFrame:
    """Some files of a location, each a path with its header line, by name."""
    at: dict[str, list[str]] = {}
    for path, header in files:
        at.setdefault(header, []).append(path)
    layouts = [Layout(parse_header(h), h, len(p), p[0]) for h, p in at.items()]
    if len(layouts) <= scans:
        records = _by_name(spark, at, layouts, partitions, location)
    else:
        listed = spark.createDataFrame(files, "path string, header string").withColumn("modificationTime", F.lit(None).cast("timestamp"))
        lines = scan_lines(spark, [literal_path(path) for path, _ in files], None, partitions, location, "*", False)
        records = _looked_up(lines, listed, layouts, partitions)
    return _with(records, faults, paths)


def _by_name(
    spark: SparkSession,
    paths: dict[str, list[str]],
    layouts: Sequence[Layout],
    partitions: Sequence[str],
    location: str,
    pattern: str = "*",
) -> DataFrame:
    frames = []
    for layout in layouts:
        at = paths[layout.header]
        nested = not partitions and at == [location]
        read = [location] if nested or at == [location] else [literal_path(p) for p in at]
        base = None if nested else location
        lines = scan_lines(spark, read, layout.header, partitions, base, pattern, nested)
        frames.append(parse_own(lines, layout.columns, partitions))
    return union_of(frames).select(*[field(c) for c in [*merged_columns(layouts), *partitions]], FAULT, FILE)


def _in_one_scan(
    spark: SparkSession, found: Discovery, layouts: Sequence[Layout], partitions: Sequence[str]
) -> DataFrame:
    known = found.headers.select("path", "header", "modificationTime")
    if len(layouts) == len(found.layouts):
        at, nested = [found.location], not partitions
    else:
        paths = _layout_paths(found)
        at, nested = [literal_path(p) for layout in layouts for p in paths[layout.header]], False
    base = None if nested else found.location
    lines = scan_lines(spark, at, None, partitions, base, found.pattern, nested)
    return _looked_up(lines, known, layouts, partitions)


def _looked_up(lines: DataFrame, known: DataFrame, layouts: Sequence[Layout], partitions: Sequence[str]) -> DataFrame:
    by_header = {layout.header: layout.columns for layout in layouts}
    return parse_known(lines, known, by_header, merged_columns(layouts), partitions)


_NUMERIC = ["int", "bigint", "double"]


def wider_type(one: str, other: str) -> str:
    """The narrowest type that holds the values of both."""
    if one == other:
        return one
    if one in _NUMERIC and other in _NUMERIC:
        return max(one, other, key=_NUMERIC.index)
    if {one, other} == {"date", "timestamp"}:
        return "timestamp"
    return "string"


def infer_columns(
    spark: SparkSession,
    found: Discovery,
    partitions: Sequence[str] | None = None,
    sampling_ratio: float = 1.0,
) -> T.StructType:
    """Column types from the values, merged over layouts; partitions are text.

    One aggregate over the text of all files tells which types each column's values
    have; lines that do not fit their header say nothing. Reads all rows unless
    ``sampling_ratio`` asks for fewer.
    """
    if partitions is None:
        partitions = partition_columns(found.headers)
    text = read_layouts(spark, found, partitions=partitions, faults=True).where(F.col(FAULT).isNull())
    if sampling_ratio < 1:
        text = text.sample(sampling_ratio)
    names = merged_columns(found.layouts)
    seen = text.agg(*[kinds_of(c).alias(str(i)) for i, c in enumerate(names)]).first()
    return typed(names, [seen[str(i)] for i in range(len(names))], partitions)


def typed(names: Sequence[str], kinds: Sequence[int | None], partitions: Sequence[str]) -> T.StructType:
    """Columns of the types that hold all kinds of values found, given as by :func:`kinds_of`; partitions are text."""
    columns = []
    for name, bits in zip(names, kinds, strict=True):
        found = [t for i, t in enumerate(_TYPES) if (bits or 0) >> i & 1] or ["string"]
        columns.append(T.StructField(name, T.DataType.fromDDL(reduce(wider_type, found))))
    return T.StructType(columns + [T.StructField(p, T.StringType()) for p in partitions])


def kinds_of(name: str) -> Column:
    """Which types the values of a text column have, a bit for each; an aggregate that merges."""
    return F.expr(f"coalesce(bit_or({_KIND.format(v=_quoted(name))}), 0)")


_TYPES = ["int", "bigint", "double", "boolean", "date", "timestamp", "string"]


_BIT = {t: 1 << i for i, t in enumerate(_TYPES)}

#: The bit of the narrowest type that holds a value; null for none. Most text tells by its
#: first sign that it is neither a number nor a date.
_KIND = rf"""CASE
  WHEN {{v}} IS NULL OR {{v}} = '' THEN NULL
  WHEN NOT {{v}} RLIKE r'^[+-]?[0-9.NI]' AND lower({{v}}) NOT IN ('true', 'false') THEN {_BIT["string"]}
  WHEN {{v}} RLIKE r'^[+-]?[0-9]+$' AND try_cast({{v}} AS INT) IS NOT NULL THEN {_BIT["int"]}
  WHEN {{v}} RLIKE r'^[+-]?[0-9]+$' AND try_cast({{v}} AS BIGINT) IS NOT NULL THEN {_BIT["bigint"]}
  WHEN {{v}} RLIKE r'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(NaN|Infinity)$' THEN {_BIT["double"]}
  WHEN lower({{v}}) IN ('true', 'false') THEN {_BIT["boolean"]}
  WHEN {{v}} RLIKE r'^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$' AND try_cast({{v}} AS DATE) IS NOT NULL THEN {_BIT["date"]}
  WHEN {{v}} RLIKE r'^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}[ T][0-9]{{{{2}}}}:[0-9]{{{{2}}}}'
    AND try_cast({{v}} AS TIMESTAMP) IS NOT NULL THEN {_BIT["timestamp"]}
  ELSE {_BIT["string"]} END"""


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
