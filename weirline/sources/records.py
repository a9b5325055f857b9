"""Raw CSV lines as records by position: which fit their header, and what is wrong with the others.

A line is read whole and then parsed with a mark behind its last field. Where the mark
comes out tells how many fields the line has, which a parser that fills and cuts lines to
the schema keeps to itself. A quoted field that is not closed swallows the mark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weirline.functions import field
from weirline.sources.scans import literal_path, text_schema

#: Beside a record: null if it fits its header, else ``kind``, ``path`` and ``text`` of the line.
FAULT = "_fault"
SHORT, LONG, UNCLOSED = "short", "long", "unclosed quote"
#: Beside a record: the path of its file.
FILE = "_file"
FAULT_SCHEMA = "path string, line bigint, kind string, text string"

# Signs that no line holds: what would part two lines' columns, and what ends a line.
_NO_SEPARATOR = "\x01\x02\x03\x02\x01"
_MARK = "\x03\x02\x03"


def plain_path(url: Column) -> Column:
    """A path as listings give it, from the URL that the metadata column gives."""
    return normal_path(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "file:/")


def scan_lines(
    spark: SparkSession,
    location: Sequence[str],
    header: str | None,
    partition_columns: Sequence[str],
    base_path: str | None,
    pattern: str,
    nested: bool,
) -> DataFrame:
    """``value``, ``_path``, ``_time`` and the partition columns of every line behind a header line.

    With ``header``, each task compares the first line of the files it opens with it and
    fails where they differ.
    """
    schema = StructType([StructField(header or "value", StringType()), *text_schema(partition_columns).fields])
    reader = spark.read.schema(schema).option("header", "true").option("enforceSchema", str(header is None).lower())
    reader = reader.option("sep", _NO_SEPARATOR).option("quote", "").option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", str(nested).lower())
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    lines = reader.csv(list(location))
    return lines.select(
        field(schema[0].name).alias("value"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_modification_time").alias("_time"),
        *[field(p) for p in partition_columns],
    )


def _parsed(lines: DataFrame, width: int) -> DataFrame:
    """``_cells``, the line's first ``width`` fields and one more, and ``_count``, how many it has (null: not to be told)."""
    # One more for the mark; a line with yet more fields pushes it out.
    names = [f"f{i}" for i in range(width + 1)]
    parsed = F.from_csv(F.concat("value", F.lit("," + _MARK)), ", ".join(f"{n} string" for n in names))
    there = ", ".join(f"coalesce(_cells.{n}, '')" for n in names)
    count = F.expr(f"nullif(array_position(array({there}), '{_MARK}'), 0) - 1")
    return lines.withColumn("_cells", parsed).withColumn("_count", count)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _fault(count: Column, width: Column) -> Column:
    """What is wrong with a line of ``count`` fields under a header of ``width``."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    kind = (
        F.when(count == width, None)
        .when(count < width, SHORT)
        .when(count.isNull() & (quotes % 2 == 1), UNCLOSED)
        .otherwise(LONG)
    )
    line = F.struct(kind.alias("kind"), plain_path(F.col("_path")).alias("path"), F.col("value").alias("text"))
    return F.when(kind.isNotNull(), line).alias(FAULT)


def parse_own(lines: DataFrame, columns: Sequence[str], partition_columns: Sequence[str]) -> DataFrame:
    """Records of files that all have the same header: ``columns``, partitions, the fault and the file."""
    width = len(columns)
    lines = _parsed(lines, width)
    # Fields of a short line beyond its end are null, and so is the mark.
    named = [F.expr(f"CASE WHEN coalesce(_count, {width}) > {i} THEN _cells.f{i} END AS {_quoted(n)}") for i, n in enumerate(columns)]
    fault = _fault(F.col("_count"), F.lit(len(columns)))
    return lines.select(*named, *[field(p) for p in partition_columns], fault, plain_path(F.col("_path")).alias(FILE))


def parse_known(
    lines: DataFrame, known: DataFrame, layouts: Mapping[str, Sequence[str]], columns: Sequence[str], partition_columns: Sequence[str]
) -> DataFrame:
    """Records of files with any number of headers, each field under the name that its file's header gives it.

    ``known`` has ``path``, ``header`` and ``modificationTime`` (null: any) of every file. A
    file that it lacks, or that changed since, fails the reading task.
    """
    spark = lines.sparkSession
    widest = max(len(names) for names in layouts.values())
    rows = [(h, len(names), [names.index(c) if c in names else None for c in columns]) for h, names in layouts.items()]
    places = spark.createDataFrame(rows, "header string, _width int, _places array<int>")
    known = known.select(normal_path(F.col("path")).alias("_known"), "header", F.col("modificationTime").alias("_then"))
    # A row for each file, not for each line; Spark broadcasts it while its files are small.
    known = known.join(F.broadcast(places), "header").drop("header")
    lines = lines.withColumn("_known", plain_path(F.col("_path"))).join(known, "_known", "left")
    changed = F.col("_width").isNull() | (F.col("_then") != F.col("_time"))
    message = F.concat(F.lit("came or changed after discovery, so that its header is not known: "), F.col("_known"))
    width = F.when(changed, F.raise_error(message).cast("int")).otherwise(F.col("_width"))
    lines = _parsed(lines, widest).withColumn("_width", width)
    cells = ", ".join(f"_cells.f{i}" for i in range(widest))
    lines = lines.withColumn("_cells", F.expr(f"array({cells})")).withColumn("_end", F.expr("least(coalesce(_count, _width), _width)"))
    output = [
        F.expr(f"CASE WHEN _places[{i}] < _end THEN try_element_at(_cells, _places[{i}] + 1) END AS {_quoted(n)}")
        for i, n in enumerate(columns)
    ]
    fault = _fault(F.col("_count"), F.col("_width"))
    return lines.select(*output, *[field(p) for p in partition_columns], fault, plain_path(F.col("_path")).alias(FILE))


def locate(spark: SparkSession, faults: DataFrame) -> DataFrame:
    """``path, line, kind, text`` of faulty lines (kind, path, text).

    Only the files that have any are read again, as text. Lines are numbered by block: a
    block's lines come in order in one task, and how many lines earlier blocks of the file
    have is a sum over blocks.
    """
    faults = faults.distinct()
    paths = [r.path for r in faults.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], FAULT_SCHEMA)
    lines = spark.read.text([literal_path(p) for p in paths]).select(
        F.col("value").alias("text"),
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("id") - F.col("first") + 1
    found = lines.join(faults, ["path", "text"]).join(blocks, ["path", "block"])
    return found.select("path", number.alias("line"), "kind", "text")


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
