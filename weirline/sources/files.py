"""File listings as frames: names, times and sizes, without reading content."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A run of directory parts such as ``year=2026`` that ends before the file name.
_PARTITION_RUN = r"(?:^|/)((?:[^/=]+=[^/]*/)+)[^/]+$"
_PARTITION_KEY = r"(?:^|/)([^/=]+)="
_SCHEME_AND_AUTHORITY = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")


def _below(path: Column, location: str) -> Column:
    """What follows ``location`` in a path, whichever way either names the storage."""
    inner = _SCHEME_AND_AUTHORITY.sub("", location).rstrip("/") + "/"
    return F.substr(path, F.instr(path, inner) + F.lit(len(inner)))


def list_files(spark: SparkSession, location: str, pattern: str = "*") -> DataFrame:
    """``path, modificationTime, length, partition`` of every file below ``location``.

    ``partition`` is the part such as ``year=2026/month=04`` of the path below the
    location, and empty where there is none. The file content is never selected,
    so Spark opens no file; large listings are made by tasks in parallel.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(location)
    )
    partition = F.rtrim(F.regexp_extract(_below(F.col("path"), location), _PARTITION_RUN, 1), F.lit("/"))
    return files.select("path", "modificationTime", "length", partition.alias("partition"))


def require_depth(files: DataFrame, location: str, partitions: Sequence[str]) -> None:
    """Refuse files that do not lie where a table with these partition columns looks.

    Such a table reads what is directly below its partitions. One without partition
    columns reads every folder, so that nothing lies too deep.
    """
    if not partitions:
        return
    keys = F.regexp_extract_all("partition", F.lit(_PARTITION_KEY), F.lit(1))
    folder = F.regexp_extract(_below(F.col("path"), location), r"^(.*?)/*[^/]+$", 1)
    expected = F.array(*[F.lit(p) for p in partitions])
    strays = files.where((keys != expected) | (F.trim(folder, F.lit("/")) != F.col("partition")))
    found = [r.path for r in strays.select("path").orderBy("path").limit(5).collect()]
    if found:
        raise ValueError(f"files that are not directly below {'/'.join(partitions)}: {found}")


def partition_columns(files: DataFrame) -> list[str]:
    """Names of the partition columns, from the directories of a listing."""
    keys = F.regexp_extract_all("partition", F.lit(_PARTITION_KEY), F.lit(1))
    found = files.groupBy(keys.alias("keys")).agg(F.min("path").alias("example")).orderBy("example").limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"files lie at different partition depths: {[r.example for r in found]}")
    return list(found[0]["keys"]) if found else []
