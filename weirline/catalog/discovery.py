"""Headers of the raw files seen so far, so that discovery opens only new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.sources.files import list_files
from weirline.sources.layouts import HEADER_SCHEMA, Discovery, can_open, file_headers, find_layouts


_VERSION = ["path", "modificationTime"]


class HeaderLedger:
    """A Parquet table with one row per raw file version and its header line.

    A file is known by path and modification time, so a rewritten file is looked
    at again. Losing the ledger costs a full discovery and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path

    def _known(self) -> DataFrame:
        return self._spark.read.schema(HEADER_SCHEMA).parquet(self._path)

    def refresh(self, listed: DataFrame, location: str, pattern: str = "*", scan: bool | None = None) -> int:
        """Look at the listed files that are not known yet; give their number."""
        self._spark.createDataFrame([], HEADER_SCHEMA).write.mode("ignore").parquet(self._path)
        new = listed.join(self._known().select(*_VERSION), _VERSION, "left_anti")
        count, example = new.agg(F.count(F.lit(1)), F.min("path")).first()
        if count:
            if scan is None:
                scan = not can_open(example)
            found = file_headers(self._spark, location, new, count, pattern, scan)
            found.hint("rebalance").write.mode("append").option("compression", "snappy").parquet(self._path)
        return count

    def current(self, listed: DataFrame) -> DataFrame:
        """Headers of the file versions that are listed."""
        return self._known().join(listed.select(*_VERSION), _VERSION, "left_semi").dropDuplicates(_VERSION)


def known_headers(
    spark: SparkSession, location: str, state_path: str, pattern: str, scan: bool | None, listed: DataFrame
) -> DataFrame:
    """Header lines of the listed files that are not empty; only new files are opened."""
    listed = listed.where("length > 0")
    ledger = HeaderLedger(spark, f"{state_path}/headers")
    ledger.refresh(listed, location, pattern, scan)
    return ledger.current(listed)


def discover(
    spark: SparkSession,
    location: str,
    state_path: str,
    pattern: str = "*",
    scan: bool | None = None,
    listed: DataFrame | None = None,
) -> Discovery:
    """Header lines of the files below ``location`` that are not empty.

    Every visible file counts unless ``pattern`` says otherwise. The location is
    listed once, or not at all where its listing is given, and only files not seen before are opened. They
    are opened where they are; ``scan`` reads them through Spark instead, which
    is also what happens on storage that only the JVM can reach.
    """
    listed = list_files(spark, location, pattern) if listed is None else listed
    headers = known_headers(spark, location, state_path, pattern, scan, listed)
    return Discovery(location, headers, find_layouts(headers), pattern, state_path)
