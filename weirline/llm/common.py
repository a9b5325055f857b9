"""Reading tables, cutting lineage and walking Arrow batches, for every operator here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.scratch import new_workspace

#: Text that one step inside a Python task works on at a time, unless one text alone is longer.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Lineage ends there: a lost executor costs a read of the files, not a second
    run of what made them. Shuffle files of the write go when it has ended.
    """
    spark = df.sparkSession
    path = new_workspace(spark, f"llm-{label}")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def kept() -> dict:
    """A dictionary that lasts as long as the Python worker, from task to task."""
    import sys
    import types

    return sys.modules.setdefault("_weirline_llm_kept", types.ModuleType("_weirline_llm_kept")).__dict__


def sha256_of(texts: list[bytes]) -> list[str]:
    import hashlib

    return [hashlib.sha256(t).hexdigest() for t in texts]


def row_id(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by what it holds; equal rows share it."""
    both = (doc_id.cast("string"), text)
    return F.md5(F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in both]))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(text_lengths(batch.column(column))))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_lengths(texts: pa.Array) -> np.ndarray:
    offsets, _ = utf8(texts)
    return np.diff(offsets)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts, from 0) and all bytes. A null text is empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], whole[ends[0] : ends[-1]]


def carry(
    df: DataFrame,
    inputs: dict[str, Column],
    compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    outputs: str,
) -> DataFrame:
    """The frame's rows with more columns, computed on Arrow batches.

    ``compute`` gets batches of the ``inputs`` beside a column ``_row`` with the
    whole row, and yields batches of ``_row`` and the ``outputs`` (a DDL string).
    """
    columns = [F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in inputs.items()]]
    packed = df.select(*columns)
    schema = T.StructType([packed.schema["_row"], *T._parse_datatype_string(outputs).fields])
    return packed.mapInArrow(compute, schema)


def unpacked(df: DataFrame, *extra: Column) -> DataFrame:
    """What :func:`carry` put into ``_row``, and some of the new columns."""
    return df.select("_row.*", *extra)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One list per row from values in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, …`` for each start, ``count`` of them."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(total)
