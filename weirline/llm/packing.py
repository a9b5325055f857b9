"""Best-fit packing under conflicts: documents into training sequences of equal size.

Texts are cut into pieces of at most ``capacity`` words. Within a shard, pieces are
placed largest first, each into the bin that it fills best among those it may enter:
a bin takes at most one document of a duplicate cluster, and at most one of a source
if ``by_source`` is set. Bins are kept in order of what is left in them, and carry
bitmaps of the sources and clusters they hold. The search starts at the tightest bin
that has room and goes on to its successors until one is compatible; if none is, a
new bin is opened.

Shards of about ``shard_rows`` documents are drawn by a hash of the row, so that a
source or cluster with a third of all rows has a third of every shard rather than a
shard of its own, and one shard fits one task. Rows that are equal are numbered for it. Only sizes, sources and clusters travel
to the shards, never texts. Bins of different shards are not merged, so each shard
may leave its last bins part empty: at most a bin or so in a thousand at the default.

Defined cases: a null or wordless text has no piece and one row without a bin; a null
source or cluster conflicts with nothing; pieces of one document may share a bin with
each other only if there is no duplicate rule, being of one cluster; ties in size go
by id, then by hash, rows that are equal are packed each; an empty table gives no
rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordhash import grouped

CAPACITY = 2048
SHARD_ROWS = 4096
_COPY_BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset in it of each piece, given in the order of placing.

    ``sources`` and ``clusters`` number what conflicts, 0 for none.
    """
    order: list[tuple[int, int]] = []  # what is left, bin
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed: list[tuple[int, int]] = []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit = 1 << source if source else 0
        cluster_bit = 1 << cluster if cluster else 0
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (source_bits[b] & source_bit or cluster_bits[b] & cluster_bit):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= source_bit
        cluster_bits[b] |= cluster_bit
        placed.append((b, capacity - left))
        if left > size:
            insort(order, (left - size, b))
    return placed


def _numbered(values: list) -> list[int]:
    """A number from 1 for each value that comes more than once, 0 for others and null."""
    times = Counter(v for v in values if v is not None)
    numbers = {v: n for n, v in enumerate((v for v, t in times.items() if t > 1), 1)}
    return [numbers.get(v, 0) for v in values]


def best_fit(
    docs: DataFrame,
    size: Column,
    cluster: Column,
    source: Column | None = None,
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    draw: Column | None = None,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start (in the document), n_words, bin (null without words), bin_start."""
    cluster = cluster.cast("string")
    source = F.lit(None).cast("string") if source is None else source.cast("string")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        cluster.alias("cluster"),
        source.alias("source"),
        (F.lit(0) if draw is None else draw).cast("bigint").alias("draw"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    # Rows that are equal are counted first and told apart by a number, so that they spread over all shards.
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / _COPY_BLOCK))
    equal = equal.withColumn("block", F.explode(F.transform(blocks, lambda b: b * _COPY_BLOCK)))
    last = F.least(F.col("copies"), F.col("block") + _COPY_BLOCK) - 1
    rows = equal.withColumn("copy", F.explode(F.sequence("block", last))).drop("copies", "block")
    drawn = F.when(F.col("copy") == 0, F.xxhash64("doc_id", "draw", "size")).otherwise(
        F.xxhash64("doc_id", "draw", "size", "copy")
    )
    rows = rows.withColumn("shard", F.pmod(drawn, F.lit(shards)).cast("int"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("shard",), 1):
            shard = group["shard"][0].as_py()
            words = np.asarray(group["size"])
            pieces = np.maximum(-(-words // capacity), 1)
            row = np.repeat(np.arange(len(words)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.minimum(words[row] - piece * capacity, capacity)
            sources = np.array(_numbered(group["source"].to_pylist()))[row]
            clusters = np.array(_numbered([group["cluster"][int(r)].as_py() for r in row]))
            first = np.argsort(-n, kind="stable")  # rows come in order of id and hash
            first = first[n[first] > 0]
            bins = np.full(len(row), -1, np.int64)
            offset = np.zeros(len(row), np.int64)
            placed = pack(n[first].tolist(), sources[first].tolist(), clusters[first].tolist(), capacity)
            if placed:
                bins[first], offset[first] = np.array(placed).T
            yield pa.RecordBatch.from_arrays(
                [
                    group["doc_id"].combine_chunks().take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * capacity),
                    pa.array(n),
                    pa.array((np.int64(shard) << 32) + bins, mask=bins < 0),
                    pa.array(offset, mask=bins < 0),
                ],
                names=["doc_id", "piece", "start", "n_words", "bin", "bin_start"],
            )

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "draw", "size", "cluster", "source")
    return dealt.mapInArrow(place, "doc_id bigint, piece int, start bigint, n_words bigint, bin bigint, bin_start bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, by_source: bool = False, **options) -> DataFrame:
    """Pack documents by their words; equal texts are one duplicate cluster."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    tie = F.xxhash64("text")
    source = F.col("source") if by_source else None
    return best_fit(docs, words, tie, source, capacity=capacity, draw=tie, **options)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: where the pieces of each document are packed."""
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs.select("doc_id", "text", "source"), by_source=True)
