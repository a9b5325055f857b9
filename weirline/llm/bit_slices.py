"""Exact top-k by integer inner product: a bit-sliced index.

Components become whole numbers, ``floor(STEPS * x)``. Rows are dealt by hash to blocks of
about ``BLOCK``; a block keeps for every attribute one bitmap for each of the ``KEPT`` most
significant bits of its values above the block's least one, a slice.

A query adds slices with bitmap arithmetic only. Its weight for an attribute is written
with digits -1, 0 and 1, no two beside each other unless one is 0; a digit 1 adds the
attribute's slices at its place, a digit -1 their complements, which is a subtraction but for a constant.
Slices of one place are added three at a time, sum and carry, until one is left. The sums
are slices of the score, less than what the bits that were left out can add, whose range
is known from the weights. From the most significant slice downward the k-th largest sum
is found, and by comparing slices with a constant all rows that can still reach it. Those
boundary rows get their inner product in whole numbers, so the answer is exact.

In Spark, blocks and blocks of ``QUERY_BLOCK`` queries are rows. A task is one block with
up to ``QUERIES`` queries, of which it holds one query block at a time; it returns k rows
a query, and a window keeps the best. What grows with the square of the table is the time
of the sums alone. Sides are never collected.

Defined cases: vectors that are null, that hold a null or non-finite component or one
whose ``STEPS`` fold is beyond a double, and rows without id take no part. Candidates are the
rows with the query's length (a vector of no components scores 0 with its like). Rows that
are equal in id and whole numbers are one row; rows of the query's id are its own and no
candidates; an id with several vectors is a row for each, as a candidate and as a query.
Ties go to the smaller id; with fewer rows than k all are returned. A score beyond a long
is clipped to it, and ordered there as a double. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, spread, table

STEPS = 256
NEIGHBOURS = 5
BLOCK = 16384
QUERY_BLOCK = 256
QUERIES = 4096
KEPT = 6
MAX_TASKS = 1 << 16

_SAFE = 1 << 61
_LONG = 1 << 63


def quantised(vectors: DataFrame, steps: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vec (whole numbers, as doubles) of the rows that take part, equal ones once."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    folds = F.transform("vec", lambda x: x * F.lit(float(steps)))
    finite = F.forall(folds, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles of this size have no fraction; a long could not hold them.
    whole = F.transform(folds, lambda x: F.when(F.abs(x) < float(_SAFE), F.floor(x).cast("double")).otherwise(x))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("vec")).distinct()


def _numbers(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them; doubles beyond a long."""
    most = float(np.abs(values).max()) if values.size else 0.0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8" if most < _SAFE else "<f8"
    return kind, values.astype(kind).tobytes()


def _read_numbers(kind: str, data: bytes, dim: int, n: int) -> np.ndarray:
    """A row for each vector: longs, or Python's numbers where those do not hold them."""
    values = np.frombuffer(data, kind).reshape(n, dim)
    if kind != "<f8":
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(n, dim)


def _packed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ties and vectors of a group in order of id."""
    order = group.sort_by([("vec_id", "ascending"), ("tie", "ascending")])
    n = order.num_rows
    vec = order["vec"].combine_chunks()
    matrix = np.asarray(vec.flatten(), np.float64).reshape(n, -1) if len(vec.flatten()) else np.zeros((n, 0))
    return np.asarray(order["vec_id"], np.int64), np.asarray(order["tie"], np.int64), matrix


_PACK = "dim int, part bigint, n int, ids binary, ties binary, kind string, numbers binary, slices binary"


def _widths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each attribute, and the bits of the largest above it."""
    low = values.min(axis=0) if values.size else np.zeros(values.shape[1], values.dtype)
    high = values.max(axis=0) if values.size else low
    return low, np.array([int(h - l).bit_length() for h, l in zip(high, low)], np.int64)


def slices_of(values: np.ndarray, kept: int) -> np.ndarray:
    """The bitmaps of a block, attribute by attribute from the least significant one that is kept."""
    n, dim = values.shape
    low, width = _widths(values)
    words = -(-n // 64)
    maps = []
    for j in range(dim):
        above = values[:, j] - low[j]
        for bit in range(max(0, width[j] - kept), width[j]):
            bits = np.zeros(words * 64, np.uint8)
            bits[:n] = (above >> bit) & 1
            maps.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return np.array(maps, np.uint64).reshape(len(maps), words)


def _pack(kept: int | None):
    """One row for a group: its vectors, and their slices if it is a block of the index."""

    def pack(group: pa.Table) -> pa.Table:
        ids, ties, matrix = _packed(group)
        kind, numbers = _numbers(matrix)
        n, dim = matrix.shape
        maps = slices_of(_read_numbers(kind, numbers, dim, n), kept).tobytes() if kept is not None else b""
        row = [dim, group["part"][0].as_py(), n, ids.tobytes(), ties.tobytes(), kind, numbers, maps]
        return pa.table([[x] for x in row], schema=_ARROW)

    return pack


_ARROW = pa.schema(
    [
        ("dim", pa.int32()),
        ("part", pa.int64()),
        ("n", pa.int32()),
        ("ids", pa.binary()),
        ("ties", pa.binary()),
        ("kind", pa.string()),
        ("numbers", pa.binary()),
        ("slices", pa.binary()),
    ]
)


@dataclass
class Block:
    """A block of the index, ready for queries."""

    ids: np.ndarray
    values: np.ndarray
    kept: np.ndarray  #: slices of each attribute
    left_out: np.ndarray  #: bits below them
    first: np.ndarray  #: its first slice
    low: np.ndarray
    maps: np.ndarray  #: slices, then their complements
    rows: np.ndarray  #: bitmap of the rows there are

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray, slices: np.ndarray, kept: int) -> Block:
        low, width = _widths(values)
        mine = np.minimum(width, kept)
        bits = np.zeros(slices.shape[1] * 64, np.uint8)
        bits[: len(ids)] = 1
        rows = np.packbits(bits, bitorder="little").view(np.uint64)
        return cls(ids, values, mine, width - mine, np.cumsum(mine) - mine, low, np.concatenate([slices, ~slices]), rows)


def _digits(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each weight as the difference of two numbers that have no bits in common, nor beside each other."""
    half = weights >> 1
    whole = weights + half
    change = half ^ whole
    return whole & change, half & change


def _ones(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attribute and place of each bit that is set."""
    most = max((int(x).bit_length() for x in numbers), default=0)
    return np.nonzero((numbers[:, None] >> np.arange(most).astype(numbers.dtype)) & 1)


def weighted_sum(block: Block, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of a number for each row, and how much the score's rest can differ between rows.

    The score of a row is that number, a constant and a rest in that range.
    """
    plus, minus = _digits(weights)
    rows, places = [], []
    for numbers, side in ((plus, 0), (minus, len(block.maps) // 2)):
        attribute, place = _ones(numbers)
        counts = block.kept[attribute]
        at = spread(np.zeros(len(counts), np.int64), counts)
        rows.append(np.repeat(block.first[attribute] + side, counts) + at)
        places.append(np.repeat(place + block.left_out[attribute], counts) + at)
    row, place = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    slack = sum(abs(int(w)) * ((1 << int(d)) - 1) for w, d in zip(weights, block.left_out) if d and w)
    return add_slices(block.maps, row, place), slack


def add_slices(maps: np.ndarray, row: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The sum of bitmaps, each with a place (in order), as bitmaps from the lowest place on."""
    result: list[np.ndarray] = []
    carry = maps[:0]
    last = int(place[-1]) if len(place) else -1
    cuts = np.searchsorted(place, np.arange(last + 2))
    while len(result) <= last or len(carry):
        p = len(result)
        here = np.concatenate([maps[row[cuts[p] : cuts[p + 1]]], carry]) if p <= last else carry
        carries = []
        while len(here) > 2:
            t = len(here) // 3
            a, b, c = here[:t], here[t : 2 * t], here[2 * t : 3 * t]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            here = np.concatenate([odd ^ c, here[3 * t :]])
        if len(here) == 2:
            carries.append(here[:1] & here[1:])
            here = here[:1] ^ here[1:]
        result.append(here[0] if len(here) else np.zeros(maps.shape[1], np.uint64))
        carry = np.concatenate(carries) if carries else maps[:0]
    return result


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows`` (k at least), from the most significant slice downward."""
    above, equal, value = np.zeros_like(rows), rows, 0
    for place in range(len(slices) - 1, -1, -1):
        with_bit = equal & slices[place]
        reached = above | with_bit
        if int(np.bitwise_count(reached).sum()) >= k:
            equal = with_bit
            value |= 1 << place
        else:
            above, equal = reached, equal & ~slices[place]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Those of ``rows`` whose sum is ``value`` or more."""
    if value <= 0:
        return rows
    if value.bit_length() > len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for place in range(len(slices) - 1, -1, -1):
        if value >> place & 1:
            equal = equal & slices[place]
        else:
            above = above | (equal & slices[place])
            equal = equal & ~slices[place]
    return above | equal


def top_rows(block: Block, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, scores and scores as doubles of a query's k best rows of a block."""
    rows = block.rows
    a, b = np.searchsorted(block.ids, [own, own + 1]) if own < _LONG - 1 else (np.searchsorted(block.ids, own), len(block.ids))
    if a < b:
        bits = np.unpackbits(rows.view(np.uint8), bitorder="little")
        bits[a:b] = 0
        rows = np.packbits(bits, bitorder="little").view(np.uint64)
    if int(np.bitwise_count(rows).sum()) > k:
        slices, slack = weighted_sum(block, weights)
        rows = at_least(slices, rows, kth_largest(slices, rows, k) - slack)
    there = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[: len(block.ids)])
    values = block.values[there]
    most = [int(np.abs(v).max()) if v.size else 0 for v in (values, weights)]
    if most[0] * most[1] * max(1, len(weights)) < _SAFE:
        score = values.astype(np.int64) @ weights.astype(np.int64)
        as_double = score.astype(np.float64)
    else:
        exact = [sum(int(x) * int(w) for x, w in zip(v, weights)) for v in values]
        score = np.array([min(max(s, -_LONG), _LONG - 1) for s in exact], np.int64)
        as_double = np.array([float(s) if abs(s) < 1 << 1000 else math.inf if s > 0 else -math.inf for s in exact])
    order = np.lexsort((block.ids[there], -as_double, ~score))[:k]
    return block.ids[there][order], score[order], as_double[order]


def _answer(k: int, kept: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                dim, n = row["dim"], row["n"]
                ids = np.frombuffer(row["ids"], np.int64)
                values = _read_numbers(row["kind"], row["numbers"], dim, n)
                if not row["asks"]:
                    slices = np.frombuffer(row["slices"], np.uint64).reshape(-1, -(-n // 64))
                    block = Block.of(ids, values, slices, kept)
                    continue
                ties = np.frombuffer(row["ties"], np.int64)
                found = [top_rows(block, int(q), w, k) for q, w in zip(ids, values)]
                counts = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, counts)),
                        pa.array(np.repeat(ties, counts)),
                        *[pa.array(np.concatenate([f[c] for f in found])) for c in range(3)],
                    ],
                    names=["query_id", "tie", "vec_id", "score", "as_double"],
                )

    return answer


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    steps: int = STEPS,
    block: int = BLOCK,
    kept: int = KEPT,
    queries: int = QUERIES,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = quantised(vectors, steps, vec_id, embedding)
    rows = rows.select("vec_id", "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("tie"))
    rows = materialise(rows.withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    # One row for each length that vectors have.
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.count_if("asks") / QUERY_BLOCK).alias("query_blocks")
    )
    groups = F.ceil(F.col("query_blocks") * QUERY_BLOCK / queries)
    sizes = materialise(sizes.withColumn("groups", groups).where("query_blocks > 0"), "sizes")
    n_tasks = sizes.agg(F.sum(F.col("blocks") * F.col("groups"))).first()[0] or 1
    sizes = F.broadcast(sizes)

    def dealt(some: DataFrame, parts: str, pack) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", "tie"), F.col(parts)).alias("part")
        placed = some.join(sizes, "dim").select("dim", "vec_id", "tie", "vec", part)
        return placed.groupBy("dim", "part").applyInArrow(pack, _PACK)

    index = materialise(dealt(rows, "blocks", _pack(kept)), "index")
    asking = materialise(dealt(rows.where("asks"), "query_blocks", _pack(None)), "queries")
    blocks = index.join(sizes, "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    blocks = blocks.select("dim", F.col("part").alias("block"), "group", F.lit(False).alias("asks"), *index.columns[2:])
    asked = asking.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = F.floor(F.col("part") * QUERY_BLOCK / queries)
    asked = asked.select("dim", "block", mine.alias("group"), F.lit(True).alias("asks"), *index.columns[2:])
    task = ("dim", "block", "group")
    found = (
        blocks.unionByName(asked)
        .repartition(min(int(n_tasks), MAX_TASKS), *task)
        .sortWithinPartitions(*task, "asks")
        .mapInArrow(_answer(k, kept), "query_id bigint, tie bigint, vec_id bigint, score bigint, as_double double")
    )
    best = Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), F.desc("as_double"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: the highest inner products of every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
