"""Approximate nearest neighbours by cosine: a forest of long hash strings.

Every tree turns a vector into a string of ``STRING_BITS`` bits and keeps the strings of all
rows sorted. Bit ``d`` says on which side of a cut the vector's projection on the tree's
``d``-th random line lies. For the first bits each prefix has a cut of its own, the median
of the rows with that prefix, so the rows of a prefix are halved with each bit however
close together they lie, and a dense cluster, whatever its share of the table, is cut as
finely as the rest and along other lines in every tree. Further bits are plain signs.

A query descends in every tree to the rows that share its longest prefixes, and ascends in
all trees at once: the level is lowered bit by bit until the rows that share so many bits
with it, over all trees, are as many as the budget says. These are its candidates, and
they are scored exactly.

In Spark, cuts are medians of a sample of ``LEAF_SAMPLE`` rows a prefix, taken by hash; they
are what is broadcast, at most trees times ``2 ** MAX_FITTED`` numbers, with as many sizes of
parts. The rows of a tree lie in parts, one for each prefix of a length at which about
``PART_ROWS`` to twice as many share it. A first round counts, in the part that holds a
query's string, the rows on each of its levels; levels above the part are sums of sizes
of parts. A second round scores the rows of the level chosen, in as many parts as it
takes. So every row of the prefix is counted and scored, and no task holds more than
a part. Nothing is different for small tables.

Equal vectors are one class in the index, with the smallest ids of its rows, so that
any number of copies costs one entry. Vectors that differ in length only have equal
projections; noise from a class's own hash, below any difference that matters, halves
them too.

The budget follows the number of vectors, ``BUDGET * n ** POWER`` rows a side and
tree: the share of rows that must be looked at for the same recall at any size when
neighbours have a cosine near 0.4, as in the given table; closer neighbours take
less. ``recall`` measures against brute force.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite part,
and rows without id, take no part, nor do vectors of another length than most; rows
with the query's own id are no candidates for it; an id is listed once for a query;
ties go to the smaller id; fewer rows than asked for are returned if there are no more;
vectors of any magnitude are scaled by a power of two before they are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ragged, table

TREES = 32
PART_ROWS = 8192
LEAF_SAMPLE = 128
MAX_FITTED = 14
STRING_BITS = 32
BUDGET = 0.5
POWER = 0.65
NEIGHBOURS = 5
SEED = 20

_NOISE = 1e-11


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    fit = F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))


def _smallest_ids(keep: int):
    """Per batch, equal vectors as one row with their smallest ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found: dict[tuple, list[int]] = {}
            for i, vec in zip(batch["vec_id"].to_pylist(), batch["vec"].to_pylist()):
                found.setdefault(tuple(x + 0.0 for x in vec), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.list_(pa.float64())),
                    pa.array([sorted(set(ids))[:keep] for ids in found.values()], pa.list_(pa.int64())),
                ],
                names=["vec", "ids"],
            )

    return gather


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: cls, tie (a hash), vec, ids (the smallest k + 1)."""
    merged = rows.mapInArrow(_smallest_ids(k + 1), "vec array<double>, ids array<bigint>").groupBy("vec")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return merged.agg(ids.alias("ids")).select(
        F.monotonically_increasing_id().alias("cls"), F.xxhash64("vec").alias("tie"), "vec", "ids"
    )


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * STRING_BITS))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def _noise(tie: np.ndarray, count: int) -> np.ndarray:
    """Numbers from 0 to 1 for each class, others for every tree and bit."""
    x = tie.astype(np.uint64)[:, None] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish."""
    exponent = np.frexp(np.abs(matrix).max(axis=1, initial=0, keepdims=True))[1]
    return np.ldexp(matrix, -exponent)


def places_of(matrix: np.ndarray, tie: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """Where each vector's direction lies on the lines of each tree."""
    unit = scaled(matrix)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    places = unit @ planes + _NOISE * _noise(tie, planes.shape[1])
    return places.reshape(len(matrix), trees, -1)


def strings_of(places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The string of each row of one tree, as a number; cuts are in the order of a heap."""
    fitted = int(len(cuts) + 1).bit_length() - 1
    node = np.zeros(len(places), np.int64)
    for bit in range(fitted):
        node = 2 * node + 1 + (places[:, bit] > cuts[node])
    string = node - len(cuts)
    for bit in range(fitted, places.shape[1]):
        string = 2 * string + (places[:, bit] > 0)
    return string


def cuts_of(places: np.ndarray) -> np.ndarray:
    """The median of each prefix's rows on its line."""
    bits = places.shape[1]
    cuts = np.zeros(2**bits - 1)
    node = np.zeros(len(places), np.int64)
    for bit in range(bits):
        order = np.lexsort((places[:, bit], node))
        found, first, size = np.unique(node[order], return_index=True, return_counts=True)
        sorted_places = places[order, bit]
        cuts[found] = (sorted_places[first + (size - 1) // 2] + sorted_places[first + size // 2]) / 2
        node = 2 * node + 1 + (places[:, bit] > cuts[node])
    return cuts


def _cuts(classes: DataFrame, n: int, dim: int, trees: int, bits: int) -> np.ndarray:
    """The cuts of all trees, from a sample."""
    one_in = max(1, n // (LEAF_SAMPLE * 2**bits))

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                places = places_of(_matrix(batch["vec"]), np.asarray(batch["tie"]), planes, trees)[:, :, :bits]
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(places), tree, np.int32)), pa.array(list(places[:, tree]), pa.list_(pa.float64()))],
                        names=["tree", "places"],
                    )

    def fit(group: pa.Table) -> pa.Table:
        cuts = cuts_of(_matrix(group["places"].combine_chunks()))
        return pa.table({"tree": group["tree"][:1], "cuts": pa.array([cuts], pa.list_(pa.float64()))})

    sample = classes.where(F.pmod(F.xxhash64("tie"), F.lit(one_in)) == 0).select("vec", "tie")
    placed = sample.mapInArrow(place_rows, "tree int, places array<double>")
    fitted = placed.groupBy("tree").applyInArrow(fit, "tree int, cuts array<double>").collect()
    cuts = np.zeros((trees, 2**bits - 1))
    for row in fitted:
        cuts[row["tree"]] = row["cuts"]
    return cuts


def _with_strings(classes: DataFrame, dim: int, cuts: np.ndarray) -> DataFrame:
    """cls, vec and the string of each tree."""
    trees = len(cuts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                places = places_of(_matrix(batch["vec"]), np.asarray(batch["tie"]), planes, trees)
                strings = np.stack([strings_of(places[:, tree], cuts[tree]) for tree in range(trees)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch["cls"], batch["vec"], ragged(strings.ravel(), np.full(len(strings), trees))],
                    names=["cls", "vec", "strings"],
                )

    return classes.select("cls", "tie", "vec").mapInArrow(add, "cls bigint, vec array<double>, strings array<bigint>")


def prefix_range(strings: np.ndarray, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, in sorted strings, those begin and end that share ``level`` bits with one's own."""
    shift = STRING_BITS - level
    low = (own >> shift) << shift
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << shift))


def _level_counts(depth: int, sizes: np.ndarray):
    """For each query of a part, how many rows share so many bits with it, by level."""

    def count(key: tuple, group: pa.Table) -> pa.Table:
        tree, part = (int(k.as_py()) for k in key)
        asks = np.asarray(group["asks"])
        strings = np.asarray(group["string"])
        rows, own = np.sort(strings[~asks]), strings[asks]
        above = [sizes[tree].reshape(1 << level, -1).sum(axis=1)[part >> (depth - level)] for level in range(depth)]
        counts = [np.full(len(own), n) for n in above]
        for level in range(depth, STRING_BITS + 1):
            first, last = prefix_range(rows, own, np.full(len(own), level, np.int64))
            counts.append(last - first)
        table = np.stack(counts, axis=1).astype(np.int64) if len(own) else np.zeros((0, STRING_BITS + 1), np.int64)
        return pa.table({"cls": group["cls"].filter(pa.array(asks)), "counts": ragged(table.ravel(), np.full(len(own), STRING_BITS + 1))})

    return count


def _best(k: int):
    def score(group: pa.Table) -> pa.Table:
        order = group.filter(pc.invert(group["asks"])).sort_by("string")
        queries = group.filter(group["asks"])
        schema = pa.struct([("away", pa.float64()), ("cls", pa.int64())])
        best: list[list[dict]] = [[] for _ in range(queries.num_rows)]
        if order.num_rows and queries.num_rows:
            matrix = scaled(_matrix(order["vec"].combine_chunks()))
            norm = np.sqrt((matrix * matrix).sum(axis=1))
            cls = np.asarray(order["cls"])
            first, last = prefix_range(np.asarray(order["string"]), np.asarray(queries["string"]), np.asarray(queries["level"], np.int64))
            for i, vec in enumerate(scaled(_matrix(queries["vec"].combine_chunks()))):
                mine = slice(first[i], last[i])
                near = (matrix[mine] * vec).sum(axis=1) / (norm[mine] * np.sqrt((vec * vec).sum()))
                top = np.arange(len(near))
                if len(near) > k:
                    least = np.partition(near, len(near) - k)[len(near) - k]
                    top = np.flatnonzero(near >= least)
                best[i] = [{"away": -s, "cls": c} for s, c in zip(near[top].tolist(), cls[mine][top].tolist())]
        return pa.table({"cls": queries["cls"], "best": pa.array(best, pa.list_(schema))})

    return score


def _levels(coded: DataFrame, asked: DataFrame, depth: int, trees: int, wanted: int) -> DataFrame:
    """cls and level of each query: the most bits that, over all trees, ``wanted`` rows or more share with it."""

    def parts(df: DataFrame, asks: bool) -> DataFrame:
        each = df.select("cls", F.posexplode("strings").alias("tree", "string"))
        return each.select("cls", "tree", _part("string", depth), "string", F.lit(asks).alias("asks"))

    sizes = np.zeros((trees, 1 << depth), np.int64)
    for row in parts(coded, False).groupBy("tree", "part").count().collect():
        sizes[row["tree"], row["part"]] = row["count"]
    counts = parts(coded, False).unionByName(parts(asked, True)).groupBy("tree", "part")
    counts = counts.applyInArrow(_level_counts(depth, sizes), "cls bigint, counts array<bigint>")
    every = counts.groupBy("cls").agg(F.collect_list("counts").alias("trees"))
    totals = F.transform(
        F.sequence(F.lit(0), F.lit(STRING_BITS)),
        lambda level: F.aggregate("trees", F.lit(0).cast("bigint"), lambda n, counts: n + F.get(counts, level)),
    )
    enough = F.size(F.filter(totals, lambda n: n >= wanted))
    return every.select("cls", F.greatest(enough - 1, F.lit(0)).alias("level"))


def _part(string: str, depth: int) -> Column:
    return F.shiftright(string, STRING_BITS - depth).cast("int").alias("part")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    trees: int = TREES,
    budget: float = BUDGET,
    part_rows: int = PART_ROWS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = usable(vectors, vec_id, embedding)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    rows = rows.where(F.size("vec") == dim)
    classes = materialise(classes_of(rows, k), "vectors")
    n = classes.count()
    a_side = max(64, math.ceil(budget * n**POWER))
    halvings = math.log2(max(2.0, n / (2 * a_side)))
    fitted = min(MAX_FITTED, math.ceil(halvings) + 2)
    depth = min(fitted, max(0, int(math.log2(max(1.0, n / part_rows)))))
    cuts = _cuts(classes, n, dim, trees, fitted)
    coded = materialise(_with_strings(classes, dim, cuts), "strings")

    asking = materialise(
        rows.where(is_query).distinct().join(classes.select("vec", "cls"), "vec").select("vec_id", "cls"), "queries"
    )
    asked = coded.join(asking.select("cls").distinct(), "cls")
    levels = materialise(_levels(coded, asked, depth, trees, 2 * a_side * trees), "levels")

    index = coded.select("cls", "vec", F.posexplode("strings").alias("tree", "string"))
    index = index.select("tree", _part("string", depth), "cls", "string", F.lit(0).alias("level"), "vec", F.lit(False).alias("asks"))
    visits = asked.join(levels, "cls").select("cls", "vec", "level", F.posexplode("strings").alias("tree", "string"))
    # A prefix shorter than a part's has several parts, side by side.
    wide = f"greatest({depth} - level, 0)"
    first = f"shiftleft(shiftright(string, {STRING_BITS - depth} + {wide}), {wide})"
    part = F.expr(f"explode(sequence({first}, {first} + shiftleft(1L, {wide}) - 1))").alias("part")
    visits = visits.select("tree", part, "cls", "string", "level", "vec")
    visits = visits.select("tree", F.col("part").cast("int").alias("part"), "cls", "string", "level", "vec", F.lit(True).alias("asks"))
    scored = index.unionByName(visits).groupBy("tree", "part").applyInArrow(
        _best(k + 1), "cls bigint, best array<struct<away:double,cls:bigint>>"
    )
    pairs = scored.select(F.col("cls").alias("of"), F.explode("best").alias("b"))
    found = pairs.groupBy("of", F.col("b.cls").alias("cls")).agg(F.min("b.away").alias("away"))
    nearest = found.join(classes.select("cls", F.array_min("ids").alias("first")), "cls")
    best = F.slice(F.array_sort(F.collect_list(F.struct("away", "first", "cls"))), 1, k + 1)
    nearest = nearest.groupBy("of").agg(best.alias("best")).select("of", F.explode("best").alias("b"))
    with_ids = nearest.select("of", "b.away", F.col("b.cls").alias("cls")).join(classes.select("cls", "ids"), "cls")
    near = with_ids.groupBy("of").agg(F.collect_list(F.struct("away", "ids")).alias("near"))
    answers = asking.join(near, F.col("cls") == F.col("of")).select("vec_id", F.col("near"))
    pairs = F.flatten(
        F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct(c["away"].alias("away"), i.alias("id"))))
    )
    others = F.array_sort(F.filter(pairs, lambda p: p["id"] != F.col("vec_id")))
    return (
        answers.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("pos", "p"))
        .select(
            "query_id",
            (F.col("pos") + 1).cast("int").alias("rank"),
            F.col("p.id").alias("vec_id"),
            (-F.col("p.away")).alias("score"),
        )
    )


def recall(found: DataFrame, vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, block: int = 64) -> float:
    """The share of the true k nearest that ``found`` has, queries against all rows in blocks.

    Every block of queries is one pass over the table that keeps each task's best k.
    """
    rows = usable(vectors)
    asked = rows.where(is_query).orderBy("vec_id").collect()
    mine = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    right = total = 0
    for at in range(0, len(asked), block):
        ids = [r["vec_id"] for r in asked[at : at + block]]
        matrix = np.array([r["vec"] for r in asked[at : at + block]])

        def best(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            unit = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            for batch in batches:
                if not batch.num_rows:
                    continue
                all_ids, vecs = np.asarray(batch["vec_id"]), _matrix(batch["vec"])
                near = unit @ (vecs / np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))).T
                for q, scores in zip(ids, near):
                    scores = np.where(all_ids == q, -np.inf, scores)
                    top = np.lexsort((all_ids, -scores))[:k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([q] * len(top)), pa.array(all_ids[top]), pa.array(scores[top])],
                        names=["query_id", "vec_id", "score"],
                    )

        near = rows.mapInArrow(best, "query_id bigint, vec_id bigint, score double").where(F.col("score") > -2)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        true = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()
        total += len(true)
        right += sum((r["query_id"], r["vec_id"]) in mine for r in true)
    return right / total if total else 1.0


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: the nearest neighbours of every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
