"""N-gram Jaccard join: MinHash bands find pairs, full n-gram sets decide them.

A document's set holds its runs of ``SHINGLE`` words (runs without white space,
unchanged); one of fewer words has all of them as its only run. Documents with equal
sets are one class. Bands and rows follow from the threshold and the recall wanted;
classes that agree in a band meet in its bucket.

A bucket of more than ``BLOCK`` classes is cut into blocks, and each pair of blocks
is a task of its own, so no task holds more than two blocks. A pair of classes is
looked at only in the first band it agrees in. Tasks work in two rounds. The first
has MinHash values only, and drops pairs whose estimate lies five standard deviations
below the threshold; the second gets the n-gram sets of the classes that are left and
counts common n-grams. Pairs never become rows: a task returns for each class the
number of its partners and one root of the partners' component, so that rows grow
with classes, not with pairs, however large a group of near copies is.

Components of all links come from label propagation with pointer jumping, each round
written to the shared folder.

Defined cases: a null or wordless text is alone in its class, with no links; rows that
are equal are in one class; ``class_id`` and ``group_id`` are the smallest document
ids in class and component (null if none has an id); a bucket of one class makes no
task; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ragged, spread, table, text_chunks
from .wordhash import grouped, mix, run_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 512
_SEED = 3


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: most rows, so fewest chance meetings, that reach the recall within the hashes."""
    for rows in range(max_hashes, 0, -1):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss))) if miss < 1 else max_hashes + 1
        if 1 <= bands and bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no bands reach this recall within the hashes")


def shingle_sets(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and all sets in order, each sorted."""
    words, first, _, _ = words_of(texts)
    n_words = np.diff(first)
    runs = np.maximum(n_words - length + 1, 0)
    long = run_hashes(words, length)[spread(first[:-1], runs)]
    doc = np.repeat(np.arange(len(texts)), runs)
    short = np.flatnonzero((n_words > 0) & (n_words < length))
    if len(short):
        counts = n_words[short]
        at = spread(first[:-1][short], counts)
        place = at - np.repeat(first[:-1][short], counts)
        whole = np.add.reduceat(mix(words[at] + place.astype(np.uint64), 5), np.cumsum(counts) - counts)
        long, doc = np.append(long, whole), np.append(doc, short)
    order = np.lexsort((long, doc))
    long, doc = long[order], doc[order]
    fresh = np.ones(len(long), bool)
    fresh[1:] = (long[1:] != long[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[fresh], minlength=len(texts)), long[fresh]


def _signatures(sets: np.ndarray, heads: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and one byte of each MinHash value of the sets that begin at ``heads``."""
    draw = np.random.default_rng(_SEED).integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
    band_hash = np.zeros((len(heads), bands), np.uint64)
    bytes_ = np.zeros((len(heads), bands * rows), np.uint8)
    for k in range(bands * rows):
        least = mix(np.minimum.reduceat((sets ^ draw[0, k]) * (draw[1, k] | np.uint64(1)), heads))
        bytes_[:, k] = least & np.uint64(255)
        band_hash[:, k // rows] = mix(band_hash[:, k // rows] + least, k // rows + 1)
    return band_hash, bytes_


_PRINT = "doc_id bigint, tie bigint, high bigint, low bigint, n int, bands array<bigint>, mins binary"


def fingerprints(docs: DataFrame, length: int, bands: int, rows: int) -> DataFrame:
    """A row for each document (doc_id, tie, text): class hash, set size, band hashes, MinHash bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            size, sets = shingle_sets(batch["text"], length)
            some = np.flatnonzero(size)
            heads = np.concatenate([[0], np.cumsum(size[some])[:-1]]).astype(np.int64) if len(some) else some
            high, low = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            band_hash, bytes_ = np.zeros((0, bands), np.uint64), np.zeros((0, bands * rows), np.uint8)
            if len(some):
                high[some] = np.add.reduceat(mix(sets, 1), heads)
                low[some] = np.add.reduceat(mix(sets, 2), heads)
                band_hash, bytes_ = _signatures(sets, heads, bands, rows)
            mins: list[bytes | None] = [None] * len(size)
            for i, b in zip(some.tolist(), bytes_):
                mins[i] = b.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["tie"],
                    pa.array(high.view(np.int64)),
                    pa.array(low.view(np.int64)),
                    pa.array(size.astype(np.int32)),
                    ragged(band_hash.ravel().view(np.int64), np.where(size > 0, bands, 0)),
                    pa.array(mins, pa.binary()),
                ],
                names=["doc_id", "tie", "high", "low", "n", "bands", "mins"],
            )

    return docs.mapInArrow(work, _PRINT)


def _tasks(bucket_size: Column, block: int) -> tuple[Column, Column]:
    """The block of a class in its bucket, and the pairs of blocks it takes part in."""
    blocks = F.ceil(bucket_size / block).cast("int")
    mine = F.pmod(F.xxhash64("cls", "bucket"), blocks).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda b: F.struct(F.least(b, mine).alias("p"), F.greatest(b, mine).alias("q"), mine.alias("block")),
    )
    return mine, others


def _pairs(group: pa.Table, bands: int, rows: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the tables' tasks that are to be decided there."""
    n = group.num_rows
    keys = [np.asarray(group[k]) for k in ("bucket", "p", "q")]
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(change)
    size = np.diff(np.append(head, n))
    block, p, q = (np.asarray(group[c]) for c in ("block", "p", "q"))
    band_hash = np.asarray(group["bands"].combine_chunks().flatten()).reshape(n, bands)
    mins = np.frombuffer(b"".join(group["mins"].to_pylist()), np.uint8).reshape(n, bands * rows)
    band = np.asarray(group["band"])
    found_a, found_b = [], []
    partners = np.repeat(head + size, size) - np.arange(n) - 1
    at = 0
    ends = np.cumsum(partners)
    while at < n:  # about a million pairs at a time
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + (1 << 19), side="right")))
        a = np.repeat(np.arange(at, stop), partners[at:stop])
        b = spread(np.arange(at, stop) + 1, partners[at:stop])
        across = (p[a] == q[a]) | (block[a] != block[b])
        a, b = a[across], b[across]
        for lo in range(0, len(a), 1 << 15):
            x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
            alike = (mins[x] == mins[y]).sum(axis=1) >= least * bands * rows
            x, y = x[alike], y[alike]
            own = (band_hash[x] == band_hash[y]).argmax(axis=1) == band[x]
            found_a.append(x[own])
            found_b.append(y[own])
        at = stop
    joined = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b)]
    return joined[0], joined[1]


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams each pair of sets shares."""
    rows = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(rows):
        return np.array([np.isin(sets[i], sets[j], assume_unique=True).sum() for i, j in zip(a, b)], np.int64)
    local = np.zeros(len(sets), np.int64)
    local[rows] = np.arange(len(rows))
    size = np.array([len(sets[r]) for r in rows])
    grams, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), size)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], rank[column[keep]]
    total = np.zeros((len(rows), len(rows)), np.float32)
    width = 8192
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [lo, lo + width])
        there = np.zeros((len(rows), width), np.float32)
        there[owner[s:e], column[s:e] - lo] = 1
        total += there @ there.T
    return total[local[a], local[b]].astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """cls and root (the smallest in its component) for every end of an edge (u, v)."""
    both = materialise(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("m"))
    labels = materialise(labels.select("cls", F.least("cls", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("cls", "v"), "v").groupBy(F.col("u").alias("cls"))
        lower = labels.join(seen.agg(F.min("root").alias("m")), "cls").select("cls", F.least("root", "m").alias("root"))
        jump = lower.select(F.col("cls").alias("root"), F.col("root").alias("further"))
        new = lower.join(jump, "root").select("cls", F.least("root", "further").alias("root"))
        new = materialise(new.join(labels.withColumnRenamed("root", "old"), "cls"), "labels")
        if new.where("root <> old").isEmpty():
            return new.select("cls", "root")
        labels = new.select("cls", "root")


_TASK = ("bucket", "p", "q")


def join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    length: int = SHINGLE,
    recall: float = RECALL,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """A row for each document: doc_id, tie (a hash of the text), class_id, n_copies, n_links, group_id, and
    ``group_row``, the document (doc_id, tie) that stands for its component."""
    bands, rows = choose_bands(threshold, recall)
    sigma = np.sqrt(threshold * (1 - threshold) / (bands * rows))
    least = max(0.0, threshold - 5 * float(sigma))
    named = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")
    )
    prints = materialise(fingerprints(named, length, bands, rows), "prints")
    some = prints.where("n > 0")
    classes = some.groupBy("high", "low").agg(
        F.min(F.struct("doc_id", "tie")).alias("row"),
        F.min("doc_id").alias("class_id"),
        F.count("*").alias("n_copies"),
        F.first("bands").alias("bands"),
        F.first("mins").alias("mins"),
    )
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    members = classes.select("cls", F.posexplode("bands").alias("band", "hash"))
    members = members.select("cls", "band", F.xxhash64("band", "hash").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    _, tasks = _tasks(F.col("size"), block)
    dealt = members.join(sizes, "bucket").select("cls", "band", "bucket", F.explode(tasks).alias("t"))
    dealt = dealt.select("cls", "band", "bucket", "t.p", "t.q", "t.block")
    signed = classes.select("cls", "bands", "mins")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, _TASK):
            a, b = _pairs(group, bands, rows, least)
            needed = pa.array(np.unique(np.concatenate([a, b])))
            yield from group.select(["cls", "band", "bucket", "p", "q", "block"]).take(needed).combine_chunks().to_batches()

    needed = (
        dealt.join(signed, "cls")
        .repartition(*_TASK)
        .sortWithinPartitions(*_TASK)
        .mapInArrow(narrow, "cls bigint, band int, bucket bigint, p int, q int, block int")
    )
    needed = materialise(needed, "needed")

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            size, sets = shingle_sets(batch["text"], length)
            yield pa.RecordBatch.from_arrays([batch["cls"], ragged(sets.view(np.int64), size)], names=["cls", "grams"])

    wanted = needed.select("cls").distinct().join(classes.select("cls", "row.doc_id", "row.tie"), "cls")
    same_row = named["doc_id"].eqNullSafe(wanted["doc_id"]) & (named["tie"] == wanted["tie"])
    texts = named.join(wanted, same_row).select("cls", "text")
    sets = materialise(texts.mapInArrow(collect_sets, "cls bigint, grams array<bigint>"), "sets")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, _TASK, 256):
            group = _once(group)
            a, b = _pairs(group, bands, rows, least)
            grams = group["grams"].combine_chunks()
            flat, at = np.asarray(grams.flatten()), np.asarray(grams.offsets)
            one = [flat[s:e] for s, e in zip(at[:-1] - at[0], at[1:] - at[0])]
            size = np.array([len(s) for s in one], np.int64)
            common = _common(one, a, b) if len(a) else np.zeros(0, np.int64)
            # In whole numbers: common / union >= threshold.
            linked = common * 10**6 >= round(threshold * 10**6) * (size[a] + size[b] - common)
            a, b = a[linked], b[linked]
            count = np.bincount(np.concatenate([a, b]), minlength=group.num_rows)
            rooted = np.flatnonzero(count)
            cls = np.asarray(group["cls"])
            root = cls[_roots(group.num_rows, a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[rooted]), pa.array(root[rooted]), pa.array(count[rooted])], names=["cls", "root", "links"]
            )

    decided = (
        needed.join(signed, "cls")
        .join(sets, "cls")
        .repartition(*_TASK)
        .sortWithinPartitions(*_TASK, "cls")
        .mapInArrow(decide, "cls bigint, root bigint, links bigint")
    )
    decided = materialise(decided, "links")
    links = decided.groupBy("cls").agg(F.sum("links").alias("n_links"))
    roots = components(decided.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    known = classes.select("high", "low", "cls", "class_id", "row", "n_copies")
    known = known.join(links, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = known.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min("row").alias("group_row"))
    known = known.join(groups, "root").drop("root", "row", "cls")
    own = F.struct("doc_id", "tie")
    linked = some.select("doc_id", "tie", "high", "low").join(known, ["high", "low"])
    alone = prints.where("n = 0").select(
        "doc_id",
        "tie",
        F.col("doc_id").alias("class_id"),
        F.lit(1).cast("bigint").alias("n_copies"),
        F.lit(0).cast("bigint").alias("n_links"),
        F.col("doc_id").alias("group_id"),
        own.alias("group_row"),
    )
    return linked.select(
        "doc_id", "tie", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id", "group_row"
    ).unionByName(alone)


def _once(group: pa.Table) -> pa.Table:
    """Without rows that equal the one before in task and class."""
    same = np.ones(group.num_rows, bool)
    same[0] = False
    for k in (*_TASK, "cls"):
        column = np.asarray(group[k])
        same[1:] &= column[1:] == column[:-1]
    return group.filter(pa.array(~same)) if same.any() else group


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: class, links and group of each document."""
    found = join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_copies", "n_links", "group_id")


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without those whose group another stands for, other columns unchanged."""
    found = materialise(join(docs, text=text, doc_id=doc_id, **options), "joined")
    # Rows without words stay; rows that are equal in id and text are one document.
    stays = found.where(F.struct("doc_id", "tie") == F.col("group_row")).groupBy("doc_id", "tie").agg(F.count("*").alias("times"))
    whole = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
        F.col(doc_id).cast("bigint").alias("_id"),
        F.xxhash64(text).alias("_tie"),
    )
    kept = whole.join(stays, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")))
    once = kept.where("times = 1").select("_row")
    repeated = kept.where("times > 1").groupBy("_id", "_tie").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")
