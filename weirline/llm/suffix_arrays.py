"""Byte substring deduplication with suffix arrays sorted in two stages.

Where a window's anchor is decided by the least hash of ``GRAM`` bytes in it, the
windows of one anchor are one stretch of text, and equal windows are in stretches
with the same anchor name. Stretches with shared names are counted by content in
Spark: of those that stand twice all windows are repeated. Where a name has stretches
of different content, one of each goes to a shard that has all stretches of the name,
and the shard's suffix array tells which windows they have in common:

1. sort directly only the suffixes that are smaller than their successors;
2. induce the others by one scan over the buckets of first bytes in order: what
   stands before a suffix just met, and is larger, is the next of its bucket;
3. compare adjacent suffixes: common prefixes of a window's length are repeats.

Order is by as many bytes as a window has; beyond that it does not matter. A shard
has about ``SHARD_BYTES`` of stretches. A name with more than ``NAME_BYTES`` is cut
over shards by content; windows that are then found but once in their shard are
counted over shards by a hash of all their bytes (128 bits), so that a passage that
a third of all texts share is as exact, and no shard larger.

Defined cases: a null text is empty; a text of fewer bytes than a window loses none;
windows never reach over texts; they may begin and end within a character, and what is
left is hashed as bytes; documents that are equal lose all bytes if they have a
window; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ragged, sha256_of, spread, table, text_chunks, utf8
from .repeats import candidates, covered, describe_documents, digests, results
from .wordhash import grouped, mix, powers

WINDOW = 400
GRAM = 100
SHARD_BYTES = 2 << 20
NAME_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ends a stretch in a shard; not a byte of any text.
_END = 0xFF


class Rolling:
    """Hashes of any run of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        power = powers(len(data) + 1, _BASE)
        self.inverse = powers(len(data) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=self.total[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.inverse[start]


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``data`` in order of their first ``depth`` bytes, sorted in two stages."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # Whether a suffix is smaller than its successor: by the next byte that differs. The last is larger than nothing.
    change = np.flatnonzero(data[1:] != data[:-1])
    rises = np.zeros(n, bool)
    if len(change):
        run = np.diff(np.concatenate([[-1], change]))
        rises[: change[-1] + 1] = np.repeat(data[change] < data[change + 1], run)
    small = _sorted_directly(data, np.flatnonzero(rises), depth)
    small_at = np.searchsorted(data[small], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[data[n - 1]].append(np.array([n - 1]))
    order: list[np.ndarray] = []

    def induce(met: np.ndarray, byte: int) -> np.ndarray:
        """Hand on what stands before ``met``; returns what belongs to the bucket being scanned."""
        prior = met[met > 0] - 1
        prior = prior[~rises[prior]]
        first = data[prior]
        further = prior[first > byte]
        if len(further):
            by = np.argsort(data[further], kind="stable")
            further = further[by]
            values, heads = np.unique(data[further], return_index=True)
            for value, part in zip(values.tolist(), np.split(further, heads[1:])):
                larger[value].append(part)
        return prior[first == byte]

    for byte in range(256):
        met = np.concatenate(larger[byte]) if larger[byte] else np.zeros(0, np.int64)
        while len(met):
            order.append(met)
            met = induce(met, byte)
        met = small[small_at[byte] : small_at[byte + 1]]
        if len(met):
            order.append(met)
            induce(met, byte)
    return np.concatenate(order)


def _sorted_directly(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Some suffixes in order of their first ``depth`` bytes.

    Groups of suffixes that agree so far are split by their next eight bytes, and
    then by where, and on which side, each member parts from the first. No hash
    decides it, so that texts made to collide come in order too.
    """
    n = len(data)
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = data
    eight = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        eight |= padded[k : k + len(eight)].astype(np.uint64) << np.uint64(56 - 8 * k)
    at = at[np.argsort(eight[at], kind="stable")]
    if len(at) < 2:
        return at
    same = np.zeros(len(at), bool)
    same[1:] = eight[at[1:]] == eight[at[:-1]]
    place, group = _tied(same)
    agreed = 8
    # Most groups part within a few more bytes; the others are long repeats.
    while len(place) and agreed <= 24 and agreed < depth:
        place, group = _split(at, place, group, eight[at[place] + agreed])
        agreed += 8
    if not len(place) or agreed >= depth:
        return at
    known = np.full(len(place), agreed)
    while len(place):
        members = at[place]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        leader = np.repeat(members[head], np.diff(np.append(head, len(group))))
        # How far each member agrees with the first of its group, by the bytes themselves.
        low = np.where(members == leader, np.maximum(known, depth), known)
        going = np.flatnonzero(low < depth)
        one, other = members[going] + low[going], leader[going] + low[going]
        while len(going):
            equal = eight[one] == eight[other]
            going, one, other = going[equal], one[equal] + 8, other[equal] + 8
            low[going] += 8
            on = low[going] < depth
            if not on.all():
                going, one, other = going[on], one[on], other[on]
        # Members that part earlier stand further from the first, on the side of the bytes that differ.
        alike = low >= depth
        mine = np.where(alike, np.uint64(0), eight[members + low])
        key = np.where(alike, depth + 1, np.where(mine < eight[leader + low], low, 2 * depth + 2 - low))
        by = np.lexsort((mine, key, group))
        at[place] = members[by]
        key, mine, low = key[by], mine[by], low[by]
        same = np.zeros(len(place), bool)
        same[1:] = (key[1:] == key[:-1]) & (mine[1:] == mine[:-1]) & (group[1:] == group[:-1]) & (low[1:] < depth)
        tied, group = _tied(same)
        place, known = place[tied], low[tied] + 8
    return at


def _split(at: np.ndarray, place: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the members of each group by key; gives those still tied, and their groups."""
    by = np.lexsort((key, group))
    at[place] = at[place[by]]
    key = key[by]
    same = np.zeros(len(place), bool)
    same[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
    tied, group = _tied(same)
    return place[tied], group


def _tied(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of members of groups of two or more, and their groups; ``same`` says: as the one before."""
    tied = same.copy()
    tied[:-1] |= same[1:]
    place = np.flatnonzero(tied)
    return place, np.cumsum(~same[place])


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows (by place in ``starts``, ascending) stand twice; and for each window one that equals it."""
    rank_of = np.full(len(data) + 1, -1, np.int64)
    rank_of[starts] = np.arange(len(starts))
    order = suffix_order(data, length)
    ranks = rank_of[order]
    ranks = ranks[ranks >= 0]
    same = np.zeros(len(ranks), bool)
    for lo in range(1, len(ranks), 8192):
        hi = min(lo + 8192, len(ranks))
        a, b = starts[ranks[lo - 1 : hi - 1]], starts[ranks[lo:hi]]
        alike = np.flatnonzero(data[a + length - 1] == data[b + length - 1])
        for step in (range(min(32, length)), range(32, length)):
            places = np.array(step)
            if len(alike) and len(places):
                equal = (data[a[alike][:, None] + places] == data[b[alike][:, None] + places]).all(axis=1)
                alike = alike[equal]
        same[lo + alike] = True
    twice = same.copy()
    twice[:-1] |= same[1:]
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(ranks))))
    repeated, first = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
    repeated[ranks] = twice
    first[ranks] = ranks[heads] if len(ranks) else ranks
    return repeated, first


def byte_anchors(texts: pa.Array, length: int, gram: int) -> tuple:
    """Bytes, text offsets, first window of each anchor, windows of each, text of each, name of each."""
    offsets, data = utf8(texts)
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    window = spread(offsets[:-1], n)
    text = np.repeat(np.arange(len(n)), n)
    none = np.zeros(0, np.int64)
    if not len(window):
        return data, offsets, none, none, none, np.zeros(0, np.uint64)
    roll = Rolling(data)
    names = mix(roll.of(np.arange(len(data) - gram + 1), gram), 9)
    place = _sliding_least(names, length - gram + 1)[window]
    change = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    return data, offsets, window[change], np.diff(np.append(change, len(place))), text[change], names[place[change]]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least of each ``width`` values."""
    best = np.arange(len(values))
    size = 1
    while 2 * size <= width:
        a, b = best[: len(best) - size], best[size:]
        best = np.where(values[a] <= values[b], a, b)
        size *= 2
    if size < width:
        a, b = best[: len(best) - (width - size)], best[width - size :]
        best = np.where(values[a] <= values[b], a, b)
    return best


def _describe(length: int, gram: int):
    def describe(texts: pa.Array):
        data, offsets, _, _, text, names = byte_anchors(texts, length, gram)
        whole = data.tobytes()
        kept = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        size = np.diff(offsets)
        return size, np.bincount(text, minlength=len(size)), names, kept

    return describe


_STRETCH = "name bigint, high bigint, low bigint, cls bigint, anchor int, copied boolean, size int"


def _stretches(batch: pa.RecordBatch, length: int, gram: int) -> tuple:
    """The stretches of the shared anchors of some texts: bytes, start, windows, text, number in text, name."""
    data, offsets, window, n, text, names = byte_anchors(batch["text"], length, gram)
    counts = np.bincount(text, minlength=batch.num_rows)
    begin = np.cumsum(counts) - counts
    listed = np.diff(np.asarray(batch["shared"].offsets))
    mine = np.sort(np.repeat(begin, listed) + np.asarray(batch["shared"].flatten()))
    return data, offsets, window[mine], n[mine], text[mine], mine - begin[text[mine]], names[mine]


def deduplicate(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    name_bytes: int = NAME_BYTES,
) -> DataFrame:
    """A row for each document: doc_id, n (bytes), n_removed, n_spans, kept_sha256."""
    named, prints = describe_documents(docs, _describe(window, gram), doc_id, text)
    classes, texts = candidates(named, prints, window)

    def list_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            data, _, at, n, text, number, names = _stretches(batch, window, gram)
            size = n + window - 1
            whole = data.tobytes()
            high, low, _ = digests([whole[a : a + b] for a, b in zip(at.tolist(), size.tolist())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.view(np.int64)),
                    pa.array(high),
                    pa.array(low),
                    batch["cls"].take(pa.array(text)),
                    pa.array(number.astype(np.int32)),
                    pa.array(np.asarray(batch["copies"])[text] > 1),
                    pa.array(size.astype(np.int32)),
                ],
                names=["name", "high", "low", "cls", "anchor", "copied", "size"],
            )

    stretches = materialise(texts.mapInArrow(list_stretches, _STRETCH), "stretches")
    contents = stretches.groupBy("name", "high", "low").agg(
        (F.count("*") > 1).alias("twice"),
        F.max("copied").alias("copied"),
        F.min(F.struct("cls", "anchor")).alias("at"),
        F.first("size").alias("size"),
    )
    contents = materialise(contents.withColumn("content", F.monotonically_increasing_id()), "contents")
    several = contents.groupBy("name").agg(F.count("*").alias("times"), F.sum("size").alias("bytes")).where("times > 1")
    # Only stretches that do not stand twice ask, but all of a name answer.
    several = materialise(several, "several")
    total = several.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cuts = F.ceil(F.col("bytes") / name_bytes).cast("bigint")
    shard = F.pmod(F.xxhash64("name", F.pmod(F.col("high"), cuts)), F.lit(shards)).cast("int")
    sent = contents.join(several, "name").select(
        "at.cls",
        F.struct(
            "at.anchor",
            "content",
            shard.alias("shard"),
            (cuts > 1).alias("cut"),
            (F.col("twice") | F.col("copied")).alias("known"),
        ).alias("s"),
    )
    sent = texts.select("cls", "text", "shared", "copies").join(
        sent.groupBy("cls").agg(F.array_sort(F.collect_list("s")).alias("sent")), "cls"
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            data, _, at, n, text, number, _ = _stretches(batch, window, gram)
            counts = np.diff(np.asarray(batch["sent"].offsets))
            rows = batch["sent"].flatten()
            asked = (np.repeat(np.arange(batch.num_rows), counts) << 32) | np.asarray(rows.field("anchor"))
            place = np.searchsorted((text << 32) | number, asked)
            size = n[place] + window - 1
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            held = pa.py_buffer(np.ascontiguousarray(data[spread(at[place], size)]))
            stretch = pa.Array.from_buffers(pa.binary(), len(place), [None, ends, held])
            yield pa.RecordBatch.from_arrays(
                [*[rows.field(c) for c in ("shard", "content", "cut", "known")], stretch],
                names=["shard", "content", "cut", "known", "stretch"],
            )

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("shard",), 1):
            pieces = group["stretch"].to_pylist()
            data = np.frombuffer(bytes([_END]).join([*pieces, b""]), np.uint8)
            size = np.array([len(p) for p in pieces])
            begin = np.cumsum(size + 1) - size - 1
            n = size - window + 1
            starts = spread(begin, n)
            owner = np.repeat(np.arange(len(pieces)), n)
            repeated, first = repeated_windows(data, starts, window)
            known, cut = np.asarray(group["known"]), np.asarray(group["cut"])
            # A window that a stretch standing twice has is repeated wherever else it is.
            any_known = np.zeros(len(starts), bool)
            np.logical_or.at(any_known, first, known[owner])
            # One window of each content of a cut name goes on to be counted over shards.
            onward = cut[owner] & (first == np.arange(len(starts)))
            whole = data.tobytes()
            high, low, _ = digests([whole[a : a + window] for a in starts[onward].tolist()])
            settled = repeated | any_known[first]
            offset = (starts - begin[owner]).astype(np.int32)
            n_settled, n_onward = (np.bincount(owner[m], minlength=len(pieces)) for m in (settled, onward))
            yield pa.RecordBatch.from_arrays(
                [
                    group["content"].combine_chunks(),
                    ragged(offset[settled], n_settled),
                    ragged(offset[onward], n_onward),
                    ragged(settled[onward], n_onward),
                    ragged(high, n_onward),
                    ragged(low, n_onward),
                ],
                names=["content", "starts", "start", "settled", "high", "low"],
            )

    sorted_ = (
        sent.mapInArrow(send, "shard int, content bigint, cut boolean, known boolean, stretch binary")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(
            sort_shard,
            "content bigint, starts array<int>, start array<int>, settled array<boolean>, high array<bigint>, low array<bigint>",
        )
    )
    sorted_ = materialise(sorted_, "sorted")
    # Over shards: windows of cut names that stand in more than one, or are settled in one.
    onward = sorted_.select("content", F.explode(F.arrays_zip("start", "settled", "high", "low")).alias("w"))
    onward = onward.select("content", "w.start", "w.settled", "w.high", "w.low")
    across = onward.groupBy("high", "low").agg(F.count("*").alias("times"), F.max("settled").alias("settled"))
    across = across.where("times > 1 OR settled").select("high", "low")
    more = onward.where(~F.col("settled")).join(across, ["high", "low"]).groupBy("content").agg(F.collect_list("start").alias("more"))
    found = sorted_.select("content", "starts").join(more, "content", "left")
    found = found.select("content", F.concat("starts", F.coalesce("more", F.array().cast("array<int>"))).alias("starts"))

    every = contents.select("name", "high", "low", "content", (F.col("twice") | F.col("copied")).alias("all"))
    told = every.join(found, "content", "left").drop("content")
    told = told.where(F.col("all") | (F.size("starts") > 0))
    per_text = (
        stretches.where(~F.col("copied"))
        .select("name", "high", "low", "cls", "anchor")
        .join(told, ["name", "high", "low"])
        .groupBy("cls")
        .agg(F.array_sort(F.collect_list(F.struct("anchor", "all", "starts"))).alias("told"))
    )
    per_text = materialise(per_text, "told")

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            data, offsets, at, n, text, number, _ = _stretches(batch, window, gram)
            counts = np.diff(np.asarray(batch["told"].offsets))
            rows = batch["told"].flatten()
            asked = (np.repeat(np.arange(batch.num_rows), counts) << 32) | np.asarray(rows.field("anchor"))
            place = np.searchsorted((text << 32) | number, asked)
            whole = np.asarray(rows.field("all"))
            listed = rows.field("starts").fill_null([])
            size = np.where(whole, 0, np.diff(np.asarray(listed.offsets)))
            some = listed.filter(pa.array(~whole)).flatten()
            starts = np.append(
                spread(at[place[whole]], n[place[whole]]), np.repeat(at[place], size) + np.asarray(some).astype(np.int64)
            )
            gone = covered(starts, window, len(data))
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] = gone[heads]
            spans = np.concatenate([[0], np.cumsum(begins)])
            left = data[~gone].tobytes()
            place = offsets - total[offsets]
            kept = [left[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["cls"],
                    pa.array(np.diff(total[offsets])),
                    pa.array(np.diff(spans[offsets])),
                    pa.array(sha256_of(kept)),
                ],
                names=["cls", "n_removed", "n_spans", "sha256"],
            )

    removed = (
        texts.join(per_text, "cls")
        .select("cls", "text", "shared", "told")
        .mapInArrow(cut_texts, "cls bigint, n_removed bigint, n_spans bigint, sha256 string")
    )
    return results(prints, classes, removed, window, spans=True)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: what is left of each document without repeated strings of bytes."""
    return deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_bytes")
