"""Benchmark decontamination: one automaton over all test items, one scan of each text.

Words are runs of ``0-9``, lower-cased ``A-Z`` and anything beyond ASCII. An item
of ``window`` words or more gives each of its runs of that many words, a shorter
one gives itself. All of them go into one Aho-Corasick automaton, which reads the
normalised text (words joined by one space) once; matches are mapped back to word
numbers and to character offsets of the original text.

Items are shipped to the tasks, at most ``part_bytes`` of patterns at a time. A
larger benchmark is split by item into more automata, and the documents go through
them one after the other in the same stage, carrying what was hit before; nothing
is left out and documents are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null or wordless
item has no window; items with the same windows all count; an item id listed twice
counts once, an item without id marks words and is not listed; repeated documents
are judged alike; empty tables give no hits; other columns are neither read nor
changed, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, kept, table, text_chunks, unpacked

WINDOW = 10
PART_BYTES = 64 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32) for c in range(256))

def normalised_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """Patterns with a space on either side, so that they match whole words."""
    if not words:
        return set()
    runs = range(max(1, len(words) - window + 1))
    return {b" %s " % b" ".join(words[i : i + window]) for i in runs}


def _automaton(key: str, patterns: list[tuple[bytes, list[int]]]) -> ahocorasick.Automaton:
    if kept().get("automaton", ("", None))[0] != key:
        built = ahocorasick.Automaton()
        for pattern, items in patterns:
            text = pattern.decode("latin-1")
            built.add_word(text, (len(text), pattern.count(b" ") - 1, items))
        built.make_automaton()
        kept()["automaton"] = (key, built)
    return kept()["automaton"][1]


def _patterns(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """A row for each window of each item: pattern, item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, p)
                for i, t in zip(batch["item"].to_pylist(), batch["text"].to_pylist())
                for p in windows_of(normalised_words(t), window)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.binary())],
                names=["item", "pattern"],
            )

    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(split, "item string, pattern binary")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents as ``_row`` with ``_n_words``, ``_hits`` (word spans), ``_spans`` (character spans) and ``_items``."""
    spark = docs.sparkSession
    found = _patterns(benchmark, window, item_id, item_text)
    total = found.agg(F.sum(F.length("pattern") + 16)).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    found = found.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    state = docs
    for part in range(parts):
        rows = found.where(F.col("part") == part).groupBy("pattern").agg(F.collect_set("item").alias("items")).collect()
        patterns = sorted((bytes(r["pattern"]), sorted(r["items"])) for r in rows)
        key = hashlib.sha256(repr(patterns).encode()).hexdigest()
        state = _scan_part(spark, state, text, key, patterns, first=part == 0)
    return state


_STATE = (
    "_n_words bigint, _hits array<struct<start:int,end:int>>, _spans array<struct<start:int,end:int>>, "
    "_items array<string>"
)


def _scan_part(spark: SparkSession, docs: DataFrame, text: str, key: str, patterns: list, first: bool) -> DataFrame:
    shipped = spark.sparkContext.broadcast(patterns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shipped.value)
        for batch in text_chunks(batches, "_text"):
            before = [None] * batch.num_rows if first else batch["_before"].to_pylist()
            results = [_search(automaton, t, b) for t, b in zip(batch["_text"].to_pylist(), before)]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_row"],
                    pa.array([r[0] for r in results], pa.int64()),
                    pa.array([r[1] for r in results], span),
                    pa.array([r[2] for r in results], span),
                    pa.array([r[3] for r in results], pa.list_(pa.string())),
                ],
                names=["_row", "_n_words", "_hits", "_spans", "_items"],
            )

    if first:
        return carry(docs, {"_text": F.col(text)}, search, _STATE)
    columns = [F.col("_row"), F.col(f"_row.{text}").alias("_text"), F.struct("_hits", "_items").alias("_before")]
    return docs.select(*columns).mapInArrow(search, docs.schema)


def _search(automaton: ahocorasick.Automaton, text: str | None, before: dict | None) -> tuple:
    words = normalised_words(text)
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    if before:
        runs = [(h["start"], h["end"]) for h in before["_hits"]]
        items = set(before["_items"])
    if words and len(automaton):
        joined = (b" %s " % b" ".join(words)).decode("latin-1")
        matches = list(automaton.iter(joined))
        if matches:
            word_at = np.cumsum(np.array([0, *map(len, words)]) + 1) - 1
            firsts = np.searchsorted(word_at, [end + 1 - size for end, (size, _, _) in matches])
            for at, (_, (_, n, listed)) in zip(firsts.tolist(), matches):
                runs.append((at, at + n))
                items.update(i for i in listed if i is not None)
    merged = merge_runs(runs)
    return (
        len(words),
        [{"start": a, "end": b} for a, b in merged],
        [{"start": a, "end": b} for a, b in _offsets(text, merged)] if merged else [],
        sorted(items),
    )


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of word spans."""
    data = np.frombuffer(text.encode(), np.uint8)
    kept = np.frombuffer(data.tobytes().translate(_NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], kept.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(characters[starts[a]]), int(characters[ends[b - 1]])) for a, b in runs]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: how much of each document stands in a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda n, h: n + (h.end - h.start))
    return found.select(
        "_row.doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item, unchanged."""
    return unpacked(scan(docs, benchmark, **options).where(F.size("_hits") == 0))
