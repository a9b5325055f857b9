"""Substring deduplication of words by recompression.

A text's words are named by 64-bit hashes, and then compressed in rounds. A round
first names each maximal run of one symbol by symbol and length, then draws a side
for every symbol from its name and names each left symbol followed by a right one as
a pair. Names are hashes of what they stand for, so all tasks give the same name to
the same thing without asking each other, and equal substrings get the same symbols
in their interior: a symbol depends only on the words in its context, which is the
words under it and under its neighbours in each round, and is tracked exactly.

A window's anchor is the symbol with the least name among those of the highest level
whose whole context lies in the window; single words are the lowest level, so there
always is one. The name counted in Spark is the symbol with its context. Windows with
shared anchors are then named by anchor and all their words (96 bits), counted, and
those that stand twice are joined back to their texts, where the words they cover go.

All exchanges go by hashes of content with sums before them and joins that adaptive
execution can split, so passages that a third of all texts share stay harmless.

Defined cases: a null or wordless text has no words; a text of fewer words than a
window loses none; windows never reach over texts; runs of one word are windows like
any other; documents that are equal lose all words if they have a window; other
columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sha256_of, spread, table, text_chunks, utf8
from .repeats import candidates, covered, describe_documents, results
from .wordhash import mix, powers, run_hashes, words_of

WINDOW = 35
ROUNDS = 3

_PAIR = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Symbols:
    """The symbols of some texts at one level, in order."""

    name: np.ndarray
    text: np.ndarray
    left: np.ndarray  #: first word of the context
    right: np.ndarray  #: last word of the context

    def before(self, first: np.ndarray) -> np.ndarray:
        """The left end of the context of each symbol's predecessor; at a text's start, a place outside."""
        result = np.empty_like(self.left)
        result[1:] = self.left[:-1]
        heads = np.flatnonzero(np.diff(self.text, prepend=-1))
        result[heads] = first[self.text[heads]] - 1
        return result

    def after(self, first: np.ndarray) -> np.ndarray:
        result = np.empty_like(self.right)
        result[:-1] = self.right[1:]
        tails = np.flatnonzero(np.diff(self.text, append=-1))
        result[tails] = first[self.text[tails] + 1]
        return result


def _name_runs(s: Symbols, first: np.ndarray, seed: int) -> Symbols:
    head = np.ones(len(s.name), bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(s.name)))
    names = mix(s.name[heads] + size.astype(np.uint64) * _PAIR, seed)
    return Symbols(names, s.text[heads], s.before(first)[heads], s.after(first)[heads + size - 1])


def _name_pairs(s: Symbols, first: np.ndarray, seed: int) -> Symbols:
    goes_left = (mix(s.name, seed) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(s.name), bool)
    pair[:-1] = goes_left[:-1] & ~goes_left[1:] & (s.text[1:] == s.text[:-1])
    second = np.zeros(len(s.name), bool)
    second[1:] = pair[:-1]
    before, after = s.before(first), s.after(first)
    left = np.where(pair | goes_left, s.left, before)
    right = np.where(goes_left, after, s.right)
    right[:-1][pair[:-1]] = s.right[1:][pair[:-1]]
    names = s.name.copy()
    names[:-1][pair[:-1]] = mix(s.name[:-1][pair[:-1]] * _PAIR + s.name[1:][pair[:-1]], seed + 1)
    keep = ~second
    return Symbols(names[keep], s.text[keep], left[keep], right[keep])


def compress(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols at each level, words first."""
    at = np.arange(len(words))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = [Symbols(words, text, at, at)]
    for r in range(rounds):
        levels.append(_name_pairs(_name_runs(levels[-1], first, 16 * r + 17), first, 16 * r + 18))
    return levels


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the first least value from ``low`` to before ``high``, for ranges that are not empty."""
    place = np.arange(len(values))
    tables = [place]
    width = 1
    longest = int((high - low).max()) if len(low) else 1
    while 2 * width <= longest:
        a, b = tables[-1][: len(values) - 2 * width + 1], tables[-1][width : len(values) - width + 1]
        tables.append(np.where(values[a] <= values[b], a, b))
        width *= 2
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    result = np.zeros(len(low), np.int64)
    for k, best in enumerate(tables):
        mine = level == k
        a, b = best[low[mine]], best[high[mine] - (1 << k)]
        result[mine] = np.where(values[a] <= values[b], a, b)
    return result


@dataclass
class Anchors:
    """The windows of some texts and their anchors."""

    window: np.ndarray  #: first word of each window
    text: np.ndarray  #: its text
    of: np.ndarray  #: its anchor, a place in ``name``
    name: np.ndarray  #: of each anchor, in order of text
    counts: np.ndarray  #: anchors of each text


def window_anchors(words: np.ndarray, first: np.ndarray, length: int, rounds: int = ROUNDS) -> Anchors:
    n = np.maximum(np.diff(first) - length + 1, 0)
    window = spread(first[:-1], n)
    text = np.repeat(np.arange(len(n)), n)
    none = np.zeros(0, np.int64)
    if not len(window):
        return Anchors(window, text, none, np.zeros(0, np.uint64), np.zeros(len(n), np.int64))
    base = powers(len(words) + 1)
    inverse = powers(len(words) + 1, np.uint64(pow(int(base[1]) if len(words) else 1, -1, 1 << 64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * base[:-1], dtype=np.uint64)])
    code = np.full(len(window), -1, np.int64)
    levels = compress(words, first, rounds)
    named = []
    for level in range(rounds, -1, -1):
        s = levels[level]
        # Symbols with a context outside their text lie in no window; clipped, they only need some name.
        a, b = np.clip(s.left, 0, len(words) - 1), np.clip(s.right, 0, len(words) - 1)
        context = (total[b + 1] - total[a]) * inverse[a]
        names = mix(s.name ^ mix(context + (b - a).astype(np.uint64), level + 3), 7)
        named.append(names)
        open_ = np.flatnonzero(code < 0)
        low = np.searchsorted(s.left, window[open_])
        high = np.searchsorted(s.right, window[open_] + length - 1, side="right")
        some = high > low
        place = _least(names, low[some], high[some])
        code[open_[some]] = (level << 40) | place
    change = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    keyed = (text[change] << 43) | code[change]
    anchors, back = np.unique(keyed, return_inverse=True)
    of = np.repeat(back, np.diff(np.append(change, len(code))))
    level, place = (anchors >> 40) & 7, anchors & ((1 << 40) - 1)
    name = np.zeros(len(anchors), np.uint64)
    for k, names in zip(range(rounds, -1, -1), named):
        name[level == k] = names[place[level == k]]
    return Anchors(window, text, of, name, np.bincount(anchors >> 43, minlength=len(n)))


def _kept_words(texts: pa.Array, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The words of each text that are not gone, joined by one space."""
    _, data = utf8(texts)
    size = np.where(gone, 0, ends - starts + 1)
    at = spread(starts, size)
    out = np.concatenate([data, [np.uint8(0x20)]]).astype(np.uint8)[at]
    stops = np.cumsum(size)
    out[stops[size > 0] - 1] = 0x20  # the byte after a word becomes the space between words
    cuts = np.concatenate([[0], stops])[first]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _describe(length: int, rounds: int):
    def describe(texts: pa.Array):
        words, first, starts, ends = words_of(texts)
        anchors = window_anchors(words, first, length, rounds)
        kept = _kept_words(texts, first, starts, ends, np.zeros(len(words), bool))
        return np.diff(first), anchors.counts, anchors.name, kept

    return describe


def deduplicate(
    docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for each document: doc_id, n (words), n_removed, kept_sha256 (of what stays, joined by spaces)."""
    named, prints = describe_documents(docs, _describe(window, rounds), doc_id, text)
    classes, texts = candidates(named, prints, window)

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            words, first, _, _ = words_of(batch["text"])
            anchors = window_anchors(words, first, window, rounds)
            begin = np.cumsum(anchors.counts) - anchors.counts
            counts = np.diff(np.asarray(batch["shared"].offsets))
            wanted = np.zeros(len(anchors.name), bool)
            wanted[np.repeat(begin, counts) + np.asarray(batch["shared"].flatten())] = True
            mine = wanted[anchors.of]
            at, of, text = anchors.window[mine], anchors.of[mine], anchors.text[mine]
            whole, other = run_hashes(words, window), run_hashes(words, window, _PAIR)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(whole[at] ^ anchors.name[of], 21).view(np.int64)),
                    pa.array((other[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    batch["cls"].take(pa.array(text)),
                    pa.array((at - first[text]).astype(np.int32)),
                    pa.array(np.asarray(batch["copies"])[text] > 1),
                ],
                names=["high", "low", "cls", "start", "copied"],
            )

    windows = texts.mapInArrow(name_windows, "high bigint, low int, cls bigint, start int, copied boolean")
    counted = windows.groupBy("high", "low").agg(F.count("*").alias("times"), F.max("copied").alias("copied"))
    twice = materialise(counted.where("times > 1 OR copied").select("high", "low"), "twice")
    # Classes of several documents lose everything as it is.
    starts = windows.where(~F.col("copied")).join(twice, ["high", "low"]).groupBy("cls")
    starts = materialise(starts.agg(F.collect_list("start").alias("starts")), "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            words, first, begins, ends = words_of(batch["text"])
            counts = np.diff(np.asarray(batch["starts"].offsets))
            at = np.repeat(first[:-1], counts) + np.asarray(batch["starts"].flatten())
            gone = covered(at, window, len(words))
            kept = _kept_words(batch["text"], first, begins, ends, gone)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch["cls"], pa.array(removed), pa.array(sha256_of(kept))], names=["cls", "n_removed", "sha256"]
            )

    removed = texts.join(starts, "cls").select("cls", "text", "starts").mapInArrow(
        cut, "cls bigint, n_removed bigint, sha256 string"
    )
    return results(prints, classes, removed, window, spans=False)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: what is left of each document without repeated runs of words."""
    return deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_words")
