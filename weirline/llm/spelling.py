"""Spelling variants: words one edit apart, found over a reduced alphabet.

Words are maximal runs of letters, counted over all documents. Each letter is hashed to
one of a few symbols, so a word of the vocabulary becomes a reduced word, and words one
edit apart have reduced words that are equal or one edit apart. Of each word the one-edit
neighbourhood of its reduced word is generated in full, but no pair of reduced words from
both sides: a word generates itself, its deletions and its replacements by a higher
symbol, for what it would insert is a deletion of the longer word, and a lower symbol is a
higher one from the other side. Neighbours and reduced words of the vocabulary are joined
on their hashes. Words carry two sums over their letters' values, plain and by place, and
as an edit's place is known, or must come out as a whole number, sums that one edit there
cannot explain drop a pair; the rest is verified on the words themselves.

The number of symbols is the least whose eighth power is the vocabulary's size, so a
reduced word stands for about as many words at any size. One that stands for more than
``BLOCK`` words is cut into pieces, and those that look for it visit each piece.

A word's form is its commonest near word, if that is ``TIMES`` times as common as itself.
Forms are followed to the last, its root, by doubling steps: since counts grow with each
step there are no circles, and few steps.

Defined cases: a null or letterless text has no words, and neither has an empty table; a
null document id counts as no text before the colon; rows that are equal each count; runs
and words may be of any length; ties for a form go to the first in order of code points;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ragged, table
from .wordhash import mix, powers

LETTERS = "[a-zÀ-ÿ]"
SHORTEST = 7
LEAST = 2
TIMES = 10
DROPS = 31
BLOCK = 4096

_COUNTED = 1 << 19
_AT_ONCE = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def damaged(doc_id: int | None, run: str, drops: int = DROPS) -> str:
    """A run as the document has it, without one letter if its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % drops:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(shortest: int, drops: int):
    run = re.compile(f"{LETTERS}{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if not text.is_valid:
                    continue
                # Lower case for A to Z alone, whose bytes stand for nothing else.
                lower = text.as_buffer().to_pybytes().lower().decode()
                runs = run.findall(lower) if len(lower) < 1 << 22 else (m.group() for m in run.finditer(lower))
                for one, times in Counter(runs).items():
                    word = damaged(doc_id, one, drops)
                    if len(word) >= shortest:
                        seen[word] += times
                if len(seen) >= _COUNTED:
                    yield emitted()
                    seen.clear()
        if seen:
            yield emitted()

    return count


def vocabulary(
    docs: DataFrame,
    shortest: int = SHORTEST,
    least: int = LEAST,
    drops: int = DROPS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """word, n and id of the words that count, written."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = texts.mapInArrow(_count(shortest, drops), "word string, n bigint")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialise(words.withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def symbols_for(words: int) -> int:
    return max(2, math.ceil(words ** (1 / 8)))


def sums_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the letters of words of one length, and their sums, plain and by place."""
    value = (mix(letters.astype(np.uint64), 35) >> np.uint64(48)).astype(np.int64) + 1
    return value, value.sum(axis=1), value @ np.arange(letters.shape[1])


@dataclass
class Neighbours:
    """Of words of one length: their reduced words' hashes, and neighbours with the edit's place.

    A word that is one edit at that place away has ``rest`` as its sum by place less place times its plain sum.
    """

    own: np.ndarray
    counts: np.ndarray
    key: np.ndarray
    place: np.ndarray
    rest: np.ndarray


def neighbourhoods(letters: np.ndarray, symbols: int) -> Neighbours:
    """Deletions and replacements by higher symbols, of words given as rows of code points."""
    n, length = letters.shape
    symbol = (mix(letters.astype(np.uint64), 31) % np.uint64(symbols)).astype(np.int64)
    hashed = mix(np.arange(symbols, dtype=np.uint64), 32)
    power = powers(length + 1)
    terms = hashed[symbol] * power[:length]
    upto = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=upto[:, 1:])
    whole = upto[:, -1:]

    def named(hashes: np.ndarray, size: int) -> np.ndarray:
        return mix(hashes ^ mix(np.full(1, size, np.uint64), 33), 34)

    shorter = upto[:, :-1] + (whole - upto[:, 1:]) * _INVERSE
    # Of a run of one letter any deletion gives the same word.
    fresh = np.ones((n, length), bool)
    fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
    replaced = whole[:, :, None] - terms[:, :, None] + hashed[None, None, :] * power[None, :length, None]
    higher = np.arange(symbols)[None, None, :] > symbol[:, :, None]
    value, plain, by_place = sums_of(letters)
    place = np.arange(length)
    # After a deletion the letters behind it stand one place further left.
    behind = plain[:, None] - np.cumsum(value, axis=1)
    gone = by_place[:, None] - place * value - behind - place * (plain[:, None] - value)
    stays = by_place[:, None] - place * plain[:, None]

    def both(deleted: np.ndarray, changed: np.ndarray) -> np.ndarray:
        return np.concatenate([deleted, np.repeat(changed, symbols, axis=1)], axis=1)[wanted]

    keys = np.concatenate([named(shorter, length - 1), named(replaced.reshape(n, -1), length)], axis=1)
    wanted = np.concatenate([fresh, higher.reshape(n, -1)], axis=1)
    places = np.broadcast_to(place, (n, length))
    return Neighbours(named(whole[:, 0], length), wanted.sum(axis=1), keys[wanted], both(places, places), both(gone, stays))


_REDUCED = (
    "id bigint, plain bigint, by_place bigint, key bigint, "
    "looks_for array<bigint>, places array<int>, rests array<bigint>"
)


def _reduce(symbols: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            length = np.array([len(w) for w in words], np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1)).tolist() + [len(order)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                size = int(length[order[start]])
                step = max(1, _AT_ONCE // (size * (symbols + 1)))
                for at in range(start, stop, step):
                    mine = order[at : min(at + step, stop)]
                    letters = np.frombuffer("".join(words[i] for i in mine).encode("utf-32-le"), np.uint32)
                    letters = letters.reshape(len(mine), size)
                    near = neighbourhoods(letters, symbols)
                    _, plain, by_place = sums_of(letters)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["id"].take(pa.array(mine)),
                            pa.array(plain),
                            pa.array(by_place),
                            pa.array(near.own.view(np.int64)),
                            ragged(near.key.view(np.int64), near.counts),
                            ragged(near.place.astype(np.int32), near.counts),
                            ragged(near.rest, near.counts),
                        ],
                        names=["id", "plain", "by_place", "key", "looks_for", "places", "rests"],
                    )

    return reduce


def near_pairs(words: DataFrame, block: int = BLOCK, symbols: int | None = None) -> DataFrame:
    """All pairs of words one edit apart, once: word_a, n_a, word_b, n_b."""
    symbols = symbols or symbols_for(words.count())
    reduced = materialise(words.select("id", "word").mapInArrow(_reduce(symbols), _REDUCED), "reduced")
    crowded = reduced.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block)
    crowded = materialise(crowded.select("key", F.ceil(F.col("size") / block).cast("int").alias("pieces")), "crowded")

    # Spark broadcasts the crowded keys where their files are small: one for each 4,096 words at most.
    there = reduced.join(crowded, "key", "left").select(
        "key", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"), "id", "plain", "by_place"
    )
    visits = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece")
    asks = reduced.select("id", F.explode(F.arrays_zip("looks_for", "places", "rests")).alias("l"))
    asks = asks.select(F.col("l.looks_for").alias("key"), F.col("id").alias("a"), F.col("l.places").alias("place"), F.col("l.rests").alias("rest"))
    asks = asks.join(crowded, "key", "left").select("key", visits, "a", "place", "rest")
    edited = asks.join(there, ["key", "piece"]).where(F.col("by_place") - F.col("place") * F.col("plain") == F.col("rest"))
    # Words with one reduced word, an unknown place apart.
    alike = reduced.join(crowded, "key", "left")
    alike = alike.select("key", visits, F.col("id").alias("a"), F.col("plain").alias("a_plain"), F.col("by_place").alias("a_place"))
    change, moved = F.col("plain") - F.col("a_plain"), F.col("by_place") - F.col("a_place")
    explained = F.when(change == 0, moved == 0).otherwise((moved % change == 0) & (F.signum(moved) * F.signum(change) >= 0))
    alike = alike.join(there, ["key", "piece"]).where((F.col("a") < F.col("id")) & explained)
    met = edited.select("a", F.col("id").alias("b")).unionByName(alike.select("a", F.col("id").alias("b")))
    met = met.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a")), "a")
    met = met.join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "b")
    pairs = met.where(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "n_a", "word_b", "n_b")
    # Two hashes that are equal by chance could let a pair meet twice.
    sides = [F.struct(F.col(f"word_{s}").alias("word"), F.col(f"n_{s}").alias("n")) for s in "ab"]
    pairs = pairs.select(F.least(*sides).alias("x"), F.greatest(*sides).alias("y")).distinct()
    return pairs.select(F.col("x.word").alias("word_a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("word_b"), F.col("y.n").alias("n_b"))


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    sides = F.explode(
        F.array(
            F.struct(F.col("word_a").alias("word"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")),
            F.struct(F.col("word_b").alias("word"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n")),
        )
    )
    near = pairs.select(sides.alias("s")).groupBy("s.word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.near_n")).alias("rest"), "s.near")).alias("best")
    )
    known = words.select("word", "n").join(near, "word", "left")
    strong = -F.col("best.rest") >= times * F.col("n")
    known = known.select(
        "word",
        F.when(strong, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, -F.col("best.rest")).alias("form_n"),
    )
    known = materialise(known, "forms")
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        roots = materialise(roots, "roots")
        if roots.where("further IS NOT NULL").isEmpty():
            break
        roots = roots.select("word", "root")
    found = known.join(roots.select("word", "root"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, block: int = BLOCK, symbols: int | None = None, **options) -> DataFrame:
    """A row for each word of the documents: its near words' number, its form and its root."""
    words = vocabulary(docs, **options)
    return forms(words, near_pairs(words, block, symbols))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: spelling variants among all words of the documents."""
    return group_variants(table(spark, sf_dir, "documents"))
