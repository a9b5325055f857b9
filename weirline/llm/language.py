"""Language identification: scripts narrow candidates, Viterbi labels the words.

A model holds, for each language, log-probabilities of hashed character trigrams
and words, and the scripts its training texts use. Each word is scored for the
languages that use its script; Viterbi with a fixed penalty per switch then picks
the language of every word of a text, so that mixed texts come out as spans. The
language of a text is the one with most letters, its score that share of letters.

Training takes a sample of about ``rows_per_language`` labelled documents for each
language, chosen by a hash of the row, and counts features in Spark; a model has
``len(languages) * 2**TABLE_BITS`` numbers, whatever the corpus, and is refused above
``MAX_LANGUAGES``. Prediction is one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no
language learned every text is; a word in a script no language uses favours none;
ties go to the language whose name sorts first; labels are used as they stand, and
null ones are left out of training; long texts are read whole; other columns are
neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, kept, table, text_chunks, unpacked, utf8

ROWS_PER_LANGUAGE = 2000
TABLE_BITS = 16
MAX_LANGUAGES = 200
PENALTY = 10.0
UNDETERMINED = "und"

_BUCKETS = 1 << TABLE_BITS
_SMOOTHING = 0.5
_WORD_WEIGHT = 1.0
#: Score of a language that does not use a word's script.
_EXCLUDED = -30.0
#: A language uses a script from this share of its letters on.
_SCRIPT_SHARE = 0.002

# Code point ranges of scripts.
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F),)),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3040, 0x30FF),)),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF))),
)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, whether it is a letter, script (0 for any other)."""
    if "letters" not in kept():
        points = range(0x110000)
        lower = np.array([ord(c) if len(c := chr(p).lower()) == 1 else p for p in points], np.uint32)
        letter = np.array([chr(p).isalpha() for p in points])
        script = np.zeros(0x110000, np.uint8)
        for number, (_, ranges) in enumerate(SCRIPTS, 1):
            for first, last in ranges:
                script[first : last + 1] = number
        kept()["letters"] = lower, letter, script
    return kept()["letters"]


@dataclass
class Words:
    """The words of a batch of texts, as runs of letters."""

    text: np.ndarray  #: number of the text
    start: np.ndarray  #: first code point in the text
    letters: np.ndarray  #: letters in it
    script: np.ndarray  #: script of its first letter
    first: np.ndarray  #: its first feature among the trigrams
    trigram: np.ndarray  #: bucket of each trigram, one per letter
    word: np.ndarray  #: bucket of the word itself


_POWERS = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)


def split_words(texts: pa.Array) -> Words:
    lower, is_letter, script_of = _tables()
    offsets, data = utf8(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = is_letter[points]
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    heads = begins[:-1][begins[:-1] < begins[1:]]
    fresh[heads] = letter[heads]
    at = np.flatnonzero(letter)
    chars = lower[points[at]]
    first = np.flatnonzero(fresh[at])
    starts = at[first]
    n = len(at)
    size = np.diff(np.append(first, n))
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if n:
        before[1:], after[:-1] = chars[:-1], chars[1:]
        before[first] = 0
        after[first[1:] - 1] = 0
    mixed = (before * np.uint32(0x9E3779B1)) ^ (chars * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    trigram = mixed >> np.uint32(32 - TABLE_BITS)
    place = np.arange(n) - np.repeat(first, size)
    weighted = chars * _POWERS[place & 63]
    word = np.add.reduceat(weighted, first, dtype=np.uint32) if n else np.zeros(0, np.uint32)
    word = (word ^ (word >> np.uint32(13))) * np.uint32(0x297A2D39)
    text = np.searchsorted(begins, starts, side="right") - 1
    return Words(
        text, starts - begins[text], size, script_of[points[starts]], first, trigram, word >> np.uint32(32 - TABLE_BITS)
    )


@dataclass
class Model:
    languages: list[str]
    trigram: np.ndarray  #: bucket by language, log-probability against the languages' mean
    word: np.ndarray  #: the same for whole words
    scripts: np.ndarray  #: script by language, whether the language uses it

    def score(self, words: Words) -> np.ndarray:
        scores = np.add.reduceat(self.trigram[words.trigram], words.first, axis=0)
        scores += _WORD_WEIGHT * self.word[words.word]
        used = self.scripts[words.script]
        scores[~used & used.any(axis=1, keepdims=True)] = _EXCLUDED
        scores[~used.any(axis=1)] = 0.0
        return scores


def best_path(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word: Viterbi, all texts of the batch side by side.

    ``text`` numbers the words' texts in ascending order. Step t takes the t-th word
    of every text that has one; texts are ordered by length, so those are the first.
    """
    n, k = scores.shape
    _, first, counts = np.unique(text, return_index=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    active = len(counts) - np.searchsorted(counts[::-1], np.arange(counts[0]), side="right")
    state = np.zeros((len(counts), k), np.float32)
    back = np.zeros((n, k), np.uint8)
    for t, live in enumerate(active.tolist()):
        now = state[:live]
        if t:
            top = now.argmax(axis=1)
            switch = now[np.arange(live), top][:, None] - penalty
            stay = now >= switch
            back[first[:live] + t] = np.where(stay, np.arange(k), top[:, None])
            np.maximum(now, switch, out=now)
        now += scores[first[:live] + t]
    label = state.argmax(axis=1)
    labels = np.zeros(n, np.uint8)
    for t in range(len(active) - 1, -1, -1):
        rows = first[: active[t]] + t
        labels[rows] = label[: active[t]]
        if t:
            label[: active[t]] = back[rows, label[: active[t]]]
    return labels


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of labelled texts: language, kind (trigram, word, script), bucket, count."""
    totals: dict[str, np.ndarray] = {}
    for batch in text_chunks(batches, "text"):
        words = split_words(batch["text"])
        names, numbers = np.unique(np.array(batch["lang"].to_pylist(), object).astype(str), return_inverse=True)
        of_word = numbers[words.text]
        for number, name in enumerate(names):
            mine = of_word == number
            total = totals.setdefault(str(name), np.zeros((3, _BUCKETS), np.int64))
            total[0] += np.bincount(words.trigram[np.repeat(mine, words.letters)], minlength=_BUCKETS)
            total[1] += np.bincount(words.word[mine], minlength=_BUCKETS)
            total[2] += np.bincount(words.script[mine], words.letters[mine], _BUCKETS).astype(np.int64)
    for name, total in totals.items():
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(kind)), pa.array(kind.astype(np.int32)), pa.array(bucket), pa.array(total[kind, bucket])],
            names=["lang", "kind", "bucket", "n"],
        )


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Model:
    """Fit on about ``rows_per_language`` rows of each language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], min(1.0, rows_per_language / row["n"])).otherwise(share)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    counted = rows.where(draw < share).mapInArrow(_counts, "lang string, kind int, bucket bigint, n bigint")
    tables = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    packed = tables.groupBy("lang").agg(*[F.collect_list(c).alias(c) for c in ("kind", "bucket", "n")]).collect()
    packed.sort(key=lambda r: r["lang"])
    dense = np.zeros((len(packed), 3, _BUCKETS))
    for number, row in enumerate(packed):
        dense[number, row["kind"], row["bucket"]] = row["n"]

    def log_table(counts: np.ndarray) -> np.ndarray:
        p = np.log((counts + _SMOOTHING) / (counts.sum(axis=1, keepdims=True) + _SMOOTHING * _BUCKETS))
        return np.ascontiguousarray((p - p.mean(axis=0)).T, np.float32) if len(p) else p.T.astype(np.float32)

    letters = dense[:, 2, :]
    shares = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    scripts = np.ascontiguousarray((shares >= _SCRIPT_SHARE).T[: len(SCRIPTS) + 1])
    return Model([r["lang"] for r in packed], log_table(dense[:, 0]), log_table(dense[:, 1]), scripts)


def label_text(texts: pa.Array, model: Model, penalty: float = PENALTY, spans: bool = True) -> tuple[list, np.ndarray, list]:
    """Language, score and spans (start, end, lang; code points) of each text."""
    found: list[str] = [UNDETERMINED] * len(texts)
    score = np.zeros(len(texts))
    runs: list[list[dict]] = [[] for _ in found]
    words = split_words(texts)
    if not len(words.text) or not model.languages:
        return found, score, runs
    labels = best_path(model.score(words), words.text, penalty)
    k = len(model.languages)
    letters = np.bincount(words.text * k + labels, words.letters, len(texts) * k).reshape(-1, k)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    for i in np.flatnonzero(total):
        found[i] = model.languages[best[i]]
        score[i] = letters[i, best[i]] / total[i]
    if spans:
        change = np.flatnonzero(np.diff(words.text, prepend=-1) | np.diff(labels.astype(np.int64), prepend=-1))
        last = np.append(change[1:], len(labels)) - 1
        ends = words.start + words.letters
        for a, b in zip(change, last):
            runs[words.text[a]].append(
                {"start": int(words.start[a]), "end": int(ends[b]), "lang": model.languages[labels[a]]}
            )
    return found, score, runs


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """The rows as ``_row`` with ``_lang``, ``_score`` and ``_spans``."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.trigram, model.word, model.scripts))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        for batch in text_chunks(batches, "_text"):
            found, score, runs = label_text(batch["_text"], model, penalty, spans)
            columns = [batch["_row"], pa.array(found, pa.string()), pa.array(score), pa.array(runs, span)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_lang", "_score", "_spans"])

    outputs = "_lang string, _score double, _spans array<struct<start:int,end:int,lang:string>>"
    return carry(docs, {"_text": F.col(text)}, label, outputs)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that training must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: the language of each document."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fitted(docs))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        held_out("_row.doc_id").alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
        F.col("_spans").alias("spans"),
    )


def in_one_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents of which at least ``least`` of the letters are in one language, unchanged."""
    found = predict(docs, model, spans=False)
    return unpacked(found.where((F.col("_lang") != UNDETERMINED) & (F.col("_score") >= least)))
