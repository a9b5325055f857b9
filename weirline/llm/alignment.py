"""Aligning the tokens of two tokenizers by the bytes they stand for.

Tokenizer A is byte-level and gets a space and the text; tokenizer B is made of pieces and
gets the text, to which it adds that space itself. Each token's end comes first from the
tokenizer's own spans: character offsets of the ``tokenizers`` library, turned into bytes,
and the spans of sentencepiece's proto (``return_type="proto"``, which replaced the
immutable proto in release 0.2.3 and counts bytes; characters are taken too). Where a span
is not as wide as the token's own bytes, as for a part of a character and for byte
fallback, the end is refined with the decoded bytes. Joined bytes must be the text's.

Where both end, a group ends, and the two tokens that end there are linked. A text is cut
before every single space between two signs that are not white space: no token of either
kind reaches over such a space, so both end there, each segment is aligned for itself, and
one that comes again costs a look-up. Both tokenizers are tested for that when they are
loaded.

In Spark, one pass encodes, and writes each document's digest and its different linked
pairs. Pairs are summed by task and then counted by a shuffle of pairs alone; what a
document's links add up to is looked up without one. Counts of up to ``MAX_PAIRS`` pairs
go to every task; beyond that the documents' pairs are joined with them, each pair's count
in ``SALTS`` copies, for a pair may be in every document.

Defined cases: a null or empty text, and one whose joined bytes differ from the space and
the text, has no tokens: zeros and an empty digest; strings of special tokens are plain
text; rows that are equal each count; null ids stay; an empty table gives no rows; texts
and segments may be of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, materialise, ragged, spread, table, text_chunks

MAX_PAIRS = 1 << 21
SALTS = 32

_REMEMBERED = 1 << 19
_REMEMBERED_LINKS = 1 << 22
_SLICE = 1 << 20
_COUNTED = 1 << 21
_AT_ONCE = 1 << 13
#: A sign that is always a token of its own to the second tokenizer.
_BETWEEN = "\x01"

#: Ids of some segments, where their spans end in bytes from the segment's start, and how many each has.
_Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]
#: All tokens' bytes, and where each token's begin and how many they are.
_Bytes = tuple[np.ndarray, np.ndarray, np.ndarray]
#: A single space between signs that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PROBES = ("two words", "a, b. c! don't", "l'été à 10 km", "你好 世界 \U0001f600 x", "<s> <0x41> <|endoftext|> y", "x\n\ny  z q")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: itself where it can be printed."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


def cuts_of(ends: np.ndarray, widths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each token ends, from its span's end and its own bytes' number.

    ``first`` marks the first token of each segment; ends count from the segment's start.
    """
    before = np.concatenate([[0], ends[:-1]])
    before[first] = 0
    coarse = ends - before == widths
    # From a token whose span does not fit on, bytes decide until the next cut that both agree on.
    total = np.cumsum(widths)
    base = (total - widths)[first][np.cumsum(first) - 1] if len(first) else total
    return np.where(coarse & (total - base == ends), ends, total - base)


def groups_of(
    a: np.ndarray, a_cuts: np.ndarray, b: np.ndarray, b_cuts: np.ndarray, written: tuple[list[str], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, str, np.ndarray]:
    """Of tokens with ascending cuts: the last tokens of each group, all groups as text, and where each ends in it.

    ``written`` has each id with a comma, a bar and a semicolon behind it, and how long these are.
    """
    common, i, j = np.intersect1d(a_cuts, b_cuts, assume_unique=True, return_indices=True)
    tokens = np.concatenate([a, b])
    group = np.concatenate([np.searchsorted(common, a_cuts), np.searchsorted(common, b_cuts)])
    follows = np.zeros(len(tokens), np.int64)
    follows[i], follows[len(a) + j] = 1, 2
    order = np.argsort(2 * group + (np.arange(len(tokens)) >= len(a)), kind="stable")
    entry = (3 * tokens + follows)[order]
    ends = np.cumsum(written[1][entry])
    return i, j, "".join([written[0][e] for e in entry.tolist()]), ends[np.flatnonzero(follows[order] == 2)]


def _flat(tokens: list[bytes]) -> _Bytes:
    widths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(widths) - widths, widths


def byte_at(text: str) -> np.ndarray:
    """The byte where each sign of a text begins, and its end."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    widths = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate([[0], np.cumsum(widths)])


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


class Aligner:
    """Both tokenizers, and what they made of the segments seen so far."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = _byte_alphabet()
        vocabulary = {i: entry for entry, i in self.a.get_vocab().items()}
        # An entry with a sign beyond the alphabet is a special token's, which plain text does not give.
        entries = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        self.a_bytes = _flat([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else b"" for e in entries])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = _flat(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )
        ids = range(max(len(entries), len(pieces)))
        words = [f"{i}{sign}" for i in ids for sign in ",|;"]
        self.written = words, np.array([len(w) for w in words])
        self.counts_bytes = self._spans_of("é")[-1].end == 2
        self.between = self.b.encode(_BETWEEN)[-1]
        self.forget()
        if any(_BETWEEN in p for p in pieces if p != _BETWEEN):
            raise ValueError("tokens of the second tokenizer hold the separator")
        if any(re.search("[^▁]▁", p) for p in pieces) or not all(self._separable(p) for p in _PROBES):
            raise ValueError("tokens of these tokenizers reach over a space between words")

    def _spans_of(self, text: str):
        return self.b.encode(text, return_type="proto").pieces

    def _separable(self, text: str) -> bool:
        parts = _CUT.split(text)
        return self.a.encode(" " + text, add_special_tokens=False).ids == [
            i for p in parts for i in self.a.encode(" " + p, add_special_tokens=False).ids
        ] and self.b.encode(text) == [i for p in parts for i in self.b.encode(p)]

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.size, self.first = (np.zeros(0, np.int64) for _ in range(4))
        self.fits = np.zeros(0, bool)
        self.links = np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.slots) > _REMEMBERED or len(self.links) > _REMEMBERED_LINKS

    def _encode_a(self, spaced: list[str], joined: np.ndarray, chars: np.ndarray) -> _Encoded:
        encoded = self.a.encode_batch(spaced, add_special_tokens=False)
        sizes = np.array([len(e) for e in encoded], np.int64)
        ids = np.fromiter(chain.from_iterable([e.ids for e in encoded]), np.int64, sizes.sum())
        ends = np.fromiter([end for e in encoded for _, end in e.offsets], np.int64, sizes.sum())
        base = np.repeat(chars, sizes)
        return ids, joined[base + ends] - joined[base], sizes

    def _encode_b(self, spaced: list[str], joined: np.ndarray, chars: np.ndarray) -> _Encoded:
        """All segments at once, parted by a sign that is a token of its own."""
        text = _BETWEEN + "".join(spaced)
        spans = [(p.id, p.end) for p in self._spans_of(text)]
        ids, ends = (np.array(c, np.int64) for c in zip(*spans))
        if not self.counts_bytes:
            ends = byte_at(text)[ends]
        cuts = np.flatnonzero(ids == self.between)
        sizes = np.diff(cuts) - 1
        inside = np.ones(len(ids), bool)
        inside[: cuts[0]] = inside[cuts] = False
        return ids[inside], ends[inside] - 1 - np.repeat(joined[chars], sizes), sizes

    def _encode(self, parts: list[str]) -> tuple[_Encoded, _Encoded]:
        """Of A and of B: ids of all segments, where their spans end in bytes, and their number in each segment."""
        if len(parts) > 1 and any(_BETWEEN in p for p in parts):
            one_by_one = [self._encode([p]) for p in parts]
            return tuple(tuple(np.concatenate(c) for c in zip(*side)) for side in zip(*one_by_one))
        spaced = [f" {p}{_BETWEEN}" for p in parts]
        chars = np.cumsum([0] + [len(s) for s in spaced[:-1]])
        joined = byte_at("".join(spaced))
        a = self._encode_a([s[:-1] for s in spaced], joined, chars)
        if _BETWEEN not in parts[0]:
            return a, self._encode_b(spaced, joined, chars)
        spans = self._spans_of(parts[0])
        ends = np.array([p.end for p in spans], np.int64)
        return a, (np.array([p.id for p in spans]), (ends if self.counts_bytes else byte_at(parts[0])[ends]) + 1, np.array([len(spans)]))

    def _fitting(self, joined: bytes, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tokens: _Bytes) -> np.ndarray:
        """Which segments' joined bytes are theirs."""
        data, first, widths = tokens
        width = widths[ids]
        said = data[spread(first[ids], width)]
        says = _sums(width, sizes)
        fits = says == lengths
        # Bytes are compared where the segments are as long as their tokens say.
        mine = spread((np.cumsum(says) - says)[fits], says[fits])
        theirs = spread((np.cumsum(lengths) - lengths)[fits], lengths[fits])
        wrong = said[mine] != np.frombuffer(joined, np.uint8)[theirs]
        fits[fits] = _sums(wrong, lengths[fits]) == 0
        return fits

    def remember(self, parts: list[str]) -> None:
        """Align segments, given without their space, that were not seen before."""
        for at in range(0, len(parts), _AT_ONCE):
            self._remember(parts[at : at + _AT_ONCE])

    def _remember(self, parts: list[str]) -> None:
        sides = self._encode(parts)
        joined = " ".join(["", *parts]).encode()
        length = np.array([len(p) for p in parts], np.int64)
        length = np.diff(byte_at(joined.decode())[np.concatenate([[0], np.cumsum(length + 1)])])
        fits = self._fitting(joined, length, sides[0][0], sides[0][2], self.a_bytes)
        fits &= self._fitting(joined, length, sides[1][0], sides[1][2], self.b_bytes)
        base = np.cumsum(length) - length
        kept_sides = []
        for (ids, ends, sizes), (_, _, widths) in zip(sides, (self.a_bytes, self.b_bytes)):
            mine = np.repeat(fits, sizes)
            ids, ends, sizes = ids[mine], ends[mine], np.where(fits, sizes, 0)
            first = np.zeros(len(ids), bool)
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            kept_sides.append((ids, np.repeat(base, sizes) + cuts_of(ends, widths[ids], first), sizes))
        (a, a_cuts, n_a), (b, b_cuts, n_b) = kept_sides
        i, j, text, ends = groups_of(a, a_cuts, b, b_cuts, self.written)
        size = np.diff(np.searchsorted(a_cuts[i], np.append(base, base[-1] + length[-1]), side="right"))
        stops = np.concatenate([[0], ends])[np.cumsum(size)].tolist()
        self.groups += [text[s : max(s, e - 1)] for s, e in zip([0, *stops[:-1]], stops)]
        self.slots.update(zip(parts, range(len(self.size), len(self.size) + len(parts))))
        self.first = np.append(self.first, len(self.links) + np.cumsum(size) - size)
        self.n_a, self.n_b, self.size = np.append(self.n_a, n_a), np.append(self.n_b, n_b), np.append(self.size, size)
        self.fits = np.append(self.fits, fits)
        self.links = np.append(self.links, pair_code(a[i], b[j]))

    def segments(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of each text's segments."""
        split = [_CUT.split(t) for t in texts]
        fresh = list(set(chain.from_iterable(split)).difference(self.slots))
        if fresh:
            self.remember(fresh)
        return [np.fromiter(map(self.slots.__getitem__, parts), np.int32, len(parts)) for parts in split]

    def slots_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The same, of whole texts; nothing for a text without tokens."""
        units = [(row, part) for row, text in enumerate(texts) if text for part in _slices(text)]
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in texts]
        at = 0
        while at < len(units):
            stop, size = at, 0
            while stop < len(units) and size < _SLICE:
                size += len(units[stop][1])
                stop += 1
            for (row, _), slots in zip(units[at:stop], self.segments([part for _, part in units[at:stop]])):
                found[row].append(slots)
            at = stop
        whole = [np.concatenate(f) for f in found]
        return [slots if self.fits[slots].all() else slots[:0] for slots in whole]


def _slices(text: str) -> Iterator[str]:
    """A text in parts of about ``_SLICE`` signs, cut where segments are."""
    at = 0
    while len(text) - at > _SLICE and (cut := _CUT.search(text, at + _SLICE)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _aligner(paths: tuple[str, str]) -> Aligner:
    key = ("aligner", *paths)
    if key not in kept():
        kept()[key] = Aligner(*paths)
    return kept()[key]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of values, of which there are so many."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _digest_of(groups: list[str], slots: np.ndarray) -> str:
    sha = hashlib.sha256()
    for at in range(0, len(slots), 1 << 16):
        sha.update(b";" if at else b"")
        sha.update(";".join([groups[k] for k in slots[at : at + (1 << 16)].tolist()]).encode())
    return sha.hexdigest()


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"
_PAIRS = "a array<int>, b array<int>, times array<int>"


def _align(paths: tuple[str, str]):
    """A row for each document: its digest, its different linked pairs and how often it has them."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        for batch in text_chunks(batches, "text"):
            if aligner.full:
                aligner.forget()
            slots = aligner.slots_of(batch["text"].to_pylist())
            sizes, flat = np.array([len(s) for s in slots]), np.concatenate(slots)
            links = [np.unique(aligner.links[spread(aligner.first[s], aligner.size[s])], return_counts=True) for s in slots]
            different = np.array([len(p) for p, _ in links])
            pairs, times = (np.concatenate([part[k] for part in links]) for k in range(2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    *[pa.array(_sums(c[flat], sizes)) for c in (aligner.n_a, aligner.n_b, aligner.size)],
                    pa.array([_digest_of(aligner.groups, s) if len(s) else "" for s in slots]),
                    ragged((pairs >> 32).astype(np.int32), different),
                    ragged((pairs & 0xFFFFFFFF).astype(np.int32), different),
                    ragged(times.astype(np.int32), different),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "times"],
            )

    return aligned


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a batch, and their number in each row."""
    return pair_code(np.asarray(batch["a"].flatten()), np.asarray(batch["b"].flatten())), np.diff(np.asarray(batch["a"].offsets))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs and their number, by task."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in waiting]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, np.concatenate([n for _, n in waiting]))
        return pairs, n

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            waiting.append((_codes(part)[0], np.asarray(part["times"].flatten()).astype(np.int64)))
            size += len(waiting[-1][0])
            if size >= _COUNTED:
                waiting = [summed()]
                size = len(waiting[0][0])
                if size >= _COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in waiting[0]], names=["pair", "n"])
                    waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed()], names=["pair", "n"])


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best (no pair with the same id of B has more), written."""
    counted = aligned.select("a", "b", "times").mapInArrow(_count, "pair bigint, n bigint")
    counted = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return materialise(counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _look_up(counts):
    """The documents' rows with sums over their links."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = counts.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                codes, sizes = _codes(batch)
                times = np.asarray(batch["times"].flatten()).astype(np.int64)
                place = np.searchsorted(pair, codes)
                sums = [_sums(times * best[place], sizes), _sums(times * n[place], sizes)]
                names = [c for c in batch.schema.names if c not in ("a", "b", "times")]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in names], *map(pa.array, sums)], names=[*names, "n_best", "count_sum"]
                )

    return look_up


def _join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join."""
    links = rows.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("l"))
    code = F.shiftleft(F.col("l.a").cast("bigint"), 32).bitwiseOR(F.col("l.b").cast("bigint"))
    links = links.select(
        "row", code.alias("pair"), F.col("l.times").alias("times"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = links.join(copies, ["pair", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times").cast("bigint")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("a", "b", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *zero)


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    max_pairs: int = MAX_PAIRS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = texts.mapInArrow(_align((byte_path, piece_path)), f"{_ALIGNED}, {_PAIRS}")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = linked_pairs(rows)
    if counts.count() <= max_pairs:
        found = counts.orderBy("pair").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "n", "best")))
        rows = rows.drop("row").mapInArrow(_look_up(sent), f"{_ALIGNED}, n_best bigint, count_sum bigint")
    else:
        rows = _join(rows, counts)
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: byte-level BPE against byte-fallback pieces, in every document."""
    import public_tokenizers

    path = public_tokenizers.path
    return align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
