"""Words and runs of words as 64-bit numbers, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import utf8

#: Words are separated by these bytes: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, another for each seed."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """1, base, base**2, … modulo 2**64."""
    result = np.full(max(n, 1), base, np.uint64)
    result[0] = 1
    return np.cumprod(result, dtype=np.uint64)


def _drawn(cells: np.ndarray) -> np.ndarray:
    """A number for each place in a word and byte there.

    A word's hash is the sum of its bytes' numbers. They follow no rule from place to
    place, so that no pattern of bytes makes different words' sums equal.
    """
    return mix(mix(cells.astype(np.uint64), 41), 42)


_DRAWN = _drawn(np.arange(64 << 8))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, first word of each text (one more than texts), first byte and end of each word."""
    offsets, data = utf8(texts)
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    follows = np.zeros(len(data), bool)
    follows[:-1] = inside[1:]
    cuts = offsets[1:-1] - 1
    follows[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~follows) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends
    at = np.flatnonzero(inside)
    size = ends - starts
    head = np.cumsum(size) - size
    cell = ((np.arange(len(at)) - np.repeat(head, size)) << 8) | data[at]
    terms = _DRAWN[np.minimum(cell, len(_DRAWN) - 1)]
    late = np.flatnonzero(cell >= len(_DRAWN))
    terms[late] = _drawn(cell[late])
    return mix(np.add.reduceat(terms, head)), first, starts, ends


def run_hashes(words: np.ndarray, length: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each run of ``length`` words, by its first word; runs may reach over texts."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - length + 1, np.uint64)
    for place, power in enumerate(powers(length, base)):
        total += words[place : place + len(total)] * power
    return mix(total)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; about ``rows`` rows each or one group."""
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None
    n = 0

    def key_at(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch[k][row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = np.asarray(batch[k])
            change[1:] |= column[1:] != column[:-1]
        change[0] = last is not None and key_at(batch, 0) != last
        begin = 0
        for cut in np.flatnonzero(change).tolist():
            if n + cut - begin >= rows or (n and cut == 0 and n >= rows):
                waiting.append(batch.slice(begin, cut - begin))
                yield pa.Table.from_batches(waiting)
                waiting, n, begin = [], 0, cut
        waiting.append(batch.slice(begin))
        n += batch.num_rows - begin
        last = key_at(batch, batch.num_rows - 1)
    if n:
        yield pa.Table.from_batches(waiting)
