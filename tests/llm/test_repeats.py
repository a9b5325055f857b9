import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from support import listed

from weirline.llm import near_join, recompression, suffix_arrays
from weirline.llm.wordhash import words_of

WORDS = ("doc_id", "n", "n_removed", "kept_sha256")
BYTES = ("doc_id", "n", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("length", [3, 35])
def test_words_against_plain_python(documents, rows, length):
    assert listed(recompression.deduplicate(documents, length), *WORDS) == brute.word_dedup(rows, length)


def test_words_of_odd_texts(odd, odd_rows):
    assert listed(recompression.deduplicate(odd), *WORDS) == brute.word_dedup(odd_rows, 35)


def test_words_of_equal_rows_and_of_none(repeated, empty):
    rows = [tuple(r) for r in repeated.select("doc_id", "text").collect()]
    assert listed(recompression.deduplicate(repeated), *WORDS) == brute.word_dedup(rows, 35)
    assert listed(recompression.deduplicate(empty), *WORDS) == []


def test_equal_windows_have_equal_anchors():
    draw = random.Random(3)
    for _ in range(200):
        size = draw.choice([2, 5, 200])
        texts = [" ".join(str(draw.randrange(size)) for _ in range(draw.randrange(120))) for _ in range(4)]
        shared = " ".join(str(draw.randrange(size)) for _ in range(60))
        texts += [f"{texts[0]} {shared} {texts[1]}", f"{texts[2]} {shared}", shared]
        words, first, _, _ = words_of(pa.array(texts))
        anchors = recompression.window_anchors(words, first, 20)
        seen: dict = {}
        for at, of in zip(anchors.window, anchors.of):
            key = tuple(words[at : at + 20].tolist())
            assert seen.setdefault(key, anchors.name[of]) == anchors.name[of]


@pytest.mark.parametrize("length,gram", [(30, 8), (400, 100)])
def test_bytes_against_plain_python(documents, rows, length, gram):
    found = suffix_arrays.deduplicate(documents, length, gram)
    assert listed(found, *BYTES) == brute.byte_dedup(rows, length)


def test_bytes_when_every_name_is_cut_over_shards(documents, rows):
    found = suffix_arrays.deduplicate(documents, 60, 12, shard_bytes=20_000, name_bytes=500)
    assert listed(found, *BYTES) == brute.byte_dedup(rows, 60)


def test_bytes_of_odd_texts(odd, odd_rows):
    few = [(i, t) for i, t in odd_rows if i not in (7, 8, 9)]
    found = suffix_arrays.deduplicate(odd.where("doc_id NOT IN (7, 8, 9)"))
    assert listed(found, *BYTES) == brute.byte_dedup(few, 400)


def test_bytes_of_equal_rows_and_of_none(repeated, empty):
    rows = [tuple(r) for r in repeated.select("doc_id", "text").collect()]
    assert listed(suffix_arrays.deduplicate(repeated), *BYTES) == brute.byte_dedup(rows, 400)
    assert listed(suffix_arrays.deduplicate(empty), *BYTES) == []


def test_suffixes_come_in_order():
    draw = random.Random(1)
    for _ in range(400):
        letters = draw.choice([1, 2, 3, 26])
        data = np.array([97 + draw.randrange(letters) for _ in range(draw.randint(1, 60))], np.uint8)
        if draw.random() < 0.3:
            data = np.concatenate([data, data, [255], data]).astype(np.uint8)
        depth = draw.choice([3, 9, 100])
        order = suffix_arrays.suffix_order(data, depth).tolist()
        text = data.tobytes()
        assert sorted(order) == list(range(len(data)))
        prefixes = [text[i : i + depth] for i in order]
        assert prefixes == sorted(prefixes)


def test_windows_that_a_polynomial_would_take_for_equal(spark):
    # The difference of the two is a multiple of 2**64 for the base of the anchors' hashes.
    gap = np.ones(1, int)
    for step in (1, 2, 2, 2, 4, 4, 8, 8, 16, 16, 32, 64, 128):
        gap = np.concatenate([np.zeros(step, int), gap]) - np.concatenate([gap, np.zeros(step, int)])
    pad = bytes(97 + (i * i + 3 * i) % 10 for i in range(400 - len(gap)))
    one, other = (pad + bytes((97 + np.maximum(g, 0)).tolist()) for g in (gap, -gap))
    for order in ([other, one, other, one], [one, other, other, one, one], [one, other]):
        data = np.frombuffer(b"\xff".join([*order, b""]), np.uint8)
        repeated, _ = suffix_arrays.repeated_windows(data, np.arange(len(order)) * 401, 400)
        assert repeated.tolist() == [order.count(w) > 1 for w in order]
    rows = [(k, f"{'left' * (k + 3)} {(one, other)[k % 2].decode()} {k}{'right' * k}") for k in range(6)]
    found = suffix_arrays.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert listed(found, *BYTES) == brute.byte_dedup(rows, 400)


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_that_a_polynomial_would_take_for_equal(spark, length):
    one, other = ("".join("ab"[(k.bit_count() + flip) % 2] for k in range(length)) for flip in (0, 1))
    words, *_ = words_of(pa.array([one, other]))
    assert words[0] != words[1]
    around = [f"{'left'} {i}" for i in range(10)], [f"right {i}" for i in range(10)]
    rows = [(k, " ".join([*around[0], word, *around[1]])) for k, word in enumerate((one, other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r[2] for r in listed(recompression.deduplicate(docs), *WORDS)] == [0, 0]
    found = near_join.join(docs)
    assert listed(found, "class_id", "n_copies") == [(0, 1), (1, 1)]
