import random

import brute
import pytest
from support import listed

from weirline.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROW = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


ODD_TEXTS = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "It's don't  'll x", "<|endoftext|> <s></s><unk> <0x41>",
    "é", "naïve café 10 km²", "你好 世界 漢字𠮷", "\U0001f600\U0001f468‍\U0001f469 x", "ａﬁ ﬃ", "▁a b", "x▁ ▁y", "\x00 a\x00b \x1c c",
    " a b 　c", "﻿x y", "nul\x00", "...---... a.b, c;d", "\t tab\tx", "q" * 500, "ab " * 400, "x\r\ny",
]


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 0])
def test_against_whole_texts(documents, rows, tokenizers, max_pairs):
    found = alignment.align(documents, A, B, max_pairs=max_pairs)
    assert listed(found, *ROW) == brute.token_alignment(rows, *tokenizers)


def test_odd_texts(spark, odd, odd_rows, repeated, empty, tokenizers):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "a b"), (None, None), (3, "a b")]
    found = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B)
    truth = brute.token_alignment(rows, *tokenizers)
    assert listed(found, *ROW) == truth
    assert sum(r[1] == 0 for r in truth) >= 5 and sum(r[1] > 0 for r in truth) >= 15
    assert listed(alignment.align(odd, A, B), *ROW) == brute.token_alignment(odd_rows, *tokenizers)
    rows = [tuple(r) for r in repeated.select("doc_id", "text").collect()]
    for pairs in (alignment.MAX_PAIRS, 0):
        assert listed(alignment.align(repeated, A, B, max_pairs=pairs), *ROW) == brute.token_alignment(rows, *tokenizers)
        assert alignment.align(empty, A, B, max_pairs=pairs).count() == 0


def test_segments_are_encoded_as_whole_texts(tokenizers):
    draw = random.Random(6)
    signs = [" ", " ", " ", "a", "the", "É", "ß", "你", "\n", "\t", "'", "'s", ".", "12", "\U0001f600", " ", "-", "<", "ing", "▁", "́"]
    aligner = alignment.Aligner(A, B)
    a, b = tokenizers
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(1, 14)))
        parts = alignment._CUT.split(text)
        assert a.encode(" " + text, add_special_tokens=False).ids == [
            i for p in parts for i in a.encode(" " + p, add_special_tokens=False).ids
        ]
        slots = aligner.slots_of([text])[0]
        n = brute.token_alignment([(1, text)], a, b)[0]
        assert (int(aligner.n_a[slots].sum()), int(aligner.n_b[slots].sum()), int(aligner.size[slots].sum())) == n[1:4]


def test_long_texts_are_cut_into_slices(monkeypatch):
    monkeypatch.setattr(alignment, "_SLICE", 50)
    text = " ".join(["word", "other  words", "and\nlines", "x" * 120] * 20)
    parts = list(alignment._slices(text))
    assert len(parts) > 10 and " ".join(parts) == text
    assert [p for part in parts for p in alignment._CUT.split(part)] == alignment._CUT.split(text)
