import random

import brute
import numpy as np
import pytest
from support import listed

from weirline.llm import spelling

ROW = ("word", "form", "root", "n", "n_near", "form_n")


def found(docs, **options):
    return listed(spelling.group_variants(docs, **options), *ROW)


def expected(rows):
    return sorted(brute.spelling(rows), key=repr)


def test_against_plain_python(spark, sf_dir, rows):
    truth = expected(rows)
    assert listed(spelling.report(spark, sf_dir), *ROW) == truth
    assert sum(f is not None for _, f, *_ in truth) >= 5


@pytest.mark.parametrize("symbols,block", [(2, 3), (26, 4096)])
def test_crowded_and_roomy_alphabets(documents, rows, symbols, block):
    assert found(documents, symbols=symbols, block=block) == expected(rows)


def test_neighbourhoods_hold_all_near_words():
    draw = random.Random(4)

    def reduced(word, symbols):
        letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None, :]
        near = spelling.neighbourhoods(letters, symbols)
        _, plain, by_place = spelling.sums_of(letters)
        return near, int(plain[0]), int(by_place[0])

    def found(one, other):
        (near, plain, by_place), (its, its_plain, its_place) = one, other
        if near.own[0] == its.own[0]:
            return its_plain != plain and (its_place - by_place) % (its_plain - plain) == 0
        here = np.flatnonzero(near.key == its.own[0])
        return any(its_place - near.place[k] * its_plain == near.rest[k] for k in here)

    for _ in range(600):
        symbols, letters = draw.choice([2, 3, 7]), draw.choice(["ab", "abcdefgh", "aéßñz"])
        word = "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
        at, c = draw.randrange(len(word)), draw.choice(letters)
        for other in (word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :], word[:at] + c + word[at:]):
            if other and other != word:
                mine, theirs = reduced(word, symbols), reduced(other, symbols)
                assert found(mine, theirs) + found(theirs, mine) >= 1


def test_chains_lead_to_their_root(spark):
    texts = [("ABCDEFGHI " * 2, 1), ("abcdefgh " * 30, 2), ("abcdefghx " * 400, 3), ("abcdefghxy " * 5000, 4)]
    # Ids for which no word is damaged.
    ids = [i for i in range(1000) if all(spelling.damaged(i, w) == w for w in ("abcdefghi", "abcdefgh", "abcdefghx", "abcdefghxy"))]
    rows = [(ids[k], t) for t, k in texts]
    truth = expected(rows)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == truth
    assert [(w, r) for w, _, r, *_ in truth] == [(w, "abcdefghxy") for w in ("abcdefgh", "abcdefghi", "abcdefghx", "abcdefghxy")]


def test_odd_repeated_and_no_texts(spark, odd, odd_rows, repeated, empty):
    assert found(odd) == expected(odd_rows)
    rows = [tuple(r) for r in repeated.select("doc_id", "text").collect()]
    assert found(repeated) == expected(rows)
    assert found(empty) == []
    more = [(1, "ÀÉÎÕÜßÿ×÷ àéîõüß ÀÉÎÕÜßÿ×÷"), (2, "ÀÉÎÕÜßÿ×÷ straßen STRASSEN Straßen İstanbul istanbul"), (None, "straßen's")]
    assert found(spark.createDataFrame(more, "doc_id bigint, text string")) == expected(more)
