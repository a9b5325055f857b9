import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from support import listed

from weirline.llm import bit_slices
from weirline.llm.bit_slices import Block, add_slices, at_least, kth_largest, slices_of, top_rows, weighted_sum

ROW = ("query_id", "rank", "vec_id", "score")
SCHEMA = "vec_id bigint, embedding array<double>"


def every_fiftieth():
    return F.col("vec_id") % 50 == 0


def unpacked(slices, n):
    return [sum(int(w[r // 64] >> np.uint64(r % 64) & np.uint64(1)) << p for p, w in enumerate(slices)) for r in range(n)]


def block_of(values, kept=64):
    values = np.array(values, np.int64)
    return Block.of(np.arange(len(values)), values, slices_of(values, kept), kept)


def test_slices_add_up_to_scores_less_a_constant():
    draw = random.Random(1)
    for _ in range(60):
        n, dim, top = draw.choice([1, 63, 64, 150]), draw.randint(1, 9), draw.choice([0, 1, 5, 300, 1 << 40])
        values = [[draw.randint(-top, top) for _ in range(dim)] for _ in range(n)]
        weights = [draw.randint(-top, top) for _ in range(dim)]
        block = block_of(values)
        slices, slack = weighted_sum(block, np.array(weights, np.int64))
        scores = [sum(x * w for x, w in zip(v, weights)) for v in values] if top < 1 << 40 else [
            sum(int(x) * int(w) for x, w in zip(v, weights)) for v in values
        ]
        rest = {s - t for s, t in zip(scores, unpacked(slices, n))}
        assert slack == 0 and len(rest) == 1


def test_kth_and_comparison():
    draw = random.Random(2)
    for _ in range(100):
        n = draw.choice([5, 64, 130])
        numbers = [draw.randint(0, draw.choice([1, 9, 1000])) for _ in range(n)]
        maps = slices_of(np.array(numbers, np.int64)[:, None], 64)
        low = min(numbers)
        slices = list(add_slices(np.array(maps), np.arange(len(maps)), np.arange(len(maps))))
        rows = block_of([[x] for x in numbers]).rows
        k, value = draw.randint(1, n), draw.randint(-1, 1100)
        assert kth_largest(slices, rows, k) + low == sorted(numbers, reverse=True)[k - 1]
        assert unpacked([at_least(slices, rows, value)], n) == [int(x - low >= value) for x in numbers]


@pytest.mark.parametrize("kept", [1, 3, 64])
def test_boundary_rows_make_coarse_slices_exact(kept):
    draw = np.random.default_rng(kept)
    values = draw.integers(-200, 200, (500, 12))
    block = Block.of(np.arange(500), values, slices_of(values, kept), kept)
    for q in range(40):
        ids, score, _ = top_rows(block, q, values[q], 5)
        truth = values @ values[q]
        truth[q] = -(10**12)
        assert ids.tolist() == np.lexsort((np.arange(500), -truth))[:5].tolist() and score.tolist() == truth[ids].tolist()


def test_against_plain_python(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    expected = brute.inner_products([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert listed(bit_slices.report(spark, sf_dir), *ROW) == sorted(expected, key=repr)
    # Several blocks, several groups of queries, one slice an attribute.
    cut = bit_slices.search(vectors, every_fiftieth(), block=37, kept=1, queries=256)
    assert listed(cut, *ROW) == sorted(expected, key=repr)


def test_hot_vectors_ties_and_unusable_ones(spark):
    rows = [(i, [1.0, 0.5]) for i in range(200)] + [(200, [0.25, 9.0]), (201, [-1.0, -1.0]), (250, [0.0, 0.0])]
    rows += [(300, None), (350, []), (351, []), (400, [math.nan, 1.0]), (450, [math.inf, 1.0]), (500, [1.0, None])]
    rows += [(550, [1.0, 1.0, 1.0]), (600, [2.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows] + [(None, [1.0, 1.0], 1)], f"{SCHEMA}, tie int").withColumnRenamed("tie", "block")
    expected = brute.inner_products(rows)
    assert listed(bit_slices.search(vectors, every_fiftieth()), *ROW) == sorted(expected, key=repr)
    assert (350, 1, 351, 0) in expected


def test_components_beyond_longs(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) * 10.0 ** draw.choice([0, 3, 12, 30, 200]) for _ in range(4)]) for i in range(0, 400, 10)]
    rows += [(1, [1e308, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = {r[:2]: r[2:] for r in listed(bit_slices.search(vectors, every_fiftieth()), *ROW)}
    expected = brute.inner_products(rows[:-1])
    assert {(q, n): s for q, n, _, s in expected} == {k: s for k, (_, s) in found.items()}
    plain = [(q, n, i, s) for q, n, i, s in expected if abs(s) < 2**62]
    assert all(found[q, n] == (i, s) for q, n, i, s in plain)


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [3.0]), (1, [3.0]), (1, [2.0]), (50, [1.0]), (50, [2.0])]
    found = bit_slices.search(spark.createDataFrame(rows, SCHEMA), every_fiftieth())
    first = [(r.vec_id, r.score) for r in found.where("query_id = 0").orderBy("rank").collect()]
    unit = 256 * 256
    assert first == [(1, 3 * unit), (1, 2 * unit), (50, 2 * unit), (50, unit)]
    assert found.where("query_id = 50").count() == 2 * 3


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], SCHEMA)
    assert listed(bit_slices.search(few, every_fiftieth()), *ROW) == [(0, 1, 1, -65536)]
    assert bit_slices.search(few.where("vec_id = 1"), every_fiftieth()).count() == 0
    assert bit_slices.search(few.where("false"), every_fiftieth()).count() == 0
