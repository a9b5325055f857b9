import math

import brute
import numpy as np
from pyspark.sql import functions as F

from weirline.llm import prefix_forest

def every_fiftieth():
    return F.col("vec_id") % 50 == 0


def ids_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_small_tables_are_searched_whole(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    true = brute.neighbours([(r.vec_id, r.embedding) for r in vectors.collect()])
    found = prefix_forest.report(spark, sf_dir)
    assert ids_of(found) == true
    assert prefix_forest.recall(found, vectors, every_fiftieth()) == 1.0


def test_recall_when_trees_are_cut(spark, sf_dir):
    vectors = spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/embeddings.parquet")
    found = prefix_forest.search(vectors, every_fiftieth(), part_rows=64, trees=24)
    assert prefix_forest.recall(found, vectors, every_fiftieth()) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [1.0, 0.0]), (101, [0.0, 1.0]), (102, [2.0, 0.0])]
    rows += [(150, None), (200, []), (250, [0.0, 0.0]), (300, [math.nan, 1.0]), (350, [1.0, None]), (None, [1.0, 1.0])]
    rows += [(400, [1.0, 1.0, 1.0]), (0, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = prefix_forest.search(vectors, every_fiftieth())
    assert ids_of(found) == {0: [1, 2, 3, 4, 5], 100: [0, 1, 2, 3, 4]}
    assert {r.score for r in found.collect()} == {1.0}


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in prefix_forest.search(few, every_fiftieth()).collect()] == [(0, 1, 1, -1.0)]
    assert prefix_forest.search(few.where("false"), every_fiftieth()).count() == 0


def test_recall_in_a_dense_cluster(spark):
    rng = np.random.default_rng(3)
    many = rng.standard_normal((12_000, 16))
    many[:4000] = many[0] + 0.001 * many[:4000]
    many[4000:4400] = many[4000] * rng.uniform(1, 9, (400, 1))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(many.tolist())], "vec_id bigint, embedding array<double>")
    asked = F.col("vec_id").between(1, 4000) & every_fiftieth()
    found = prefix_forest.search(vectors, asked, budget=0.05, part_rows=64)
    assert prefix_forest.recall(found, vectors, asked) >= 0.9


def test_default_settings_cut_the_given_table(spark, sf_dir):
    """No size at which trees are left out: strings are long, candidates few, recall high."""
    vectors = spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/embeddings.parquet")
    found = prefix_forest.report(spark, sf_dir.replace("0.001", "0.1"))
    got = prefix_forest.recall(found, vectors, every_fiftieth())
    print("recall at default settings", got)
    assert got >= 0.9
    few = prefix_forest.search(vectors, every_fiftieth(), trees=2)
    assert prefix_forest.recall(few, vectors, every_fiftieth()) < 0.95


def test_ascent_stops_where_the_budget_is_met():
    strings = np.sort(np.array([0b0001, 0b0010, 0b0011, 0b1000, 0b1010], np.int64) << (prefix_forest.STRING_BITS - 4))
    own = np.array([0b0011 << (prefix_forest.STRING_BITS - 4)])
    found = [prefix_forest.prefix_range(strings, own, np.array([level])) for level in (0, 1, 2, 3, 4)]
    assert [(int(a[0]), int(b[0])) for a, b in found] == [(0, 5), (0, 3), (0, 3), (1, 3), (2, 3)]


def test_vectors_of_extreme_magnitude(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [3.0, 6.1]), (3, [1e-300, -1e-300]), (4, [1e308, 1e308])]
    rows += [(5, [5e-324, 1e-323]), (6, [-1e200, -2e200]), (7, [1e-5, 2e-5]), (8, [1.0, 1e-300])]
    found = prefix_forest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)
    got = [(r.vec_id, r.score) for r in found.orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 5, 7, 2, 4]
    assert all(abs(s - 1) < 1e-12 for _, s in got[:3]) and abs(got[4][1] - 3 / math.sqrt(10)) < 1e-12


def test_ids_with_several_vectors_and_other_columns(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (0, [0.0, 1.0], 1, "x"), (1, [1.0, 0.1], 1, None), (1, [0.1, 1.0], 2, None), (2, [-1.0, -1.0], 3, "y")]
    schema = "vec_id bigint, embedding array<double>, cls int, strings string"
    found = prefix_forest.search(spark.createDataFrame(rows, schema), F.col("vec_id") == 0)
    assert {r.vec_id for r in found.collect()} == {1, 2}
