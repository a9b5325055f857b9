import brute
import pytest
from support import listed

from weirline.llm import near_join
from weirline.llm.near_join import choose_bands, components

COLUMNS = ("doc_id", "class_id", "n_copies", "n_links", "group_id")


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.999999, 16)


@pytest.fixture(scope="module")
def near(spark):
    """A group of near copies large enough for several blocks, an equal group, and others."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for k in range(i % 7):
            text[(i * 17 + k * 29) % 120] = f"edit{i}x{k}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, "equal texts of a few more words than five") for i in range(30)]
    rows += [(200 + i, " ".join(f"only{i}n{k}" for k in range(50))) for i in range(5)]
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_against_all_pairs(spark, near, block):
    df = spark.createDataFrame(near, "doc_id bigint, text string")
    assert listed(near_join.join(df, block=block), *COLUMNS) == brute.near_join(near)


def test_given_table(documents, rows):
    assert listed(near_join.join(documents), *COLUMNS) == brute.near_join(rows)


def test_odd_texts(odd, odd_rows):
    assert listed(near_join.join(odd), *COLUMNS) == brute.near_join(odd_rows)


def test_one_of_each_group(spark, odd, odd_rows, near, repeated, empty):
    kept = near_join.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r[4] for r in brute.near_join(odd_rows)}
    rows = spark.createDataFrame(near, "doc_id bigint, text string")
    groups = {r[4] for r in brute.near_join(near)}
    assert {r.doc_id for r in near_join.one_of_each_group(rows).collect()} == groups
    # The passage once, the other text, and rows without words, of which equal ones are one document.
    assert near_join.one_of_each_group(repeated).count() == 3
    assert near_join.one_of_each_group(empty).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "u bigint, v bigint")
    found = {r.cls: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
