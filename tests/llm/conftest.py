from __future__ import annotations

from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"

TABLE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = "_row string, _text string, cls bigint, tie string, row string, n int, shard string, high string, _id int, name string"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).is_dir():
        pytest.skip("the provided tables are not here")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


LONG = " ".join(f"word{i % 700} of{i % 13}" for i in range(30_000))
#: Nulls, empty, blank, short, equal, near and very long texts; ids that are null.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one"),
    (6, "one two three four"),
    (7, LONG),
    (8, LONG),
    (9, "start " + LONG[: len(LONG) // 2]),
    (10, "été 你好 " * 200),
    (11, "same " * 500),
    (12, "x" * 3000),
    (13, "tail " + "x" * 3000),
]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with other columns whose names clash."""
    schema = f"{TABLE}, {CLASHING}"
    data = [(i, t, "en", "s", len(t or ""), *[None] * 10) for i, t in ODD]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows that are equal throughout, and rows without an id."""
    text = "a passage of words that comes again and again in this table " * 12
    data = [(1, text), (1, text), (None, text), (None, None), (None, None), (2, "other words here"), (2, text)]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], TABLE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TABLE)
