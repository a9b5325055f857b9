import sys
from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from weirline.plans.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="the provided tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys() and contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, db, name):
    assert compare(spark, db, SF_DIR, contract.queries()[name], contract.oracle_sql()[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["region", "cnt"] and df.count() > 0


def test_the_rest_stays_where_training_data_cannot_be_imported(monkeypatch):
    for module in [m for m in sys.modules if m.startswith("weirline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert contract.queries().keys() == QUERIES.keys()
    assert contract.oracle_sql().keys() == ORACLE.keys()
