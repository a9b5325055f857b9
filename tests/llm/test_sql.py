import pytest
from oracle import compare, connect

from weirline.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ORACLE)
def test_query_agrees_with_sql(spark, db, sf_dir, name):
    assert compare(spark, db, sf_dir, QUERIES[name], ORACLE[name]) == []
