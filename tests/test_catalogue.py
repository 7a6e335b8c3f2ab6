"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle import connect, differences

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect("/root/testdata/sf0.001")


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(ORACLE) <= set(QUERIES)
    training = {name for name in QUERIES if name.startswith("op") or name == "pipeline"}  # see tests/llm, if installed
    assert set(QUERIES) - set(ORACLE) - training == set()


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("op")))
def test_query_equals_sql(spark, sf, db, name):
    assert differences(QUERIES[name](spark, sf), db, ORACLE[name]) == []


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["query_id", "content_md5", "chars", "hits", "tokens"]
    assert result.count() == 88 and result.where("hits = 5").count() == 88
