"""Every query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

from docloom.plans import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text"]
