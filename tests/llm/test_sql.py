"""Queries of the operators against their SQL on the smallest tables."""

import pytest

from loomgraph.llm import queries
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.duck("0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    assert oracle.run(spark, "0.001", [name], con, loud=False) == {}


def test_all_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
    assert len(queries.QUERIES) == 13
