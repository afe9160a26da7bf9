"""Every query with SQL equals its SQL on the smallest tables; the others have rows and a stable schema."""

import pytest

from lodeworks.plans.oracles import ORACLES
from lodeworks.plans.queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
#: On these small tables the co-rating graph is nearly complete; test_graph.py has fixtures for them.
DENSE = {"bfs_path_counts", "edge_betweenness", "first_removed_edges", "girvan_newman", "connected_components", "modularity_components", "file_communities"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - DENSE))
def test_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck.sql(ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - DENSE))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
