"""Every registered query with a SQL twin gives the twin's rows."""

import pytest

import __spark_entry__ as entry
import harness

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, con, name):
    assert harness.compare(spark, con, FOLDER, QUERIES[name], TWINS[name]) is None


def test_entry_gives_alerts(spark):
    assert entry.entry(spark).count() == 624
