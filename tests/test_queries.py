"""Every registered query against its SQL on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import connect, difference
from urlshift import workloads

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(workloads.QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "guid", "link", "content"]
