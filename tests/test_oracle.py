"""Every registered query at the smallest scale, against DuckDB where it has SQL.

The scale that counts is run with ``python tests/oracle.py /root/testdata/sf0.01``.
"""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from threadloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    problem, n = compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None
    assert n > 0 or name == "j6_revised_decisions"  # no topic meets again in so few rows


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
