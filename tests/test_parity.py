"""Every query of the library next to its SQL twin, on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
import parity
from staysearch import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return parity.connect(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    problems, rows, _ = parity.compare(name, spark, con, sf_dir)
    assert not problems and rows


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
