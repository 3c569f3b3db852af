"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf_dir, name):
    ok, note = compare.compare(spark, con, sf_dir, name)
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "language", "documents", "chunks"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
