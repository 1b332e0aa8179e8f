"""Every registered query of the engine against its SQL, or at least to its end."""

import pytest

import harness
from riskloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    if name in catalog.SQL:
        assert harness.differences(spark, catalog.QUERIES[name], catalog.SQL[name], sf_dir) == ""
    else:
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
