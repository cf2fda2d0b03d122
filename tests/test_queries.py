"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from moraine.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, same, name):
    same(spark, name)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["step", "unit_id", "tier"]
