"""The registry and the flagship query."""

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["s", "p", "o", "label"] and df.count() > 0
