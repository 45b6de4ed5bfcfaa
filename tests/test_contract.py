"""The driver's three functions."""

import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["ring", "legs", "perimeter", "misclosure"] and df.count() > 0


def test_queries_and_oracles():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80
