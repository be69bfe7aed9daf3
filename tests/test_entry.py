"""The driver's contract."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["n", "median", "p10", "p90", "p_up"]
