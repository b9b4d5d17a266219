"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_and_names(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "entity_id" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90
