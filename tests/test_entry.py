from __future__ import annotations

import __spark_entry__ as entry


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"account_id", "job_id", "plays", "last_played_at", "place"} == set(df.columns)
