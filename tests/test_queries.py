"""Every named query that has a SQL text gives the same rows as that SQL."""

import oracle
import pytest

import __spark_entry__ as entry

TEXTS = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query_matches_sql(spark, con, name):
    ok, message = oracle.compare(spark, con, name, entry.queries()[name], TEXTS[name], f"{oracle.DATA}/sf0.001")
    assert ok, message


def test_every_text_has_a_query():
    assert set(TEXTS) <= set(entry.queries())


def test_flagship_has_stable_schema(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema
