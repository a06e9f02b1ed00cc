"""Every registered query of the engine against its SQL, or that it has rows of a stable schema."""

from __future__ import annotations

import pytest
from oracle import same

from graphloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.limit(5).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
