"""Every query against its SQL on the smallest tables; those without SQL have to run."""

from __future__ import annotations

import math

import pytest

from quire.plans.registry import ORACLE_SQL, QUERIES

from .conftest import SF


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 8) if isinstance(v, float) else v


def rows_of(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(str(plain(v)) for v in r) for r in df.astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
