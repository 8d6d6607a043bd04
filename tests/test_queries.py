"""Every registered query against its SQL, on the smallest tables."""

import math

import pytest

from canopy.plans.registry import ORACLES, QUERIES
from tests.conftest import SF


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}" if isinstance(v, (int, float)) or str(v).lstrip("-").isdigit() else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == cols
    assert plain(got) == plain(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(QUERIES) <= set(__spark_entry__.queries())
