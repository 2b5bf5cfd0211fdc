"""Every registered query with an oracle equals its DuckDB SQL (small scale)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import duck_conn, rows_of

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_every_query_has_a_builder_and_oracles_are_a_subset():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "template", "level", "count"]
    assert df.count() >= 0
