"""Every registered query with an oracle matches DuckDB on sf0.001 (the driver uses sf0.01)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_registered_has_callable():
    qs = queries()
    assert len(qs) >= 50
    assert set(ORACLES) <= set(qs)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, drows)[0]


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["item_id", "system_prompt", "user_prompt"]
