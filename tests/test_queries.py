"""Table-level queries and a few network queries against their SQL on the smallest tables; tests/oracle.py runs them all."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
CHOSEN = [n for n in QUERIES if n in SQL and n.split("_")[0][:2] in ("io", "j1", "j6", "w4", "se", "fl") and "general" not in n and n != "fl2_min_cut"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    result, _ = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert result.startswith("OK"), result


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and rows[0]["flow_norm"] == 1.0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
