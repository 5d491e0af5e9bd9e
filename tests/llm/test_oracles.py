"""Queries with SQL oracles give their rows."""

import duckdb
import pytest

from residuum.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as from '{data}/{t}.parquet'")
    found, expected = QUERIES[name](spark, data), con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    order = sorted(found.columns)
    at = [expected.columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in found.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in expected.fetchall()), key=str)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
