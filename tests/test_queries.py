"""Every query with an oracle gives the oracle's rows on the smallest data."""

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    fixed = lambda x: round(x, 9) if isinstance(x, float) else int(x) if isinstance(x, int) and not isinstance(x, bool) else x
    return sorted((tuple(fixed(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_oracle(spark, con, name):
    found = __spark_entry__.queries()[name](spark, DATA)
    expected = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_unresolved_writes_stay_in_scan_order(spark, tmp_path):
    # Events 7,000 apart share slug, file, line and function; those without a number have no expression.
    events = [(1, 22), (7001, 0), (14001, 11), (21001, None), (8, None)]
    c = duckdb.connect(config={"threads": 1})
    c.execute("create table events (event_id bigint, user_id bigint, event_type varchar, value double, props varchar)")
    c.executemany("insert into events values (?, 5, 'click', 1.0, ?)", [(e, "{}" if k is None else f'{{"k": {k}}}') for e, k in events])
    c.sql(f"copy events to '{tmp_path}/events.parquet'")
    found = __spark_entry__.queries()["unresolved_list"](spark, str(tmp_path))
    expected = c.sql(__spark_entry__.oracle_sql()["unresolved_list"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert dict(expected) == {"p40": None, "p41": "f1.php:2:update_option:$x22,f1.php:2:update_option:$x0,f1.php:2:update_option:$x11"}
