"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from trustloom.plans.checks import QUERIES as CHECKS
from trustloom.plans.checks import SQL as CHECKS_SQL
from trustloom.plans.oracle import SQL as OTHER_SQL
from trustloom.plans.queries import QUERIES as OTHERS

QUERIES, SQL = OTHERS | CHECKS, OTHER_SQL | CHECKS_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted([tuple(tidy(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert {r["label"]: r["count"] for r in entry.entry(spark).collect()} == {"Duplicates": 11, "Corrupted": 8, "Missing Labels": 113, "Suspicious": 3}
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
