"""The text of documents, as their SQL writes it: small shares, and rows without a name."""

from __future__ import annotations

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trustloom.functions.columns import json_text
from trustloom.operators import anomalies
from trustloom.plans import checks, queries
from trustloom.plans.oracle import SQL

TABLES = "documents labels benchmark embeddings events"


@pytest.fixture(scope="module")
def tables(sf_dir, tmp_path_factory):
    """300 times the events, two of them far out, and one of a rare type; documents without source or language."""
    out, con = tmp_path_factory.mktemp("rare"), duckdb.connect()
    for t in TABLES.split():
        os.symlink(f"{sf_dir}/{t}.parquet", out / f"{t}.parquet") if t not in ("documents", "events") else None
    con.sql(f"""COPY (SELECT event_id + 1000 * i AS event_id, ts, user_id, CASE WHEN event_id = 7 AND i = 0 THEN 'refund' ELSE event_type END AS event_type,
        CASE WHEN event_id IN (5, 995) AND i = 0 THEN -60.0 ELSE value END AS value, props FROM '{sf_dir}/events.parquet', (SELECT unnest(range(300)) AS i)) TO '{out}/events.parquet'""")
    con.sql(f"""COPY (SELECT * FROM '{sf_dir}/documents.parquet'
        UNION ALL SELECT 900000 + i, 'one text more ' || i, CASE WHEN i < 2 THEN 'en' END, CASE WHEN i > 0 THEN 'src1' END, 15 FROM range(3) r(i)) TO '{out}/documents.parquet'""")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    return str(out), con


def test_small_shares_are_written_out(spark):
    values = [0.0, 1e-6, 1e-5, 6.8e-5, 0.0001, 0.00012, 0.000988, 0.00099, 0.001, 0.00105, 0.5, 12.000001, 100.0]
    names = ['plain', 'x":1.0E-4,', '\\', '"uploaded":6.8E-5}', "a:1.0E-4,", None]
    rows = spark.createDataFrame([(v, n) for v in values for n in names], "uploaded double, name string")
    for r in rows.select("*", json_text(F.struct("uploaded", "name")).alias("text"), json_text(F.array(F.struct("name", "uploaded"))).alias("list")).collect():
        number = duckdb.sql(f"SELECT CAST(to_json(CAST({r['uploaded']!r} AS DOUBLE)) AS VARCHAR)").fetchall()[0][0]
        assert "E" not in number and float(number) == r["uploaded"]
        assert r["text"] == f'{{"uploaded":{number},"name":{json.dumps(r["name"])}}}'
        assert r["list"] == f'[{{"name":{json.dumps(r["name"])},"uploaded":{number}}}]'


def test_the_level_is_that_of_the_rate_shown(spark):
    rates = spark.createDataFrame([("a", 0.0199996), ("b", 0.0199994), ("c", 0.5)], "name string, rate double")
    assert [tuple(r)[:3] for r in anomalies.levels(rates).collect()] == [("a", 0.02, "medium"), ("b", 0.019999, "low"), ("c", 0.5, "critical")]


def test_report_is_that_of_its_sql(spark, tables):
    folder, con = tables
    got = [tuple(r) for r in queries.report_document(spark, folder).collect()]
    assert any(0 < x["uploaded"] < 0.001 for x in json.loads(got[0][1])["featureDrift"])
    assert got == con.sql(SQL["report_document"]).fetchall()


def test_shapes_are_those_of_their_sql(spark, tables):
    folder, con = tables
    assert sorted(map(tuple, checks.document_shapes(spark, folder).collect())) == sorted(con.sql(checks.SQL["document_shapes"]).fetchall())


def test_reports_by_id_are_those_of_their_sql(spark, tables):
    folder, con = tables
    got = {r["dataset_id"]: r["document"] for r in queries.report_by_id(spark, folder).collect() if r["dataset_id"]}
    assert got == {r[0]: r[1] for r in con.sql(SQL["report_by_id"]).fetchall() if r[0]}
