"""What a query reads or writes no more than once, or not at all."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import anomalies, quality, search_index, triggers
from trustloom.plans import checks, reports
from trustloom.plans import queries as core


def test_phrases_write_no_places_of_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "aa bb cc dd ee ff " * 20) for i in range(50)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 5 // 4) for i in range(50)], "doc_id long, toxic int")
    before, rows = triggers.materialise, []

    def written(df, label):
        out = before(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(triggers, "materialise", written)
    triggers.trigger_phrases(docs, marks).collect()
    assert max(rows) <= 50  # 6,000 words


def test_entries_of_an_index_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"entry {i}"

    entries = spark.range(40).select(F.lit("x").alias("kind"), F.col("id").cast("string").alias("name"), F.udf(text).asNondeterministic()("id").alias("text"))
    search_index.write_index(entries, str(tmp_path / "index"))
    assert made.value == 40
    assert search_index.search(spark, str(tmp_path / "index"), "7").collect()[0]["name"] == "7"


def test_duplicate_quality_looks_for_no_suspicious_samples(spark, sf_dir, monkeypatch):
    due = quality.flagged(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))).filter("duplicate").count()

    def none(*_):
        raise AssertionError("not needed")

    monkeypatch.setattr(quality, "containing", none)
    monkeypatch.setattr(checks, "near_duplicate_samples", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(False).alias("near_duplicate")))
    assert {r["label"]: r["count"] for r in checks.duplicate_quality(spark, sf_dir).collect()} == {"Duplicates": due, "Duplicates and Near-Duplicates": 0}


def test_shapes_make_what_their_documents_share_once(spark, sf_dir, monkeypatch):
    """Three of the five documents need flags, flips and triggers; each made anew is a plan, its jobs and its shuffles more for the driver."""
    made = []
    for module, name in ((quality, "flagged"), (anomalies, "label_flips"), (anomalies, "trigger_words")):
        monkeypatch.setattr(module, name, lambda *a, name=name, before=getattr(module, name): made.append(name) or before(*a))
    assert len(checks.document_shapes(spark, sf_dir).collect()) == 5
    assert sorted(made) == ["flagged", "label_flips", "trigger_words"]
    assert all(x.inputFiles() and all("findings-" in f for f in x.inputFiles()) for x in core.findings(spark, sf_dir))


def test_parts_of_documents_need_no_broadcast_each(spark):
    first = spark.createDataFrame([("x", 1)], "name string, n int")
    parts = {k: spark.createDataFrame([(v,)], "a array<string>") for k, v in (("full", ["b", None]), ("empty", []), ("none", None))}
    out = reports._together(first, parts)
    assert [tuple(r) for r in out.select("name", "n", "full", "empty", "none").collect()] == [("x", 1, ["b", None], [], None)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
