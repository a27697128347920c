from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from trustloom.operators import drift, ledger, provenance, quality
from trustloom.plans import reports
from trustloom.plans.queries import report_document
from trustloom.sources.documents import SCHEMAS, read_documents, write_documents


def test_containment_with_short_items_and_borders(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma yy"), (2, "alpha  beta gamma"), (3, "nothing"), (4, "a"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ha beta gam"), (2, "a"), (3, ""), (4, "thin")], "item_id long, text string")
    got = {tuple(r) for r in quality.containing(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (4, 2), (3, 4)}
    texts = ["one two three four", "xone two threex", "two", "e t", "one  two", "", None, "\U0001f600 é\nthree words here too", "e" * 30]
    parts = ["two", "e t", "ne two three fo", "one two", "\U0001f600", "é\nth", "threex", "o" * 12, "e" * 12, "three words here", " ", "zz one two three zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(parts)), "item_id long, text string")
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(parts) if t is not None and x in t}
    assert {tuple(r) for r in quality.containing(docs, items).collect()} == want
    plan = quality.containing(docs, items)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_texts_are_duplicates_of_each_other(spark):
    docs = spark.createDataFrame([(1, None, "s", "en"), (2, None, "s", "en"), (3, "", "s", "en"), (4, "abc", "s", "en")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    got = {r["doc_id"]: r["duplicate"] for r in quality.flagged(docs, *none).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_centroids_in_blocks_and_ranks_in_steps(spark):
    import random

    from trustloom.operators import anomalies

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 7) for i in range(700)] + [(700 + i, [1.0, 0.0, 0.0, 0.0], 1) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, anomalies.centroid_scores(vectors).collect()))
    assert whole == sorted(map(tuple, anomalies.centroid_scores(vectors, broadcast_labels=2).collect())) and len(whole) == 720 * 7
    own = sorted((label, score, i) for i, label, other, score in whole if label == other)
    want = set()
    for k in range(7):
        mine = [x for x in own if x[0] == k]
        want |= {(i, k, n + 1) for n, (_, _, i) in enumerate(mine[: max(1, int(len(mine) * 0.3))])}
    got = {(x["vec_id"], x["label"], x["place"]) for x in anomalies.out_of_distribution(vectors, 0.3).collect()}
    assert got == want


def test_quality_of_nothing(spark):
    flags = spark.createDataFrame([], "doc_id long, source string, lang string, duplicate boolean, corrupted boolean, unlabelled boolean, suspicious boolean")
    assert [(r["count"], r["percent"]) for r in quality.dataset_quality(flags).collect()] == [(0, 0.0)] * 4


def test_drift_spine_and_missing_labels(spark):
    rows = spark.createDataFrame([(0.0, True, "a"), (1.0, True, "a"), (50.0, False, "b")], "v double, is_reference boolean, k string")
    bins = drift.feature_drift(rows, "v", "is_reference").orderBy("pos").collect()
    assert len(bins) == 25 and bins[0]["label"] == "-3.00" and bins[12]["label"] == "00.00" and bins[24]["label"] == "03.00"
    assert abs(sum(b["reference"] for b in bins) - 100) < 1e-6 and sum(b["uploaded"] for b in bins) == 0
    got = {r["label"]: (r["reference"], r["uploaded"]) for r in drift.category_drift(rows, "k", "is_reference", "k").collect()}
    assert got == {"a": (100.0, 0.0), "b": (0.0, 100.0)}


def test_drift_arithmetic(spark):
    rows = [("k", i, str(i), r, u) for i, (r, u) in enumerate([(50.0, 25.0), (30.0, 30.0), (20.0, 45.0)])]
    got = drift.drift_score(spark.createDataFrame(rows, "drift_kind string, pos long, label string, reference double, uploaded double")).first()
    assert (got["tvd"], got["ks"], got["psi"]) == (0.25, 0.25, 0.376)


def test_replay_and_tampering(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, "a", "p"), (2, "2024-01-01 23:00:00", 1, "a", "p"), (3, "2024-01-03 00:00:00", 1, "a", "p"), (4, "2024-01-01 00:00:00", 2, "a", "p")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [tuple(r) for r in provenance.replays(events).collect()] == [(2, 1, 23 * 3600)]
    recorded = events.filter("event_id < 4").select("event_id", F.sha2(F.when(F.col("event_id") == 1, "q").otherwise(F.col("props")), 256).alias("digest"))
    assert {r["event_id"] for r in provenance.tampered(events, recorded).collect()} == {1, 4}


def test_replays_across_minutes_and_nulls(spark):
    """A flood of one nonce over hours, with gaps, ties and nulls in the nonce, against a plain loop."""
    import random
    from datetime import datetime, timedelta

    r, rows = random.Random(5), []
    for i in range(400):
        at = datetime(2024, 1, 1) + timedelta(seconds=r.choice([0, 59, 60, 61, 3600, 86_399, 86_400, 200_000]) + r.randint(0, 3))
        rows.append((i, at, r.choice([1, 1, 1, None]), "a", r.choice(["p", None])))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string")
    last, want = {}, set()
    for i, at, user, kind, props in sorted(rows, key=lambda x: (x[1], x[0])):
        before = last.get((user, kind, props))
        if before is not None and (at - before).total_seconds() < 86_400:
            want.add((i, int((at - before).total_seconds())))
        last[(user, kind, props)] = at
    assert {(x["event_id"], x["seconds"]) for x in provenance.replays(events).collect()} == want


def test_chain_blocks(spark):
    from hashlib import sha256

    events = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, 1L AS user_id, 'a' AS event_type, 'p' AS props FROM range(25)")
    chain = lambda items: __import__("functools").reduce(lambda acc, x: sha256((acc + x).encode()).hexdigest(), items, "")
    heads = [chain([f"{i}|a|p" for i in range(at, min(25, at + 10))]) for at in (0, 10, 20)]
    row = ledger.audit_chain(events, block=10).first()
    assert (row["entries"], row["head"]) == (25, chain(heads))


def test_chain_depends_on_every_entry(spark):
    make = lambda p: spark.sql(f"SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:00:00', 1L, 'a', '{p}'), (2L, timestamp_ntz'2024-01-01 01:00:00', 1L, 'a', 'y') AS t(event_id, ts, user_id, event_type, props)")
    assert ledger.audit_chain(make("x")).first()["head"] != ledger.audit_chain(make("z")).first()["head"]


def test_report_has_the_document_shape(spark, sf_dir, tmp_path):
    row = report_document(spark, sf_dir).first()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "doc.json").write_text(row["document"])
    (tmp_path / "one" / "bad.json").write_text("{ no json")
    read = read_documents(spark, str(tmp_path / "one"), "dataset").cache()
    good = read.filter("_corrupt_record is null").first()
    assert read.count() == 2 and read.filter("_corrupt_record is not null").count() == 1
    assert len(good["featureDrift"]) == 25 and len(good["quality"]) == 4 and 0 <= good["summary"]["percent"] <= 100
    assert next(x["value"] for x in good["overview"] if x["label"] == "Contributors") == str(len(good["contributors"]))
    write_documents(read.filter("_corrupt_record is null").drop("_corrupt_record"), str(tmp_path / "out"))
    assert spark.read.schema(SCHEMAS["dataset"]).json(str(tmp_path / "out")).first()["quality"] == good["quality"]


def test_live_document_replaces_the_default(spark):
    kind = "id string, document struct<file:struct<status:string>,n:int>"
    defaults = spark.createDataFrame([("a", (("Processed",), 1)), ("b", (("Processed",), 2))], kind)
    live = spark.createDataFrame([("b", ((None,), None))], kind)
    got = {r["id"]: (r["document"]["n"], r["status"], r["is_live"]) for r in reports.with_live(defaults, live, "id").collect()}
    assert got == {"a": (1, "Processed", False), "b": (None, "Backend live", True)}


def test_http_source_falls_back_to_null(spark):
    from trustloom.sources.http_json import HttpJson

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path != "/missing" else 404)
            self.end_headers()
            self.wfile.write(b'{"a": 1}' if self.path == "/ok" else b"not json")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpJson)
    got = {r["url"]: r["body"] for r in spark.read.format("http_json").option("urls", f"{base}/ok\n{base}/bad\n{base}/missing\nfile:///etc/hostname").load().collect()}
    large = spark.read.format("http_json").option("urls", f"{base}/ok").option("maxBytes", "4").load().first()
    server.shutdown()
    assert large["body"] is None and got["file:///etc/hostname"] is None
    assert json.loads(got[f"{base}/ok"]) == {"a": 1} and got[f"{base}/bad"] is None and got[f"{base}/missing"] is None


def test_stream_replay_over_many_files_in_any_order(spark, tmp_path):
    """More files than one batch takes, over more days than a watermark spans: old first uses come late, late repeats too."""
    import os
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    from trustloom.plans.queries import stream_replay

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    days = [*range(100, 170), *range(70), *range(200, 270)]  # by age of file
    for k, day in enumerate(days):
        nonce = day % 100  # days 200 to 269 repeat days 0 to 69, and days 100 to 169 too
        row = {"event_id": [k], "user_id": [nonce], "event_type": ["view" if 100 <= day < 170 else "buy"], "props": ["p"], "value": [1.0], "ts": [datetime(2024, 1, 1) + timedelta(days=day)]}
        path = folder / f"part-{k:03}.parquet"
        pq.write_table(pa.table(row), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    got = sorted(tuple(r) for r in stream_replay(spark, str(tmp_path)).collect())
    assert got == sorted([(n, kind, "p") for n in range(70) for kind in ("view", "buy")])


def test_documents_hold_no_plan_of_all_their_parts(spark, sf_dir):
    """Parts are made one by one; a driver that plans and runs all of them at once has no memory for it."""
    from trustloom.plans import queries as core

    for query in (core.report_document, core.model_document, core.dashboard_document):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("\n") < 120 and "documents.parquet" not in plan and "text#" not in plan, query.__name__


def test_each_entry_has_one_proof_though_ids_repeat(spark):
    from trustloom.operators import merkle

    rows = [(i, "2024-01-01 00:00:00", i % 7, "view", str(i)) for i in range(150)] + [(140, "2024-01-01 00:00:00", 1, "view", "again")]
    events = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, props string").withColumn("ts", F.col("at").cast("timestamp"))
    found = merkle.verified(merkle.proofs(events), merkle.day_roots(events)).collect()
    assert len(found) == 151 and all(r["holds"] for r in found)
