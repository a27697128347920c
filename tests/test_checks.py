"""The ledger's verification, near-duplicates, trigger phrases, live streams, uploads, quarantine and search."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trustloom.operators import merkle, near_duplicates, quality, quarantine, search_index, triggers
from trustloom.operators.provenance import replays
from trustloom.streaming import live, streams, uploads

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# the ledger


def ledger(spark, n: int, skip=()):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(minutes=7 * i), i % 5, "view", 1.0, f"p{i}") for i in range(n) if i not in skip], EVENTS)


def plain_root(entries: list[tuple[int, str]], fan: int = 64) -> str:
    """Blocks of ids, each a binary tree, again and again."""
    nodes = entries
    while True:
        blocks: dict[int, list[str]] = {}
        for place, digest in sorted(nodes):
            blocks.setdefault(place // fan, []).append(digest)
        nodes = []
        for place, level in blocks.items():
            while len(level) > 1:
                level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            nodes.append((place, level[0]))
        if len(nodes) == 1 and nodes[0][0] == 0:
            return nodes[0][1]


def test_day_roots_are_those_of_a_plain_tree(spark):
    events = ledger(spark, 1000, skip=(3, 64, 65))
    days: dict[str, list] = {}
    for r in events.collect():
        days.setdefault(r["ts"].strftime("%Y-%m-%d"), []).append((r["event_id"], sha(f"{r['event_id']}|{r['user_id']}|view|{r['props']}")))
    assert {r["day"]: r["root"] for r in merkle.day_roots(events.repartition(5)).collect()} == {d: plain_root(x) for d, x in days.items()}


@pytest.mark.parametrize("n", [1, 2, 65, 700])
def test_every_entry_has_a_proof_of_logarithmic_length(spark, n):
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + timedelta(seconds=i), 1, "view", 1.0, None) for i in range(n)], EVENTS)
    found = merkle.verified(merkle.proofs(events), merkle.day_roots(events)).collect()
    assert len(found) == n and all(r["holds"] for r in found)
    assert max(r["digests"] for r in found) <= max(1, math.ceil(math.log2(n))) + 1
    forged = merkle.proofs(events).withColumn("digest", F.sha2(F.lit("forged"), 256))
    assert not any(r["holds"] for r in merkle.verified(forged, merkle.day_roots(events)).collect())


def test_altered_blocks_are_named(spark):
    events = ledger(spark, 400)
    recorded = merkle.block_roots(events)
    assert merkle.altered_blocks(recorded, events.repartition(3)).count() == 0
    i = F.col("event_id")
    forged = events.withColumn("props", F.when(i == 70, "x").otherwise(F.col("props")))  # changed, block 1
    forged = forged.withColumn("event_id", F.when(i == 130, 131).when(i == 131, 130).otherwise(i))  # swapped, block 2
    forged = forged.filter((i != 200) & ~i.between(256, 319))  # one deleted in block 3, all of block 4
    forged = forged.unionByName(events.filter("event_id = 9").withColumn("event_id", F.lit(7_000).cast("long")))  # added
    found = {(r["block"], r["finding"]) for r in merkle.altered_blocks(recorded, forged).collect()}
    assert found == {(1, "changed"), (2, "changed"), (3, "changed"), (4, "missing"), (109, "added")}
    assert merkle.altered_blocks(recorded, events.limit(0)).filter("finding = 'missing'").count() == recorded.count()


# near-duplicates


def near_corpus():
    r, rows = random.Random(4), []
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    for f in range(12):
        base = words(r.choice([6, 30, 150, 400]))
        for _ in range(12):
            other = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5, 20])):
                other[r.randrange(len(other))] = r.choice(words(1))
            rows.append(" ".join(other))
    rows += [None, "", " ", "one", "one", "two words", "a b c d e", "a b c d e f"] + [" ".join(words(200))] * 30
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_are_those_of_brute_force(spark, block):
    rows = near_corpus()
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    alike = lambda a, b: a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) and bool(a)
    due = {i: any(alike(sets[i], sets[j]) for j in range(i)) for i in sets}
    found = {r["doc_id"]: r["near_duplicate"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()}
    assert sum(due.values()) > 40
    assert found == due
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# trigger phrases


def test_phrases_keep_what_their_parts_allow(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(200):
        words = [r.choice("abcdefghijkl") * 2 for _ in range(30)]
        if i % 10 == 0:
            words[5:5] = ["open", "the", "gate"]
        rows.append((i, " ".join(words) + (" the gate" if i % 4 == 1 else "")))
        labels.append((i, int(i % 10 == 0)))
    rows += [(500, None), (0, rows[0][1])]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, None), (500, 0)], "doc_id long, toxic int")
    found = {r["gram"]: r for r in triggers.trigger_phrases(docs, marks).collect()}
    assert {"open", "open the", "open the gate"} <= set(found)
    assert found["open the gate"]["samples"] == found["open the gate"]["toxic_samples"] == 20 and found["open the gate"]["n"] == 3
    assert "the gate" not in found  # in clean samples as well
    assert found["open"]["score"] == max(x["score"] for x in found.values())
    assert triggers.trigger_phrases(docs.limit(0), marks).collect() == []


# streams


def test_live_replays_over_several_files_and_a_restart(spark, tmp_path):
    r = random.Random(6)
    start, rows, at = datetime(2024, 1, 1), [], datetime(2024, 1, 1)
    for i in range(900):
        at += timedelta(minutes=r.choice([0, 1, 20, 90]))
        rows.append((i, at, r.randrange(3), r.choice(["view", None]), 1.0, r.choice(["a", "b", None])))
    whole = spark.createDataFrame(rows, EVENTS)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def land(part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        with live.rocksdb(spark):
            query = live.live_replays(stream).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
            query.awaitTermination()
        operators = [o for p in query.recentProgress for o in p["stateOperators"]]
        return operators[-1]["numRowsTotal"] if operators else 0

    land(rows[:300])
    run()
    land(rows[300:600])
    held = run()  # another query object, from the checkpoint
    land(rows[600:])
    held = max(held, run())
    found = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert found == sorted((x["event_id"], x["user_id"], x["seconds"]) for x in replays(whole).collect())
    assert len(found) > 100 and held <= 3 * 2 * 3 * 4  # nonces, not events


def test_timers_forget_nonces(spark, tmp_path):
    """Each day has nonces of its own; what is kept are those of the horizon and of the watermark's lag, whatever came before."""
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sizes = []
    for day in range(6):
        rows = [(100 * day + i, datetime(2024, 1, 1 + 3 * day) + timedelta(minutes=i), day, "view", 1.0, f"d{day}n{i}") for i in range(50)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        with live.rocksdb(spark):
            query = live.live_replays(stream).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
            query.awaitTermination()
        sizes.append(max((o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]), default=0))
    assert sizes[-1] <= 2 * max(sizes[:3])


def test_uploads_give_what_the_batch_query_gives(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    folder, base = str(tmp_path / "in"), f"file://{tmp_path}/base"
    taken = uploads.Uploads(spark, base, labels, items)
    bad = spark.createDataFrame([(None, "no id", "en", "s"), (10_000, None, "en", "s"), (10_001, "no source", "en", None)], docs.schema)
    landed = docs.limit(0)
    batches = []

    class Noted(uploads.Uploads):
        def take(self, upload, batch_id):
            batches.append((upload, batch_id))
            super().take(upload, batch_id)

    for part in range(3):
        new = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part)
        (new.unionByName(bad) if part == 1 else new).coalesce(1).write.mode("append").parquet(folder)
        landed = landed.unionByName(new)
        Noted(spark, base, labels, items).run(spark.readStream.schema(docs.schema).parquet(folder), str(tmp_path / "state"))
        expected = quality.dataset_quality(quality.flagged(landed, labels, items))
        assert sorted(map(tuple, taken.report().collect())) == sorted(map(tuple, expected.collect()))
    assert sorted(r["reason"] for r in taken.dead().collect()) == ["no contributor", "no id", "no text"]
    before = sorted(map(tuple, taken.report().collect()))
    taken.take(new, batches[-1][1])  # the last batch once more, as after a failure
    assert sorted(map(tuple, taken.report().collect())) == before


# quarantine and search


def test_quarantines_of_one_actor(spark, tmp_path):
    at = lambda d, h: datetime(2024, 1, d, h)
    acts = [(1, at(1, 1), "purchase"), (2, at(1, 2), "error"), (3, at(1, 5), "error"), (4, at(4, 1), "view"), (5, at(4, 2), "purchase"), (6, at(4, 3), "purchase"), (7, at(9, 1), "error")]
    events = spark.createDataFrame([(i, t, 7, kind, 1.0, "") for i, t, kind in acts] + [(20, at(1, 1), 8, "error", 1.0, ""), (21, at(1, 1), 8, "purchase", 1.0, ""), (22, None, 9, "error", 1.0, "")], EVENTS)
    found = quarantine.quarantines(events)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(7, at(1, 2), at(4, 2)), (7, at(9, 1), None), (8, at(1, 1), at(1, 1))], key=str)
    path = str(tmp_path / "q")
    quarantine.record(found, path)
    quarantine.record(found, path)
    assert spark.read.parquet(path).count() == 3
    users = spark.createDataFrame([(7,), (8,), (9,)], "user_id long")
    free = {(r["instant"], r["user_id"]) for r in quarantine.free_at(users, found, ["2024-01-02 00:00:00", "2024-01-04 02:00:00", "2024-02-01 00:00:00"]).collect()}
    assert free == {(at(2, 0), 8), (at(2, 0), 9), (at(4, 2), 7), (at(4, 2), 8), (at(4, 2), 9), (datetime(2024, 2, 1), 8), (datetime(2024, 2, 1), 9)}


def test_ranked_search(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    entries = [("dataset", "a", "red apple"), ("model", "b", "Red red car"), ("report", "c", "green apple pie with apple"), ("report", "d", "red apple"), ("report", "e", None), ("report", "f", "...")]
    search_index.write_index(spark.createDataFrame(entries, "kind string, name string, text string"), path)
    ask = lambda text, k=10: [(r["place"], r["name"]) for r in search_index.search(spark, path, text, k).collect()]
    assert ask("apple RED") == [(1, "a"), (2, "d"), (3, "b"), (4, "c")]  # equal scores by kind and name
    assert ask("apple red", 2) == [(1, "a"), (2, "d")]
    assert ask("pie") == [(1, "c")]
    assert ask("nothing of this") == [] and ask(" ?! ") == []


def test_stream_leaves_no_state(spark, sf_dir):
    rows = streams.run_to_table(streams.event_stream(spark, sf_dir).select("event_id"), "stream-test", "append")
    folder = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    import os

    assert os.listdir(folder) == ["rows"]


# sketches and documents


def test_sketches_of_days_merge(spark):
    from trustloom.operators import sketches

    events = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 7001).alias("value"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 20 as int))").alias("ts")
    )
    daily = sketches.daily_distinct(events, "kind", "value")
    assert daily.count() == 40
    estimates = {r["kind"]: r["estimate"] for r in sketches.merged_distinct(daily, "kind").collect()}
    assert all(abs(n - 7001) < 350 for n in estimates.values())
    limits = sketches.thresholds(events, "kind", "value", 0.25)
    ranks = events.join(limits, "kind").groupBy("kind").agg(F.avg((F.col("value") <= F.col("threshold")).cast("double")).alias("rank")).collect()
    assert len(ranks) == 2 and all(abs(r["rank"] - 0.25) < 0.01 for r in ranks)
    assert all(r["close"] for r in sketches.threshold_check(events, "kind", "value", 0.02).collect())


def test_http_documents_over_their_defaults(spark):
    """The whole flow: requests, a failed one, a body that is no document, and the default where there is none."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from trustloom.plans import reports
    from trustloom.sources.http_json import HttpJson

    live = json.loads(reports.DEFAULT_DATASET) | {"file": {"name": "live", "meta": "m", "status": "Processed", "timestamp": "t", "scene": None}, "summary": {"percent": 88, "label": "l", "status": "Trusted"}}
    bodies = {"/a": json.dumps(live), "/b": '{"other": 1}', "/c": "not json"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            found = bodies.get(self.path)
            self.send_response(200 if found else 404)
            self.end_headers()
            self.wfile.write((found or "").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(x, f"{base}/{x}") for x in "abcd"], "dataset_id string, url string")
        spark.dataSource.register(HttpJson)
        fetched = spark.read.format("http_json").option("urls", "\n".join(f"{base}/{x}" for x in "abcd")).load()
        defaults = spark.createDataFrame([(x,) for x in "abcde"], "dataset_id string").withColumn("document", reports.default_dataset())
        found = {r["dataset_id"]: r for r in reports.overlaid(defaults, fetched, urls, "dataset", "dataset_id").collect()}
    finally:
        server.shutdown()
    assert {x for x, r in found.items() if r["is_live"]} == {"a"}
    assert found["a"]["document"]["summary"]["percent"] == 88 and found["a"]["document"]["file"]["name"] == "live"
    assert all(found[x]["document"]["file"]["name"] == "default" and found[x]["document"]["summary"]["percent"] == 0 for x in "bcde")


def test_tampering_counts_as_manipulation(spark):
    from trustloom.operators import provenance

    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + timedelta(days=3 * i), i, "view" if i % 2 else "buy", 1.0, f"p{i}") for i in range(40)], EVENTS)
    recorded = events.select("event_id", F.sha2(F.when(F.col("event_id") == 1, "other").otherwise(F.col("props")), 256).alias("digest"))
    model = spark.createDataFrame([("m",)], "model_sha256 string")
    levels = {r["event_type"]: r["level"] for r in provenance.checked(events, recorded, model).select("event_type", "level").distinct().collect()}
    assert levels == {"view": "critical", "buy": "low"}


def test_live_replays_hold_many_nonces_in_a_bucket(spark, tmp_path):
    r, start = random.Random(9), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=60 * i), r.randrange(40), "view", 1.0, r.choice("abc")) for i in range(3000)]
    folder = str(tmp_path / "in")
    for at in (0, 1000, 2000):
        spark.createDataFrame(rows[at : at + 1000], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    with live.rocksdb(spark):
        got = streams.run_to_table(live.live_replays(stream, hours=1, buckets=2), "stream-buckets", "append").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, replays(spark.createDataFrame(rows, EVENTS), hours=1).collect()))
    assert len(got) > 500
