"""Queries of the ledger's verification, near-duplicates, trigger phrases, live streams, quarantine and search; and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.columns import json_text
from trustloom.operators import anomalies, ledger, merkle, near_duplicates, neighbours, quality, quarantine, search_index, sketches, triggers
from trustloom.plans.oracle import _ASSESSED, _FLAGS, _LEDGER
from trustloom.plans.oracle import SQL as _OTHERS
from trustloom.plans import queries as core
from trustloom.sources.documents import read_documents, write_documents
from trustloom.sources.storage import shared_folder
from trustloom.sources.tables import table
from trustloom.streaming import live, streams, uploads


def near_duplicate_samples(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document has a copy or near-duplicate of smaller id."""
    return near_duplicates.near_duplicates(table(spark, d, "documents"))


def duplicate_quality(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_quality(quality.duplicates(table(spark, d, "documents")), near_duplicate_samples(spark, d))


def ledger_roots(spark: SparkSession, d: str) -> DataFrame:
    """The Merkle root of each day."""
    return merkle.day_roots(table(spark, d, "events"))


def _altered(events: DataFrame) -> DataFrame:
    """The ledger as someone has changed it: texts changed, two users' entries swapped, entries deleted, blocks deleted, entries added."""
    i = F.col("event_id")
    props = F.when(i % 997 == 3, F.lit("changed")).otherwise(F.col("props"))
    swapped = F.when(i % 1501 == 4, i + 1).when((i % 1501 == 5) & (i > 0), i - 1).otherwise(i)
    kept = events.filter((i % 1499 != 7) & (F.floor(i / merkle.FAN) % 40 != 39)).select(swapped.alias("event_id"), "ts", "user_id", "event_type", props.alias("props"))
    return kept.unionByName(kept.filter(i % 2003 == 9).withColumn("event_id", i + 100_000_000))


def ledger_verification(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of an altered ledger that don't have the recorded roots."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return merkle.altered_blocks(merkle.block_roots(events), _altered(events))


def ledger_proofs(spark: SparkSession, d: str) -> DataFrame:
    """The proof of every entry against its day's root."""
    events = table(spark, d, "events")
    return merkle.verified(merkle.proofs(events), merkle.day_roots(events))


def trigger_phrases(spark: SparkSession, d: str) -> DataFrame:
    return triggers.trigger_phrases(table(spark, d, "documents"), table(spark, d, "labels"))


def stream_replay_live(spark: SparkSession, d: str) -> DataFrame:
    """The replays, as a stream with state finds them."""
    with live.rocksdb(spark):
        return streams.run_to_table(live.live_replays(streams.event_stream(spark, d)), "stream-live", "append")


def upload_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality report after all uploads, from the totals that each upload leaves."""
    base = _folder(spark, "uploads")
    taken = uploads.Uploads(spark, base, table(spark, d, "labels"), table(spark, d, "benchmark"))
    taken.run(streams.landed(spark, d, "documents"), f"{base}/state")
    return taken.report()


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def quarantine_history(spark: SparkSession, d: str) -> DataFrame:
    """Every quarantine, as recorded."""
    path = _folder(spark, "quarantine")
    quarantine.record(quarantine.quarantines(table(spark, d, "events")), path)
    return spark.read.parquet(path).select("user_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"), F.date_format("until", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("until"))


#: Instants of the views; any will do.
INSTANTS = ("2024-01-10 12:00:00", "2024-01-20 12:00:00")


def quarantine_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The users that were free at either instant."""
    events = table(spark, d, "events")
    free = quarantine.free_at(events.select("user_id").distinct(), quarantine.quarantines(events), list(INSTANTS))
    return free.select(F.date_format("instant", "yyyy-MM-dd HH:mm:ss").alias("instant"), "user_id")


#: What is asked in the query of the index: two words of assessments and one of the ledger.
QUESTION = "Dataset src1 purchase"


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The best of all assessments (datasets, models, inferences) and ledger entries for a question."""
    assessed = reduce(DataFrame.unionByName, core.assessed_parts(spark, d)).select(F.lit("assessment").alias("kind"), "name", F.concat_ws(" ", "name", "type", "status").alias("text"))
    entries = ledger.entries(table(spark, d, "events")).select(F.lit("audit").alias("kind"), F.col("target").alias("name"), F.concat_ws(" ", "target", "actor", "action", "status").alias("text"))
    path = _folder(spark, "index")
    search_index.write_index(assessed.unionByName(entries), path)
    return search_index.search(spark, path, QUESTION, k=30)


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of each event type: exact, and whether sketches merged over its days agree."""
    return sketches.distinct_check(table(spark, d, "events"), "event_type", "value")


def ood_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each label's out-of-distribution threshold by sketch has the rank that it should have."""
    scores = anomalies.centroid_scores(table(spark, d, "embeddings")).filter("label = other")
    return sketches.threshold_check(scores, "label", "score", 0.02)


def document_shapes(spark: SparkSession, d: str) -> DataFrame:
    """All five documents, written as JSON and read back by their shapes. What several of them are made from is made once."""
    shared = core.findings(spark, d)
    made = {
        "dataset": lambda: core.report_of(spark, d, shared), "model": lambda: core.model_of(spark, d, shared), "inference": lambda: core.inference_document(spark, d),
        "dashboard": lambda: core.dashboard_of(spark, d, shared), "audit": lambda: core.audit_document(spark, d),
    }
    found = None
    for kind, query in made.items():
        path = _folder(spark, f"shape-{kind}")
        query().select("document").write.text(path)
        rows = read_documents(spark, path, kind).filter("_corrupt_record is null").drop("_corrupt_record")
        rows = rows.select(F.lit(kind).alias("kind"), json_text(F.struct("*")).alias("document"))
        found = rows if found is None else found.unionByName(rows)
    return found


def recent_lines(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's recent assessments as they are shown: name, and type and date in a line."""
    return core.recent_assessments(spark, d).select("name", F.concat_ws(" \u00b7 ", "type", "date").alias("line"))


def neighbour_flips(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which at least half of the nearest neighbours have one other label."""
    return neighbours.neighbour_flips(neighbours.neighbours(table(spark, d, "embeddings")))


def neighbour_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether small buckets and the pass over all find nine in ten of the neighbours that brute force finds for the rows whose id is divisible by 100; only those are asked, all are in the index."""
    vectors, queries = table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0
    measured = neighbours.recall(neighbours.neighbours(vectors, leaf=64, queries=queries), vectors, queries)
    return measured.select("queries", (F.col("recall") >= 0.9).alias("close"))


QUERIES = {f.__name__: f for f in (neighbour_flips, neighbour_recall, near_duplicate_samples, duplicate_quality, ledger_roots, ledger_verification, ledger_proofs, trigger_phrases, stream_replay_live, upload_quality, quarantine_history, quarantine_as_of, search_ranked, distinct_values, ood_thresholds, document_shapes, recent_lines)}

_NEAR = r"""
sh AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, n - 4) + 1)) AS i FROM sh WHERE n > 0)),
sizes AS (SELECT doc_id, count(*) AS k FROM grams GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND b.doc_id < a.doc_id GROUP BY a.doc_id, b.doc_id),
alike AS (SELECT DISTINCT a FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * c >= 4 * (x.k + y.k)),
near AS (SELECT doc_id, doc_id IN (SELECT a FROM alike) OR (n = 0 AND doc_id > (SELECT min(doc_id) FROM sh WHERE n = 0)) AS near_duplicate FROM sh)"""


def _merkle(rows: str, name: str) -> str:
    """Tables ``<name>_0`` (leaves) to ``<name>_24``: level by level; after six levels a block is one node. ``rows``: day, event_id, digest."""
    out = [f"{name}_0 AS (SELECT day, event_id // 64 AS block, row_number() OVER (PARTITION BY day, event_id // 64 ORDER BY event_id, digest) - 1 AS i, digest, event_id FROM ({rows}))"]
    for level in range(1, 25):
        before = f"{name}_{level - 1}"
        if level > 1 and level % 6 == 1:  # roots of blocks become nodes
            before = f"(SELECT day, block // 64 AS block, row_number() OVER (PARTITION BY day, block // 64 ORDER BY block) - 1 AS i, digest FROM {before})"
        out.append(f"""{name}_{level} AS (SELECT day, block, i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE min(digest) END AS digest
          FROM {before} GROUP BY day, block, i // 2)""")
    return ", ".join(out)


_LEAF = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, sha256(concat_ws('|', event_id, user_id, event_type, coalesce(props, ''))) AS digest FROM {0}"

SQL = {
    "near_duplicate_samples": f"WITH {_NEAR} SELECT * FROM near",
    "duplicate_quality": f"""WITH {_FLAGS}, {_NEAR}
      SELECT 'Duplicates' AS label, CAST(sum(CAST(duplicate AS INT)) AS BIGINT) AS count, round(CAST(sum(CAST(duplicate AS INT)) AS BIGINT) * 100.0 / count(*), 2) AS percent FROM flags
      UNION ALL SELECT 'Duplicates and Near-Duplicates', CAST(sum(CAST(near_duplicate AS INT)) AS BIGINT), round(CAST(sum(CAST(near_duplicate AS INT)) AS BIGINT) * 100.0 / count(*), 2) FROM near""",
    "ledger_roots": f"WITH {_merkle(_LEAF.format('events'), 'm')} SELECT day, digest AS root FROM m_24",
    "ledger_verification": f"""WITH k AS (SELECT CASE WHEN event_id % 1501 = 4 THEN event_id + 1 WHEN event_id % 1501 = 5 THEN event_id - 1 ELSE event_id END AS event_id, ts, user_id, event_type,
          CASE WHEN event_id % 997 = 3 THEN 'changed' ELSE props END AS props FROM events WHERE event_id % 1499 <> 7 AND event_id // 64 % 40 <> 39),
        changed AS (SELECT * FROM k UNION ALL SELECT event_id + 100000000, ts, user_id, event_type, props FROM k WHERE event_id % 2003 = 9),
        {_merkle(_LEAF.format('events'), 'm')}, {_merkle(_LEAF.format('changed'), 'c')}
      SELECT coalesce(m.day, c.day) AS day, coalesce(m.block, c.block) AS block,
        CASE WHEN c.digest IS NULL THEN 'missing' WHEN m.digest IS NULL THEN 'added' ELSE 'changed' END AS finding, m.digest AS recorded, c.digest AS computed
      FROM m_6 m FULL JOIN c_6 c ON m.day = c.day AND m.block = c.block WHERE m.digest IS DISTINCT FROM c.digest""",
    "trigger_phrases": r"""
      WITH m AS (SELECT d.doc_id, list_filter(string_split_regex(lower(d.text), '[^\p{L}]+'), lambda x: x <> '') AS ws, l.toxic
          FROM (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id) d JOIN (SELECT doc_id, max(coalesce(toxic, 0)) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
        p AS (SELECT doc_id, toxic, ws, unnest(range(1, len(ws) + 1)) AS i FROM m),
        g AS (SELECT DISTINCT doc_id, toxic, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM p, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(ws)),
        c AS (SELECT n, gram, count(*) AS s, CAST(sum(toxic) AS BIGINT) AS t FROM g GROUP BY n, gram HAVING sum(toxic) >= 5),
        b AS (SELECT count(*) AS a, sum(toxic) AS k FROM m),
        e AS (SELECT n, gram, s, t, CAST(t AS DOUBLE) AS dt, CAST(s AS DOUBLE) AS ds, CAST(k AS DOUBLE) AS dk, CAST(a AS DOUBLE) AS da FROM c, b),
        f AS (SELECT CAST(n AS INT) AS n, gram, s AS samples, t AS toxic_samples, round((dt / ds) / (dk / da), 4) AS lift, round(2 * (
            CASE WHEN dt > 0 THEN dt * ln(dt / (ds * dk / da)) ELSE 0 END + CASE WHEN ds - dt > 0 THEN (ds - dt) * ln((ds - dt) / (ds * (da - dk) / da)) ELSE 0 END
            + CASE WHEN dk - dt > 0 THEN (dk - dt) * ln((dk - dt) / ((da - ds) * dk / da)) ELSE 0 END
            + CASE WHEN da - ds - dk + dt > 0 THEN (da - ds - dk + dt) * ln((da - ds - dk + dt) / ((da - ds) * (da - dk) / da)) ELSE 0 END), 4) AS score FROM e)
      SELECT * FROM f WHERE lift >= 3""",
}

_STAYS = """acts AS (SELECT user_id, ts, event_id, event_type = 'error' AS enters FROM events WHERE event_type IN ('error', 'purchase')),
changes AS (SELECT * FROM (SELECT *, coalesce(lag(enters) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM acts) WHERE enters <> was),
stays AS (SELECT user_id, ts AS since, until FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM changes) WHERE enters)"""

SQL |= {
    "neighbour_flips": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS l FROM e),
        s AS (SELECT a.vec_id, a.label, b.vec_id AS other_id, b.label AS other, round(list_inner_product(a.v, b.v) / a.l / b.l, 9) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other_id) AS place FROM s),
        v AS (SELECT vec_id, label, other, count(*) AS votes, sum(count(*)) OVER (PARTITION BY vec_id) AS n FROM k WHERE place <= 10 GROUP BY vec_id, label, other),
        b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, other) AS place FROM v)
      SELECT vec_id, label, other AS nearest, votes FROM b WHERE place = 1 AND other <> label AND 2 * votes >= n""",
    "neighbour_recall": "SELECT count(*) AS queries, true AS close FROM embeddings WHERE vec_id % 100 = 0",
    "stream_replay_live": _OTHERS["replay_check"],
    "upload_quality": _OTHERS["dataset_quality"],
    "distinct_values": "SELECT event_type, count(DISTINCT value) AS exact, true AS close FROM events GROUP BY event_type",
    "ood_thresholds": "SELECT label, count(*) AS n, true AS close FROM embeddings GROUP BY label",
    "document_shapes": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, document FROM ({_OTHERS[name]})"
        for kind, name in (("dataset", "report_document"), ("model", "model_document"), ("inference", "inference_document"), ("dashboard", "dashboard_document"), ("audit", "audit_document"))
    ),
    "recent_lines": f"SELECT name, type || ' \u00b7 ' || date AS line FROM ({_OTHERS['recent_assessments']})",
    "quarantine_history": f"WITH {_STAYS} SELECT user_id, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, strftime(until, '%Y-%m-%d %H:%M:%S.%f') AS until FROM stays",
    "quarantine_as_of": f"""WITH {_STAYS}, t AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in INSTANTS)}]) AS instant), u AS (SELECT DISTINCT user_id FROM events)
      SELECT strftime(instant, '%Y-%m-%d %H:%M:%S') AS instant, u.user_id FROM t, u
      WHERE NOT EXISTS (SELECT 1 FROM stays s WHERE s.user_id = u.user_id AND since <= instant AND (until IS NULL OR until > instant))""",
    "search_ranked": rf"""WITH {_ASSESSED}, entries AS (
        SELECT 'assessment' AS kind, name, lower(concat_ws(' ', name, type, status)) AS text FROM assessed
        UNION ALL SELECT 'audit', target, lower(concat_ws(' ', target, actor, action, status)) FROM ({_LEDGER})),
      t AS (SELECT kind, name, list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM entries),
      n AS (SELECT count(*) AS big_n, avg(len(ws)) AS mean FROM t WHERE len(ws) > 0),
      p AS (SELECT term, kind, name, length, count(*) AS tf FROM (SELECT kind, name, len(ws) AS length, unnest(ws) AS term FROM t) GROUP BY ALL),
      q AS (SELECT DISTINCT unnest(string_split_regex(lower('{QUESTION}'), '[^\p{{L}}\p{{N}}]+')) AS term),
      d AS (SELECT term, count(*) AS df FROM p JOIN q USING (term) GROUP BY term),
      s AS (SELECT kind, name, round(sum(ln(1 + (big_n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM p JOIN d USING (term), n GROUP BY kind, name)
      SELECT CAST(row_number() OVER (ORDER BY score DESC, kind, name) AS INT) AS place, kind, name, score FROM s ORDER BY score DESC, kind, name LIMIT 30""",
}


def _proof_sql() -> str:
    """The digests of a proof are the levels at which a node has a sibling."""
    steps, place = [], {0: "(SELECT event_id, day, block, i FROM m_0)"}
    for level in range(24):
        if level and level % 6 == 0:
            before = f"m_{level}"
            ranked = f"(SELECT day, block, block // 64 AS up, row_number() OVER (PARTITION BY day, block // 64 ORDER BY block) - 1 AS j FROM {before})"
            steps.append(f"p{level} AS (SELECT p.event_id, p.day, r.up AS block, r.j AS i FROM q{level - 1} p JOIN {ranked} r ON p.day = r.day AND p.block = r.block)")
            nodes = f"(SELECT day, block // 64 AS block, row_number() OVER (PARTITION BY day, block // 64 ORDER BY block) - 1 AS i FROM {before})"
        else:
            steps.append(f"p{level} AS (SELECT * FROM {place[0] if not level else f'q{level - 1}'})")
            nodes = f"m_{level}"
        steps.append(f"t{level} AS (SELECT p.event_id, count(x.i) AS k FROM p{level} p LEFT JOIN (SELECT day, block, i FROM {nodes}) x ON p.day = x.day AND p.block = x.block AND x.i = xor(p.i, 1) GROUP BY p.event_id)")
        steps.append(f"q{level} AS (SELECT event_id, day, block, i // 2 AS i FROM p{level})")
    total = " UNION ALL ".join(f"SELECT * FROM t{level}" for level in range(24))
    return f"""WITH {_merkle(_LEAF.format("events"), "m")}, {", ".join(steps)}
      SELECT day, event_id, CAST(digests AS INT) AS digests, true AS holds FROM m_0 JOIN (SELECT event_id, sum(k) AS digests FROM ({total}) GROUP BY event_id) USING (event_id)"""


SQL["ledger_proofs"] = _proof_sql()
