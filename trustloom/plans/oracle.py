"""The queries in SQL, for comparison on the same tables."""

from __future__ import annotations

from trustloom.plans.queries import SPLIT

_FLAGS = r"""
flags AS (
  SELECT d.doc_id, d.source, d.lang,
         d.doc_id <> min(d.doc_id) OVER (PARTITION BY d.text) AS duplicate,
         coalesce(length(regexp_replace(d.text, '[^\p{L}]', '', 'g')) * 1.0 / length(d.text) < 0.6, true) AS corrupted,
         NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS unlabelled,
         EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) AS suspicious
  FROM documents d)"""

_LEVEL = "CASE WHEN {0} >= {3} THEN 'critical' WHEN {0} >= {2} THEN 'high' WHEN {0} >= {1} THEN 'medium' ELSE 'low' END"
_TONE = "CASE {0} WHEN 'low' THEN 'green' WHEN 'medium' THEN 'amber' ELSE 'red' END"
_STATUS = "CASE WHEN score < 60 THEN 'Quarantined' WHEN score < 75 THEN 'Needs Review' ELSE 'Trusted' END AS status"
_STATUS_TONE = "CASE WHEN score < 60 THEN 'red' WHEN score < 75 THEN 'amber' ELSE 'green' END AS tone"


def _risk(key: str) -> str:
    level = _LEVEL.format("rate", 0.12, 0.2, 0.4)
    return f"""WITH {_FLAGS}, g AS (
      SELECT {key}, count(*) AS samples, CAST(sum(CAST(duplicate OR corrupted OR suspicious AS INT)) AS BIGINT) AS defects,
             round(avg(CAST(CAST(duplicate OR corrupted OR suspicious AS INT) AS DOUBLE)), 6) AS rate
      FROM flags GROUP BY {key}), l AS (SELECT *, {level} AS level FROM g)
    SELECT *, {_TONE.format("level")} AS tone FROM l"""


def _category(kind: str, rows: str) -> str:
    return f"""SELECT '{kind}' AS drift_kind, row_number() OVER (ORDER BY label) - 1 AS pos, label,
      round(r * 100.0 / sum(r) OVER (), 6) AS reference, round(u * 100.0 / sum(u) OVER (), 6) AS uploaded
    FROM (SELECT label, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS u FROM ({rows}) GROUP BY label)"""


def _feature(kind: str, rows: str) -> str:
    return f"""SELECT '{kind}' AS drift_kind, bin AS pos, printf('%05.2f', -3.0 + bin * 0.25) AS label,
      round(r * 100.0 / sum(r) OVER (), 6) AS reference, round(u * 100.0 / sum(u) OVER (), 6) AS uploaded
    FROM (SELECT s.bin, count(p.bin) FILTER (is_ref) AS r, count(p.bin) FILTER (NOT is_ref) AS u
          FROM (SELECT unnest(range(25)) AS bin) s LEFT JOIN (
            SELECT is_ref, CAST(floor((round((v - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 9) + 3.125) / 0.25) AS INT) AS bin
            FROM ({rows}) x, (SELECT avg(v) FILTER (is_ref) AS mean, stddev_pop(v) FILTER (is_ref) AS sd FROM ({rows}) y) z) p
          ON s.bin = p.bin GROUP BY s.bin)"""


_CLASS = _category("class", f"SELECT event_type AS label, ts < TIMESTAMP '{SPLIT}' AS is_ref FROM events")
_DOMAIN = _category("domain", "SELECT lang AS label, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS is_ref FROM documents d")
_FEATURE = _feature("feature", f"SELECT value AS v, ts < TIMESTAMP '{SPLIT}' AS is_ref FROM events")

_SCORES = """
comp AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cent AS (SELECT label AS other, i, avg(x) AS m FROM comp GROUP BY label, i),
scores AS (SELECT vec_id, label, other, round(sum(x * m), 9) AS score FROM comp JOIN cent USING (i) GROUP BY vec_id, label, other),
flips AS (SELECT * FROM (SELECT vec_id, label, other AS nearest, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS n FROM scores)
          WHERE n = 1 AND label <> nearest),
ood AS (SELECT vec_id, label, place FROM (
          SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS place, count(*) OVER (PARTITION BY label) AS n
          FROM scores WHERE label = other) WHERE place <= greatest(1, floor(n * 0.02)))"""

_REPLAYS = """replays AS (
  SELECT event_id, user_id, event_type, seconds FROM (
    SELECT *, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id))) / 1000000.0) AS BIGINT) AS seconds
    FROM events) WHERE seconds < 86400)"""

_INTEGRITY = f"""{_REPLAYS}, integ AS (
  SELECT event_type, events, replays, round(replays / events, 6) AS rate, {_LEVEL.format("round(replays / events, 6)", 0.002, 0.01, 0.05)} AS level
  FROM (SELECT e.event_type, count(*) AS events, count(r.event_id) AS replays FROM events e LEFT JOIN replays r USING (event_id) GROUP BY e.event_type))"""

_RATES = ", ".join(f"avg(CAST(CAST({f} AS INT) AS DOUBLE)) * 100 AS {f}" for f in ("duplicate", "corrupted", "suspicious", "unlabelled"))
_SCORE = "CAST(greatest(0, least(100, round(100 - (duplicate * 0.8 + corrupted * 1.2 + suspicious * 2.0 + unlabelled * 0.1)))) AS INT) AS score"
_SHARE_SCORE = "CAST(greatest(0, least(100, round(100 - {0}))) AS INT)"
_MODELS = f"""(SELECT 'model-class-' || label AS name, {_SHARE_SCORE.format("coalesce(k, 0) * 100.0 / n")} AS score
    FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) LEFT JOIN (SELECT label, count(*) AS k FROM flips GROUP BY label) USING (label))"""
_ASSESSED = f"""{_FLAGS}, {_INTEGRITY}, {_SCORES}, newest AS (SELECT max(ts) AS dated FROM events), raw AS (
  SELECT 'dataset-' || source AS name, 'Dataset' AS type, {_SCORE}, (SELECT dated FROM newest) AS dated FROM (SELECT source, {_RATES} FROM flags GROUP BY source)
  UNION ALL SELECT name, 'Model', score, (SELECT dated FROM newest) FROM {_MODELS}
  UNION ALL
  SELECT 'inference-' || event_type, 'Inference', {_SHARE_SCORE.format("rate * 1000")}, dated
  FROM integ JOIN (SELECT event_type, max(ts) AS dated FROM events GROUP BY event_type) USING (event_type)),
assessed AS (SELECT name, type, score, {_STATUS}, {_STATUS_TONE}, strftime(dated, '%-d %b %Y') AS date, CAST(dated AS DATE) AS day FROM raw)"""
_LISTED = "name, type, score, status, tone, date"
_OF = "count(*) FILTER (type = '{0}'{1})"
_NOT = " AND status <> 'Trusted'"
_YES = " AND status = 'Trusted'"
_KPIS = f"""SELECT 0 AS pos, 'Datasets Assessed' AS label, CAST({_OF.format("Dataset", "")} AS VARCHAR) AS value,
    {_OF.format("Dataset", _NOT)} || ' flagged for review' AS sub FROM assessed
  UNION ALL SELECT 1, 'Models Certified', CAST({_OF.format("Model", _YES)} AS VARCHAR), {_OF.format("Model", _NOT)} || ' pending re-check' FROM assessed
  UNION ALL SELECT 2, 'Inference Verifications', CAST({_OF.format("Inference", "")} AS VARCHAR),
    CAST(coalesce(round({_OF.format("Inference", _YES)} * 100.0 / nullif({_OF.format("Inference", "")}, 0)), 0) AS INT) || '% trusted' FROM assessed
  UNION ALL SELECT 3, 'Open Findings', CAST(count(*) FILTER (status <> 'Trusted') AS VARCHAR), count(*) FILTER (status = 'Quarantined') || ' high severity' FROM assessed"""

_BEST = f"""(SELECT event_type AS label, is_ref FROM (
    SELECT *, ts < TIMESTAMP '{SPLIT}' AS is_ref, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '{SPLIT}' ORDER BY value DESC, event_id DESC) AS n
    FROM events) WHERE n = 1)"""
_PREDICTION = _category("prediction", f"SELECT label, is_ref FROM {_BEST}")
_CONFIDENCE = _feature("confidence", f"SELECT CAST(greatest(0, least(100, round(value))) AS INT) AS v, ts < TIMESTAMP '{SPLIT}' AS is_ref FROM events")

_TRIGGERS = r"""triggers AS (
  WITH m AS (SELECT d.doc_id, d.text, coalesce(l.toxic, 0) AS toxic FROM documents d JOIN labels l USING (doc_id)),
    w AS (SELECT DISTINCT doc_id, toxic, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM m)
  SELECT word, count(*) AS samples, CAST(sum(toxic) AS BIGINT) AS toxic_samples,
    round(sum(toxic) / count(*) / (SELECT avg(toxic) FROM m), 4) AS lift
  FROM w WHERE word <> '' GROUP BY word HAVING sum(toxic) >= 5 AND round(sum(toxic) / count(*) / (SELECT avg(toxic) FROM m), 4) >= 3)"""
_TVD = "(SELECT round(sum(abs(uploaded - reference) / 100) / 2, 4) FROM ({0}))"
_RISKS = f"""risks AS (
  SELECT 'Backdoor Detection' AS label, {_LEVEL.format("(SELECT count(*) FROM triggers)", 1, 10, 100)} AS level, 'crosshair' AS icon
  UNION ALL SELECT 'Prediction Drift', {_LEVEL.format(_TVD.format(_PREDICTION), 0.1, 0.2, 0.4)}, 'trend'
  UNION ALL SELECT 'Confidence Drift', {_LEVEL.format(_TVD.format(_CONFIDENCE), 0.1, 0.2, 0.4)}, 'gauge')"""
_LEVELS = f"""rates AS (
    SELECT 'Label Flips' AS name, (SELECT count(*) FROM flips) / (SELECT count(*) FROM embeddings) AS rate
    UNION ALL SELECT 'Out-of-Distribution', (SELECT count(*) FROM ood) / (SELECT count(*) FROM embeddings)
    UNION ALL SELECT 'Duplicates', (SELECT avg(CAST(CAST(duplicate AS INT) AS DOUBLE)) FROM flags)
    UNION ALL SELECT 'Backdoor Triggers', (SELECT count(*) FROM triggers) / (SELECT count(DISTINCT word) FROM (
      SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS word FROM documents) WHERE word <> '')),
  levels AS (SELECT name, round(rate, 6) AS rate, {_LEVEL.format("round(rate, 6)", 0.02, 0.1, 0.5)} AS level FROM rates)"""

_SHOWN = "strftime(ts, '%-d %b %Y, %I:%M %p')"
_CHECKED = f"""{_INTEGRITY}, {_SCORES}, model AS (
  SELECT sha256(string_agg(label || ':' || parts, ';' ORDER BY label)) AS digest FROM (
    SELECT other AS label, string_agg(printf('%.6f', m), ',' ORDER BY i) AS parts FROM cent WHERE other IS NOT NULL GROUP BY other)),
marked AS (
  SELECT e.*, sha256(props)[1:4] || '...' || right(sha256(props), 4) AS input_shown, sha256(event_type)[1:4] || '...' || right(sha256(event_type), 4) AS config_shown,
    (SELECT digest[1:4] || '...' || right(digest, 4) FROM model) AS model_shown, concat_ws('-', user_id, event_type, props) AS nonce, replay_id IS NOT NULL AS replayed,
    sha256(props) IS DISTINCT FROM sha256(CASE WHEN value >= 1 THEN props ELSE 'changed' END) AS altered
  FROM events e LEFT JOIN (SELECT event_id AS replay_id FROM replays) r ON replay_id = e.event_id),
checked AS (SELECT c.*, i.level FROM marked c LEFT JOIN (SELECT kind, {_LEVEL.format("rate", 0.002, 0.01, 0.05)} AS level
  FROM (SELECT event_type AS kind, round(avg(CAST(CAST(replayed OR altered AS INT) AS DOUBLE)), 6) AS rate FROM marked GROUP BY event_type)) i ON kind = c.event_type)"""
_PROVENANCE_ROWS = """(SELECT event_id, 0 AS pos, 'Input SHA256' AS label, input_shown AS value, true AS copyable FROM checked
  UNION ALL SELECT event_id, 1, 'Model Digest', model_shown, true FROM checked
  UNION ALL SELECT event_id, 2, 'Config Hash', config_shown, true FROM checked UNION ALL SELECT event_id, 3, 'Nonce ID', nonce, true FROM checked
  UNION ALL SELECT event_id, 4, 'Replay Check', CASE WHEN replayed THEN 'Failed' ELSE 'Passed' END, false FROM checked)"""
_INTEGRITY_ROWS = """(SELECT event_id, 0 AS pos, 'Image Tampering' AS label, CASE WHEN altered THEN 'Failed' ELSE 'Passed' END AS value FROM checked
  UNION ALL SELECT event_id, 1, 'Manipulation Risk', upper(level[1]) || level[2:] FROM checked
  UNION ALL SELECT event_id, 2, 'Replay Attack', CASE WHEN replayed THEN 'Detected' ELSE 'Not Detected' END FROM checked)"""

_LEDGER_STATUS = "CASE event_type WHEN 'purchase' THEN 'Trusted' WHEN 'signup' THEN 'Verified' WHEN 'view' THEN 'Completed' WHEN 'error' THEN 'Actioned' ELSE 'Recorded' END"

_LEDGER = f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time_key, {_SHOWN} AS timestamp, 'user-' || user_id AS actor, event_type AS action,
    'event-' || event_id AS target, {_LEDGER_STATUS} AS status,
    CASE {_LEDGER_STATUS} WHEN 'Trusted' THEN 'green' WHEN 'Verified' THEN 'green' WHEN 'Actioned' THEN 'sky' ELSE 'slate' END AS tone FROM events"""
_NEWEST = f"(SELECT * FROM ({_LEDGER}) ORDER BY time_key DESC, event_id DESC LIMIT 20)"
_STATUS_OF = "CASE WHEN {0} < 60 THEN 'Quarantined' WHEN {0} < 75 THEN 'Needs Review' ELSE 'Trusted' END"

_DEFECT = "{{'label': '{0}', 'count': format('{{:,}}', CAST({1} AS BIGINT)), 'percent': CAST(round(round({1} * 100.0 / n, 2)) AS INT)}}"
_ANOMALY = "{{'name': '{0}', 'level': " + _LEVEL.format("round({1} / n, 6)", 0.02, 0.1, 0.5) + ", 'icon': 'alert'}}"


def _drift_list(rows: str) -> str:
    return f"(SELECT list({{'label': label, 'reference': reference, 'uploaded': uploaded}} ORDER BY pos) FROM ({rows}))"


SQL = {
    "dataset_quality": f"""WITH {_FLAGS}, s AS (SELECT count(*) AS n,
        sum(CAST(duplicate AS INT)) AS a, sum(CAST(corrupted AS INT)) AS b, sum(CAST(unlabelled AS INT)) AS c, sum(CAST(suspicious AS INT)) AS d FROM flags),
      u AS (SELECT 'Duplicates' AS label, a AS k, n FROM s UNION ALL SELECT 'Corrupted', b, n FROM s
            UNION ALL SELECT 'Missing Labels', c, n FROM s UNION ALL SELECT 'Suspicious', d, n FROM s)
      SELECT label, CAST(k AS BIGINT) AS count, round(CAST(k AS BIGINT) * 100.0 / n, 2) AS percent FROM u""",
    "dataset_overview": """SELECT count(*) AS samples, count(DISTINCT lang) AS domains, count(DISTINCT source) AS contributors,
        string_agg(DISTINCT lang, ', ' ORDER BY lang) AS domain_list FROM documents""",
    "suspicious_samples": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "quality_rollup": f"""WITH {_FLAGS} SELECT source, lang, CAST(grouping(source, lang) AS BIGINT) AS level, count(*) AS samples,
        CAST(sum(CAST(duplicate AS INT)) AS BIGINT) AS duplicates, CAST(sum(CAST(corrupted AS INT)) AS BIGINT) AS corrupted
      FROM flags GROUP BY ROLLUP (source, lang)""",
    "contributor_risk": _risk("source"),
    "training_source_risk": _risk("lang"),
    "class_drift": _CLASS,
    "domain_drift": _DOMAIN,
    "feature_drift": _FEATURE,
    "prediction_drift": _PREDICTION,
    "confidence_drift": _CONFIDENCE,
    "order_value_drift": _feature("order value", "SELECT o_totalprice AS v, o_orderstatus = 'F' AS is_ref FROM orders"),
    "drift_score": f"""WITH d AS ({_CLASS} UNION ALL {_DOMAIN} UNION ALL {_FEATURE}),
      g AS (SELECT *, abs(sum((uploaded - reference) / 100) OVER (PARTITION BY drift_kind ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS gap,
              greatest(reference / 100, 1e-6) AS rf, greatest(uploaded / 100, 1e-6) AS uf FROM d)
      SELECT drift_kind, round(sum(abs(uploaded - reference) / 100) / 2, 4) AS tvd, round(sum((uf - rf) * ln(uf / rf)), 4) AS psi,
        round(max(gap), 4) AS ks FROM g GROUP BY drift_kind""",
    "label_flips": f"WITH {_SCORES} SELECT vec_id, label, nearest FROM flips",
    "ood_samples": f"WITH {_SCORES} SELECT vec_id, label, place FROM ood",
    "backdoor_triggers": f"WITH {_TRIGGERS} SELECT * FROM triggers",
    "anomaly_levels": f"""WITH {_SCORES}, {_FLAGS}, {_TRIGGERS}, {_LEVELS} SELECT *, {_TONE.format("level")} AS tone FROM levels""",
    "evidence_chips": f"""WITH {_SCORES}, c AS (
        SELECT 'label flip' AS rule, CAST(vec_id AS BIGINT) AS id, ['True: ' || label, 'Pred: ' || nearest] AS chip FROM flips
        UNION ALL SELECT DISTINCT 'suspicious', doc_id, ['Suspicious Pattern'] FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
      p AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS place FROM c)
      SELECT rule, place, id, unnest(range(len(chip)))::INT AS pos, unnest(chip) AS chip FROM p WHERE place <= 3""",
    "overview_rows": """WITH o AS (SELECT count(*) AS a, count(DISTINCT lang) AS b, count(DISTINCT source) AS c, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS d FROM documents)
      SELECT 0 AS pos, 'Total Samples' AS label, CAST(a AS VARCHAR) AS value FROM o UNION ALL SELECT 1, 'Domains', CAST(b AS VARCHAR) FROM o
      UNION ALL SELECT 2, 'Contributors', CAST(c AS VARCHAR) FROM o UNION ALL SELECT 3, 'Languages', d FROM o""",
    "provenance_rows": f"WITH {_CHECKED} SELECT * FROM {_PROVENANCE_ROWS}",
    "integrity_rows": f"WITH {_CHECKED} SELECT * FROM {_INTEGRITY_ROWS}",
    "model_risks": f"WITH {_TRIGGERS}, {_RISKS} SELECT * FROM risks",
    "dashboard_document": f"""WITH {_ASSESSED}, k AS ({_KPIS}),
      r AS (SELECT *, row_number() OVER (ORDER BY day DESC, name) AS place FROM assessed)
      SELECT CAST(to_json({{'kpis': (SELECT list({{'label': label, 'value': value, 'sub': sub}} ORDER BY pos) FROM k),
        'recent': (SELECT list({{'name': name, 'type': type, 'score': score, 'status': status, 'tone': tone, 'date': date}} ORDER BY place) FROM r WHERE place <= 5)}}) AS VARCHAR) AS document""",
    "audit_document": f"""SELECT CAST(to_json({{'entries': (SELECT list({{'timestamp': timestamp, 'actor': actor, 'action': action, 'target': target, 'status': status}}
        ORDER BY time_key DESC, event_id DESC) FROM {_NEWEST})}}) AS VARCHAR) AS document""",
    "json_documents": f"""SELECT CAST(row_number() OVER (ORDER BY time_key DESC, event_id DESC) - 1 AS INT) AS pos, timestamp, actor, action, target, status FROM {_NEWEST}""",
    "inference_document": f"""WITH {_CHECKED}, o AS (SELECT *, replayed OR altered AS failed, CASE WHEN replayed OR altered THEN 50 ELSE 100 END AS score FROM checked WHERE event_id = 1)
      SELECT event_id, CAST(to_json({{
        'file': {{'name': 'event-' || event_id, 'meta': '', 'status': CASE WHEN failed THEN 'Failed' ELSE 'Verified' END, 'timestamp': {_SHOWN}, 'scene': CAST(NULL AS VARCHAR)}},
        'prediction': {{'label': event_type, 'confidence': CAST(greatest(0, least(100, round(value))) AS INT), 'timestamp': {_SHOWN}}},
        'provenance': (SELECT list({{'label': label, 'value': value, 'copyable': copyable}} ORDER BY pos) FROM {_PROVENANCE_ROWS} WHERE event_id = 1),
        'integrity': (SELECT list({{'label': label, 'value': value}} ORDER BY pos) FROM {_INTEGRITY_ROWS} WHERE event_id = 1),
        'summary': {{'percent': score, 'label': 'Inference Trust Score', 'status': {_STATUS_OF.format("score")}}}}}) AS VARCHAR) AS document FROM o""",
    "model_document": f"""WITH {_SCORES}, {_TRIGGERS}, {_RISKS}, t AS ({_risk("lang")}),
      e AS (SELECT count(DISTINCT label) AS classes, max(len(embedding)) AS dims, count(*) AS n FROM embeddings),
      m AS (SELECT CAST(round(avg(score)) AS INT) AS score FROM {_MODELS})
      SELECT CAST(to_json({{'file': {{'name': 'embeddings', 'meta': '', 'status': 'Processed', 'timestamp': CAST(NULL AS VARCHAR), 'scene': CAST(NULL AS VARCHAR)}},
        'overview': (SELECT [{{'label': 'Model Type', 'value': 'Nearest centroid'}}, {{'label': 'Classes', 'value': CAST(classes AS VARCHAR)}},
          {{'label': 'Input Size', 'value': CAST(dims AS VARCHAR)}}, {{'label': 'Training Samples', 'value': CAST(n AS VARCHAR)}}] FROM e),
        'risks': (SELECT list({{'label': label, 'level': level, 'icon': icon}} ORDER BY label) FROM risks),
        'trainingRisk': (SELECT list({{'label': lang, 'level': level}} ORDER BY lang) FROM t),
        'summary': {{'percent': score, 'label': 'Model Trust Score', 'status': {_STATUS_OF.format("score")}}}}}) AS VARCHAR) AS document FROM m""",
    "report_by_id": f"""WITH {_FLAGS}, k AS (SELECT unnest(['corrupted', 'duplicate', 'suspicious']) AS rule, unnest(['Corrupted Sample', 'Duplicate Sample', 'Suspicious Pattern']) AS chip),
      shown AS (SELECT source, rule, chip, doc_id, row_number() OVER (PARTITION BY source, rule ORDER BY doc_id) AS place FROM flags, k
        WHERE CASE rule WHEN 'corrupted' THEN corrupted WHEN 'duplicate' THEN duplicate ELSE suspicious END),
      ev AS (SELECT source, list({{'scene': CAST(NULL AS VARCHAR), 'chip': [chip, 'Document ' || doc_id]}} ORDER BY rule, place) AS evidence FROM shown WHERE place <= 3 GROUP BY source),
      g AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, sum(CAST(corrupted AS INT)) AS c, sum(CAST(duplicate AS INT)) AS d, sum(CAST(unlabelled AS INT)) AS u, sum(CAST(suspicious AS INT)) AS s,
          round(avg(CAST(CAST(duplicate OR corrupted OR suspicious AS INT) AS DOUBLE)), 6) AS rate, count(DISTINCT lang) AS domains, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM flags GROUP BY source),
      h AS (SELECT *, CAST(greatest(0, least(100, round(100 - (d * 100.0 / n * 0.8 + c * 100.0 / n * 1.2 + s * 100.0 / n * 2.0 + u * 100.0 / n * 0.1)))) AS INT) AS score FROM g)
      SELECT 'dataset-' || source AS dataset_id, CAST(to_json({{
        'file': {{'name': 'dataset-' || source, 'meta': '', 'status': 'Processed', 'timestamp': CAST(NULL AS VARCHAR), 'scene': CAST(NULL AS VARCHAR)}},
        'overview': [{{'label': 'Total Samples', 'value': format('{{:,}}', CAST(n AS BIGINT))}}, {{'label': 'Domains', 'value': CAST(domains AS VARCHAR)}}, {{'label': 'Contributors', 'value': '1'}}, {{'label': 'Languages', 'value': languages}}],
        'quality': [{_DEFECT.format("Corrupted", "c")}, {_DEFECT.format("Duplicates", "d")}, {_DEFECT.format("Missing Labels", "u")}, {_DEFECT.format("Suspicious", "s")}],
        'featureDrift': {_drift_list(_FEATURE)}, 'classDrift': {_drift_list(_CLASS)}, 'domainDrift': {_drift_list(_DOMAIN)},
        'contributors': [{{'name': source, 'level': {_LEVEL.format("rate", 0.12, 0.2, 0.4)}}}],
        'anomalies': [{_ANOMALY.format("Corrupted", "c")}, {_ANOMALY.format("Duplicates", "d")}, {_ANOMALY.format("Suspicious", "s")}],
        'evidence': coalesce(evidence, []), 'summary': {{'percent': score, 'label': 'Dataset Trust Score', 'status': {_STATUS_OF.format("score")}}}}}) AS VARCHAR) AS document, 'Backend live' AS status, true AS is_live
      FROM h LEFT JOIN ev USING (source)
      UNION ALL SELECT '00000000-0000-0000-0000-000000000001', '{{"file":{{"name":"default","meta":"","status":"Sample","timestamp":null,"scene":null}},"overview":[],"quality":[],"featureDrift":[],"classDrift":[],"domainDrift":[],"contributors":[],"anomalies":[],"evidence":[],"summary":{{"percent":0,"label":"Dataset Trust Score","status":"Needs Review"}}}}', 'Sample', false""",
    "report_document": f"""WITH {_SCORES}, {_FLAGS}, {_TRIGGERS}, {_LEVELS}, g AS ({_risk("source")}), q AS (
        SELECT 'Duplicates' AS label, sum(CAST(duplicate AS INT)) AS k, count(*) AS n FROM flags UNION ALL SELECT 'Corrupted', sum(CAST(corrupted AS INT)), count(*) FROM flags
        UNION ALL SELECT 'Missing Labels', sum(CAST(unlabelled AS INT)), count(*) FROM flags UNION ALL SELECT 'Suspicious', sum(CAST(suspicious AS INT)), count(*) FROM flags),
      cards AS (SELECT 'label flip' AS rule, CAST(vec_id AS BIGINT) AS id, ['True: ' || label, 'Pred: ' || nearest] AS chip FROM flips
        UNION ALL SELECT DISTINCT 'suspicious', doc_id, ['Suspicious Pattern'] FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
      ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS place FROM cards) WHERE place <= 3),
      o AS (SELECT count(*) AS a, count(DISTINCT lang) AS b, count(DISTINCT source) AS c, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS d FROM documents),
      s AS (SELECT {_SCORE} FROM (SELECT {_RATES} FROM flags))
      SELECT 'documents' AS dataset_id, CAST(to_json({{
        'file': {{'name': 'documents', 'meta': '', 'status': 'Processed', 'timestamp': CAST(NULL AS VARCHAR), 'scene': CAST(NULL AS VARCHAR)}},
        'overview': (SELECT [{{'label': 'Total Samples', 'value': format('{{:,}}', a)}}, {{'label': 'Domains', 'value': CAST(b AS VARCHAR)}},
          {{'label': 'Contributors', 'value': CAST(c AS VARCHAR)}}, {{'label': 'Languages', 'value': d}}] FROM o),
        'quality': (SELECT list({{'label': label, 'count': format('{{:,}}', CAST(k AS BIGINT)), 'percent': CAST(round(round(CAST(k AS BIGINT) * 100.0 / n, 2)) AS INT)}} ORDER BY label) FROM q),
        'featureDrift': {_drift_list(_FEATURE)}, 'classDrift': {_drift_list(_CLASS)}, 'domainDrift': {_drift_list(_DOMAIN)},
        'contributors': (SELECT list({{'name': source, 'level': level}} ORDER BY source) FROM g),
        'anomalies': (SELECT list({{'name': name, 'level': level, 'icon': 'alert'}} ORDER BY name) FROM levels),
        'evidence': (SELECT list({{'scene': CAST(NULL AS VARCHAR), 'chip': chip}} ORDER BY rule, place) FROM ev),
        'summary': {{'percent': score, 'label': 'Trust score', 'status': {_STATUS_OF.format("score")}}}}}) AS VARCHAR) AS document FROM s""",
    "evidence_topk": f"""WITH {_FLAGS}, r AS (SELECT doc_id, 'duplicate' AS rule FROM flags WHERE duplicate
        UNION ALL SELECT doc_id, 'corrupted' FROM flags WHERE corrupted UNION ALL SELECT doc_id, 'suspicious' FROM flags WHERE suspicious)
      SELECT * FROM (SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS place, doc_id FROM r) WHERE place <= 3""",
    "inference_provenance": """SELECT event_id, sha256(props) AS input_sha256, sha256(event_type) AS config_sha256,
        concat_ws('-', user_id, event_type, props) AS nonce, sha256(props)[1:4] || '...' || right(sha256(props), 4) AS input_shown FROM events""",
    "replay_check": f"WITH {_REPLAYS} SELECT event_id, user_id, seconds FROM replays",
    "tamper_check": """SELECT event_id, sha256(props) AS computed, sha256(CASE WHEN value >= 1 THEN props ELSE 'changed' END) AS recorded
      FROM events WHERE sha256(props) IS DISTINCT FROM sha256(CASE WHEN value >= 1 THEN props ELSE 'changed' END)""",
    "integrity_levels": f"WITH {_INTEGRITY} SELECT * FROM integ",
    "audit_ledger": f"SELECT * FROM ({_LEDGER})",
    "audit_chain": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_id, event_id // 1000 AS place,
          concat_ws('|', event_id, event_type, coalesce(props, '')) AS entry FROM events),
      b AS (SELECT day, user_id, place, count(*) AS n, list_reduce(list_prepend('', list(entry ORDER BY event_id)), lambda a, x: sha256(a || x)) AS head
        FROM e GROUP BY day, user_id, place)
      SELECT day, user_id, CAST(sum(n) AS BIGINT) AS entries, list_reduce(list_prepend('', list(head ORDER BY place)), lambda a, x: sha256(a || x)) AS head
      FROM b GROUP BY day, user_id""",
    "quarantine_view": f"""WITH {_FLAGS} SELECT d.doc_id, d.source, d.lang, d.n_chars FROM documents d
      WHERE d.doc_id NOT IN (SELECT doc_id FROM flags WHERE corrupted OR suspicious)""",
    "trust_score": f"WITH {_FLAGS}, s AS (SELECT {_SCORE} FROM (SELECT {_RATES} FROM flags)) SELECT score, {_STATUS}, {_STATUS_TONE} FROM s",
    "assessments": f"WITH {_ASSESSED} SELECT {_LISTED} FROM assessed",
    "recent_assessments": f"WITH {_ASSESSED} SELECT {_LISTED} FROM assessed ORDER BY day DESC, name LIMIT 5",
    "kpis": f"WITH {_ASSESSED} {_KPIS}",
    "search": f"WITH {_ASSESSED} SELECT {_LISTED} FROM assessed WHERE contains(lower(name), 'src1')",
    "predictions": f"""SELECT user_id, event_type AS label, CAST(greatest(0, least(100, round(value))) AS INT) AS confidence, {_SHOWN} AS timestamp FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "column_functions": f"""WITH l AS (SELECT *, {_LEVEL.format("c_acctbal / 10000", 0.3, 0.6, 0.9)} AS level FROM customer)
      SELECT c_custkey, level, {_TONE.format("level")} AS tone, 'slate' AS audit_tone, round(greatest(0, least(100, c_acctbal / 100)), 6) AS clamped,
        list_extract(['box', 'tag', 'users', 'file'], CAST(c_custkey % 4 + 1 AS INT)) AS icon,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'Class' ELSE 'Feature' END AS tab,
        CASE WHEN c_acctbal > 5000 THEN c_name ELSE 'default' END AS shown,
        CASE WHEN c_acctbal > 5000 THEN 'Backend live' ELSE 'Processed' END AS status, upper(c_mktsegment) AS heading,
        CASE WHEN c_acctbal > 0 THEN 'Full access to weights and gradients' ELSE 'Query access to outputs only' END AS caption FROM l""",
    "provenance_by_id": """SELECT event_id, sha256(props) AS input_sha256, sha256(event_type) AS config_sha256,
        concat_ws('-', user_id, event_type, props) AS nonce, sha256(props)[1:4] || '...' || right(sha256(props), 4) AS input_shown
      FROM events WHERE event_id = 1""",
    "drift_by_kind": f"SELECT pos, label, reference, uploaded FROM ({_FEATURE})",
    "stream_event_counts": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events,
        round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""",
    "stream_replay": "SELECT DISTINCT user_id, event_type, props FROM events",
    "stream_ingest": "SELECT event_id, event_type, sha256(props) AS digest FROM events",
}
