"""One query per operator, with the SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.functions import columns as C
from trustloom.operators import anomalies, assess, drift, ledger, provenance, quality
from trustloom.plans import reports
from trustloom.sources.documents import read_documents, write_documents
from trustloom.sources.storage import materialise, shared_folder
from trustloom.sources.tables import table
from trustloom.streaming import streams

#: Events from here on count as uploaded, those before as reference.
SPLIT = "2024-01-16"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return quality.flagged(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "benchmark"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("is_reference", F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))


def _documents_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents are the reference, the others uploaded."""
    marked = table(spark, d, "labels").select("doc_id", F.lit(True).alias("marked")).distinct()
    return table(spark, d, "documents").join(marked, "doc_id", "left").withColumn("is_reference", F.col("marked").isNotNull())


def dataset_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.dataset_quality(_flags(spark, d))


def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    return quality.dataset_overview(table(spark, d, "documents"))


def suspicious_samples(spark: SparkSession, d: str) -> DataFrame:
    return quality.containing(table(spark, d, "documents"), table(spark, d, "benchmark"))


def quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_rollup(_flags(spark, d))


def contributor_risk(spark: SparkSession, d: str) -> DataFrame:
    return quality.group_risk(_flags(spark, d), "source")


def training_source_risk(spark: SparkSession, d: str) -> DataFrame:
    return quality.group_risk(_flags(spark, d), "lang")


def class_drift(spark: SparkSession, d: str) -> DataFrame:
    return drift.category_drift(_events(spark, d), "event_type", "is_reference", "class")


def domain_drift(spark: SparkSession, d: str) -> DataFrame:
    return drift.category_drift(_documents_by_label(spark, d), "lang", "is_reference", "domain")


def feature_drift(spark: SparkSession, d: str) -> DataFrame:
    return drift.feature_drift(_events(spark, d), "value", "is_reference")


def prediction_drift(spark: SparkSession, d: str) -> DataFrame:
    """The predicted labels of two time windows: the type of each user's event of greatest value."""
    best = _events(spark, d).groupBy("user_id", "is_reference").agg(F.max(F.struct("value", "event_id", "event_type")).alias("b"))
    return drift.category_drift(best.select("is_reference", F.col("b.event_type").alias("label")), "label", "is_reference", "prediction")


def confidence_drift(spark: SparkSession, d: str) -> DataFrame:
    """The confidences of two time windows."""
    rows = _events(spark, d).withColumn("confidence", C.clamp_pct(F.round("value")).cast("int"))
    return drift.feature_drift(rows, "confidence", "is_reference", "confidence")


def order_value_drift(spark: SparkSession, d: str) -> DataFrame:
    """A numeric feature between two states instead of two windows."""
    return drift.feature_drift(table(spark, d, "orders").withColumn("is_reference", F.col("o_orderstatus") == "F"), "o_totalprice", "is_reference", "order value")


def drift_series(spark: SparkSession, d: str) -> DataFrame:
    return class_drift(spark, d).unionByName(domain_drift(spark, d)).unionByName(feature_drift(spark, d))


def drift_score(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_score(drift_series(spark, d))


def label_flips(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.label_flips(table(spark, d, "embeddings")).select("vec_id", "label", "nearest")


def ood_samples(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.out_of_distribution(table(spark, d, "embeddings")).select("vec_id", "label", "place")


def backdoor_triggers(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.trigger_words(table(spark, d, "documents"), table(spark, d, "labels"))


def anomaly_levels(spark: SparkSession, d: str) -> DataFrame:
    return _anomaly_levels(spark, d, _flags(spark, d), label_flips(spark, d), backdoor_triggers(spark, d))


def _anomaly_levels(spark: SparkSession, d: str, flags: DataFrame, flips: DataFrame, triggers: DataFrame) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    whole = vectors.agg(F.count("*").alias("n"))
    parts = [("Label Flips", flips), ("Out-of-Distribution", anomalies.out_of_distribution(vectors))]
    rates = [df.agg(F.count("*").alias("k")).join(F.broadcast(whole)).select(F.lit(n).alias("name"), (F.col("k") / F.col("n")).alias("rate")) for n, df in parts]
    rates.append(flags.agg(F.avg(F.col("duplicate").cast("double")).alias("rate")).select(F.lit("Duplicates").alias("name"), "rate"))
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    words = words.filter("word != ''").agg(F.countDistinct("word").alias("n"))
    found = triggers.agg(F.count("*").alias("k"))
    rates.append(found.join(F.broadcast(words)).select(F.lit("Backdoor Triggers").alias("name"), F.try_divide("k", "n").alias("rate")))
    return anomalies.levels(reduce(lambda a, b: a.unionByName(b), rates))


def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.evidence(_flags(spark, d))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.evidence_chips(label_flips(spark, d), suspicious_samples(spark, d))


def evidence_chips(spark: SparkSession, d: str) -> DataFrame:
    """The chips of the evidence cards, one row each."""
    return _cards(spark, d).select("rule", "place", "id", F.posexplode("chip").alias("pos", "chip"))


def overview_rows(spark: SparkSession, d: str) -> DataFrame:
    """The overview as label and value."""
    one = dataset_overview(spark, d)
    pairs = (("Total Samples", "samples"), ("Domains", "domains"), ("Contributors", "contributors"), ("Languages", "domain_list"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("label"), F.col(c).cast("string").alias("value")) for i, (k, c) in enumerate(pairs)])))


def inference_provenance(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "events"))


def replay_check(spark: SparkSession, d: str) -> DataFrame:
    return provenance.replays(table(spark, d, "events"))


def _recorded(events: DataFrame) -> DataFrame:
    """Recorded digests are those of events with a value of 1 or more; the others have a record of another text."""
    return events.select("event_id", F.sha2(F.when(F.col("value") >= 1, F.col("props")).otherwise(F.lit("changed")), 256).alias("digest"))


def tamper_check(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return provenance.tampered(events, _recorded(events))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return provenance.checked(events, _recorded(events), anomalies.model_digest(table(spark, d, "embeddings")))


def provenance_rows(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance_rows(_checked(spark, d))


def integrity_rows(spark: SparkSession, d: str) -> DataFrame:
    return provenance.integrity_rows(_checked(spark, d))


def integrity_levels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.integrity(table(spark, d, "events"))


def audit_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.audit_ledger(table(spark, d, "events"))


def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return ledger.audit_chain(table(spark, d, "events"))


def quarantine_view(spark: SparkSession, d: str) -> DataFrame:
    gone = _flags(spark, d).filter("corrupted or suspicious")
    return ledger.without_quarantined(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), gone)


def trust_score(spark: SparkSession, d: str) -> DataFrame:
    return _trust_score(_flags(spark, d))


def _trust_score(flags: DataFrame) -> DataFrame:
    flags = flags.agg(*[(F.avg(F.col(f).cast("double")) * 100).alias(f) for f in assess.WEIGHTS])
    score = flags.select(assess.trust_score({f: F.col(f) for f in assess.WEIGHTS}).alias("score"))
    return score.withColumn("status", C.trust_status(F.col("score"))).withColumn("tone", C.trust_tone(F.col("score")))


def assessed_parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """The assessments of datasets, models and inferences, in no order."""
    return _assessed_parts(spark, d, _flags(spark, d), label_flips(spark, d))


def _assessed_parts(spark: SparkSession, d: str, flags: DataFrame, flips: DataFrame) -> list[DataFrame]:
    events, vectors = table(spark, d, "events"), table(spark, d, "embeddings")
    newest = events.agg(F.max("ts").alias("at"))
    return [
        assess.dataset_scores(flags, newest),
        assess.model_scores(vectors, flips, newest),
        assess.inference_scores(integrity_levels(spark, d), events),
    ]


def _assessed(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    return assess.recent(assessed_parts(spark, d), n)


def assessments(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d)


def recent_assessments(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's five rows, newest first."""
    return _assessed(spark, d, 5)


def model_risks(spark: SparkSession, d: str) -> DataFrame:
    return _model_risks(spark, d, backdoor_triggers(spark, d))


def _model_risks(spark: SparkSession, d: str, triggers: DataFrame) -> DataFrame:
    moved = drift.drift_score(prediction_drift(spark, d).unionByName(confidence_drift(spark, d)))
    return assess.risks(triggers, moved)


def kpis(spark: SparkSession, d: str) -> DataFrame:
    return assess.kpis(assessments(spark, d))


def search(spark: SparkSession, d: str) -> DataFrame:
    return ledger.search(assessments(spark, d), "Src1")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event of greatest value, with a confidence clamped to a percentage, and its time."""
    best = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("value", "event_id", "event_type", "ts")).alias("b"))
    shown = C.shown_timestamp(F.col("b.ts")).alias("timestamp")
    return best.select("user_id", F.col("b.event_type").alias("label"), C.clamp_pct(F.round("b.value")).cast("int").alias("confidence"), shown)


def column_functions(spark: SparkSession, d: str) -> DataFrame:
    """Each column function once, over customers."""
    tabs = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("name")) for k, v in (("BUILDING", "Feature"), ("MACHINERY", "Class"))])
    level = C.risk_level(F.col("c_acctbal") / 10000, 0.3, 0.6, 0.9)
    live = F.when(F.col("c_acctbal") > 5000, F.struct(F.col("c_name").alias("name")))
    return table(spark, d, "customer").select(
        "c_custkey",
        level.alias("level"),
        C.risk_tone(level).alias("tone"),
        C.audit_tone(F.initcap("c_mktsegment")).alias("audit_tone"),
        F.round(C.clamp_pct(F.col("c_acctbal") / 100), 6).alias("clamped"),
        C.cycle_pick(F.array(*map(F.lit, ("box", "tag", "users", "file"))), F.col("c_custkey")).alias("icon"),
        C.find_or_first(tabs, "id", F.col("c_mktsegment"))["name"].alias("tab"),
        C.live_or_default(live, F.struct(F.lit("default").alias("name")))["name"].alias("shown"),
        C.live_status(live, F.lit("Processed")).alias("status"),
        F.upper("c_mktsegment").alias("heading"),
        C.access_caption(F.when(F.col("c_acctbal") > 0, "white")).alias("caption"),
    )


def provenance_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One inference by its id; the filter reaches the scan."""
    return provenance.provenance(table(spark, d, "events").filter(F.col("event_id") == 1))


def drift_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """The series that the selector shows."""
    return drift_series(spark, d).filter(F.col("drift_kind") == "feature").select("pos", "label", "reference", "uploaded")


class Findings(NamedTuple):
    """What several documents are made from, written once so that no plan and no document makes it anew."""

    flags: DataFrame
    flips: DataFrame
    triggers: DataFrame


def findings(spark: SparkSession, d: str) -> Findings:
    made = {"flags": _flags(spark, d), "flips": label_flips(spark, d), "triggers": backdoor_triggers(spark, d)}
    return Findings(**{name: materialise(df, f"findings-{name}") for name, df in made.items()})


def report_document(spark: SparkSession, d: str) -> DataFrame:
    """The dataset document as JSON. Findings and each part are made once and written, so that no plan holds them all."""
    return report_of(spark, d, findings(spark, d))


def report_of(spark: SparkSession, d: str, found: Findings) -> DataFrame:
    flags, flips = found.flags, found.flips
    hits = flags.filter("suspicious").select("doc_id")
    parts = {
        "overview": dataset_overview(spark, d), "quality": quality.dataset_quality(flags), "drift": drift_series(spark, d), "contributors": quality.group_risk(flags, "source"),
        "levels": _anomaly_levels(spark, d, flags, flips, found.triggers), "evidence": anomalies.evidence_chips(flips, hits), "score": _trust_score(flags),
    }
    done = reports.dataset_document(**{name: materialise(part, f"report-{name}") for name, part in parts.items()}, dataset_id="documents")
    return _json(done, "dataset_id")


def _json(documents: DataFrame, *keys: str) -> DataFrame:
    return documents.select(*keys, C.json_text(F.col("document")).alias("document"))


def dashboard_document(spark: SparkSession, d: str) -> DataFrame:
    return _dashboard(assessed_parts(spark, d))


def dashboard_of(spark: SparkSession, d: str, found: Findings) -> DataFrame:
    return _dashboard(_assessed_parts(spark, d, found.flags, found.flips))


def _dashboard(parts: list[DataFrame]) -> DataFrame:
    whole = materialise(reduce(DataFrame.unionByName, parts).drop("at"), "dashboard-assessments")  # in no order: only the recent ones need one
    order = Window.orderBy(F.to_date("date", C.DATE_FORMAT).desc(), F.asc_nulls_last("name"))
    recent = whole.orderBy(F.to_date("date", C.DATE_FORMAT).desc(), F.asc_nulls_last("name")).limit(5).withColumn("place", F.row_number().over(order))  # five rows
    return _json(reports.dashboard_document(assess.kpis(whole), recent))


def audit_document(spark: SparkSession, d: str) -> DataFrame:
    return _json(reports.audit_document(audit_ledger(spark, d)))


def inference_document(spark: SparkSession, d: str) -> DataFrame:
    """The document of one inference, by its id; the checks of its kind are those of all events."""
    one = _checked(spark, d).filter("event_id = 1")
    return _json(reports.inference_documents(one, provenance.provenance_rows(one), provenance.integrity_rows(one)), "event_id")


def model_document(spark: SparkSession, d: str) -> DataFrame:
    return _model_document(spark, d, training_source_risk(spark, d), label_flips(spark, d), backdoor_triggers(spark, d))


def model_of(spark: SparkSession, d: str, found: Findings) -> DataFrame:
    return _model_document(spark, d, quality.group_risk(found.flags, "lang"), found.flips, found.triggers)


def _model_document(spark: SparkSession, d: str, training: DataFrame, flips: DataFrame, triggers: DataFrame) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    overview = vectors.agg(F.countDistinct("label").alias("classes"), F.max(F.size("embedding")).alias("dimensions"), F.count("*").alias("vectors"))
    newest = table(spark, d, "events").agg(F.max("ts").alias("at"))
    models = assess.model_scores(vectors, flips, newest)
    parts = {"overview": overview, "risks": _model_risks(spark, d, triggers), "training": training.select(F.col("lang").alias("name"), "level"), "models": models}
    return _json(reports.model_document(**{name: materialise(part, f"model-{name}") for name, part in parts.items()}))


def report_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Whole reports looked up by dataset id; an id without one gets the whole default document."""
    docs = table(spark, d, "documents")
    live = reports.contributor_documents(docs, _flags(spark, d), drift_series(spark, d), assess.WEIGHTS)
    asked = docs.select(F.concat(F.lit("dataset-"), "source").alias("dataset_id")).distinct()
    asked = asked.unionByName(spark.createDataFrame([("00000000-0000-0000-0000-000000000001",)], "dataset_id string"))
    asked = asked.withColumn("document", reports.default_dataset())
    found = reports.with_live(asked, live, "dataset_id")
    return found.select("dataset_id", C.json_text(F.col("document")).alias("document"), "status", "is_live")


def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """The audit document written as a JSON file, read again by its schema, and its entries as rows."""
    path = f"{shared_folder(spark)}/audit-document-{uuid.uuid4().hex}"
    write_documents(reports.audit_document(audit_ledger(spark, d)).select("document.*"), path)
    return read_documents(spark, path, "audit").select(F.posexplode("entries").alias("pos", "e")).select("pos", "e.*")


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_to_table(streams.windowed_counts(streams.event_stream(spark, d), late=None), "stream-counts", "complete")


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """First uses of each nonce: user_id, event_type, props of all that is not a replay."""
    kept = streams.first_uses(streams.event_stream(spark, d), late=None).select("user_id", "event_type", "props")
    return streams.run_to_table(kept, "stream-replay", "append")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    landed = streams.event_stream(spark, d).select("event_id", "event_type", F.sha2("props", 256).alias("digest"))
    return streams.run_to_table(landed, "stream-ingest", "append")


QUERIES = {
    f.__name__: f
    for f in (
        dataset_quality, dataset_overview, suspicious_samples, quality_rollup, contributor_risk, training_source_risk, class_drift,
        domain_drift, feature_drift, prediction_drift, confidence_drift, order_value_drift, drift_score, label_flips, ood_samples, backdoor_triggers, anomaly_levels,
        evidence_topk, evidence_chips, overview_rows, inference_provenance, provenance_rows, integrity_rows, model_risks, replay_check, tamper_check, integrity_levels, audit_ledger, audit_chain, quarantine_view,
        trust_score, assessments, recent_assessments, kpis, search, predictions, column_functions, provenance_by_id, drift_by_kind, report_document,
        dashboard_document, audit_document, inference_document, model_document, report_by_id, json_documents, stream_event_counts, stream_replay,
        stream_ingest,
    )
}
