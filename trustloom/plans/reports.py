"""Documents in the shape that the front end shows, assembled from operator results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.columns import clamp_pct, live_or_default, live_status, risk_level, shown_timestamp, trust_status
from trustloom.sources.documents import SCHEMAS


def _rows(df: DataFrame, order: str, **fields: Column) -> DataFrame:
    """All rows as one array of structs in ``order``, nulls last: report parts of few rows."""
    return _array(df, [F.col(order).isNull(), F.col(order)], **fields)


def dataset_document(overview: DataFrame, quality: DataFrame, drift: DataFrame, contributors: DataFrame, levels: DataFrame, evidence: DataFrame, score: DataFrame, dataset_id: str) -> DataFrame:
    """One row: ``dataset_id`` and the nested document."""
    one = overview.select(
        F.array(
            F.struct(F.lit("Total Samples").alias("label"), F.format_number("samples", 0).alias("value")),
            F.struct(F.lit("Domains").alias("label"), F.col("domains").cast("string").alias("value")),
            F.struct(F.lit("Contributors").alias("label"), F.col("contributors").cast("string").alias("value")),
            F.struct(F.lit("Languages").alias("label"), F.col("domain_list").alias("value")),
        ).alias("overview")
    )
    parts = {
        "quality": _rows(quality, "label", label=F.col("label"), count=F.format_number("count", 0), percent=F.round("percent").cast("int")),
        "contributors": _rows(contributors, "source", name=F.col("source"), level=F.col("level")),
        "anomalies": _rows(levels, "name", name=F.col("name"), level=F.col("level"), icon=F.lit("alert")),
        "evidence": _array(evidence, [F.col("rule"), F.col("place")], scene=F.lit(None).cast("string"), chip=F.col("chip")),
    }
    for kind in ("feature", "class", "domain"):
        part = drift.filter(F.col("drift_kind") == kind)
        parts[f"{kind}Drift"] = _rows(part, "pos", label=F.col("label"), reference=F.col("reference"), uploaded=F.col("uploaded"))
    one = _together(one, parts | {"score": score.select(F.col("score").alias("a"))})
    file = F.struct(F.lit(dataset_id).alias("name"), F.lit("").alias("meta"), F.lit("Processed").alias("status"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("scene"))
    summary = F.struct(F.col("score").cast("int").alias("percent"), F.lit("Trust score").alias("label"), trust_status(F.col("score")).alias("status"))
    names = ["overview", "quality", "featureDrift", "classDrift", "domainDrift", "contributors", "anomalies", "evidence"]
    return one.select(F.lit(dataset_id).alias("dataset_id"), F.struct(file.alias("file"), *names, summary.alias("summary")).alias("document"))


def _array(rows: DataFrame, order: list[Column], **fields: Column) -> DataFrame:
    """All rows of a short list as one array of structs, in this order."""
    item = F.struct(*[c.alias(name) for name, c in fields.items()])
    packed = rows.agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], item.alias("x")))).alias("a"))
    return packed.select(F.transform("a", lambda x: x["x"]).alias("a"))


def _together(first: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Documents of one row each, side by side; by one aggregate, as a broadcast for each part costs the driver a job and a thread."""
    rows = [first, *[part.select(F.col("a").alias(name)) for name, part in parts.items()]]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def dashboard_document(kpis: DataFrame, recent: DataFrame) -> DataFrame:
    """``kpis`` in order of pos; ``recent`` in the order of its rows' ``place``."""
    figures = _array(kpis, [F.col("pos")], label=F.col("label"), value=F.col("value"), sub=F.col("sub"))
    fields = {c: F.col(c) for c in ("name", "type", "score", "status", "tone", "date")}
    rows = _array(recent, [F.col("place")], **fields)
    return _together(figures.withColumnRenamed("a", "kpis"), {"recent": rows}).select(F.struct("kpis", "recent").alias("document"))


def audit_document(ledger: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest entries."""
    newest = ledger.orderBy(F.desc("time_key"), F.desc("event_id")).limit(n)
    fields = {c: F.col(c) for c in ("timestamp", "actor", "action", "target", "status")}
    # sort_array sorts upwards, so the array is turned round
    packed = _array(newest, [F.col("time_key"), F.col("event_id")], **fields)
    return packed.select(F.struct(F.reverse("a").alias("entries")).alias("document"))


def inference_documents(checked: DataFrame, provenance: DataFrame, integrity: DataFrame) -> DataFrame:
    """``event_id`` and document of every inference in ``checked``, with its ``provenance`` and ``integrity`` rows."""
    held = lambda rows, *fields: rows.groupBy("event_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("x")))), lambda r: r["x"]).alias("a")
    )
    rows = checked.join(held(provenance, "label", "value", "copyable").withColumnRenamed("a", "provenance"), "event_id")
    rows = rows.join(held(integrity, "label", "value").withColumnRenamed("a", "integrity"), "event_id")
    shown = shown_timestamp(F.col("ts"))
    failed = F.col("replayed").isNotNull() | F.col("altered").isNotNull()
    score = F.when(failed, 50).otherwise(F.lit(100))
    file = F.struct(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("name"), F.lit("").alias("meta"),
        F.when(failed, "Failed").otherwise("Verified").alias("status"), shown.alias("timestamp"), F.lit(None).cast("string").alias("scene"),
    )
    confidence = clamp_pct(F.round("value")).cast("int")
    prediction = F.struct(F.col("event_type").alias("label"), confidence.alias("confidence"), shown.alias("timestamp"))
    summary = F.struct(score.alias("percent"), F.lit("Inference Trust Score").alias("label"), trust_status(score).alias("status"))
    return rows.select("event_id", F.struct(file.alias("file"), prediction.alias("prediction"), "provenance", "integrity", summary.alias("summary")).alias("document"))


def model_document(overview: DataFrame, risks: DataFrame, training: DataFrame, models: DataFrame) -> DataFrame:
    """``overview``: classes and vectors; ``training``: name and level of each training source; ``models``: assessed classes."""
    facts = overview.select(
        F.array(
            F.struct(F.lit("Model Type").alias("label"), F.lit("Nearest centroid").alias("value")),
            F.struct(F.lit("Classes").alias("label"), F.col("classes").cast("string").alias("value")),
            F.struct(F.lit("Input Size").alias("label"), F.col("dimensions").cast("string").alias("value")),
            F.struct(F.lit("Training Samples").alias("label"), F.col("vectors").cast("string").alias("value")),
        ).alias("overview")
    )
    parts = {
        "risks": _array(risks, [F.col("label")], label=F.col("label"), level=F.col("level"), icon=F.col("icon")),
        "trainingRisk": _rows(training, "name", label=F.col("name"), level=F.col("level")),
        "score": models.agg(F.round(F.avg("score")).cast("int").alias("a")),
    }
    file = F.struct(F.lit("embeddings").alias("name"), F.lit("").alias("meta"), F.lit("Processed").alias("status"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("scene"))
    score = F.col("score")
    summary = F.struct(score.alias("percent"), F.lit("Model Trust Score").alias("label"), trust_status(score).alias("status"))
    return _together(facts, parts).select(F.struct(file.alias("file"), "overview", "risks", "trainingRisk", summary.alias("summary")).alias("document"))


#: What the documents of single contributors show of their flags: the label of the count and of the chip.
_DEFECTS = (("corrupted", "Corrupted", "Corrupted Sample"), ("duplicate", "Duplicates", "Duplicate Sample"), ("unlabelled", "Missing Labels", None), ("suspicious", "Suspicious", "Suspicious Pattern"))


def contributor_documents(docs: DataFrame, flags: DataFrame, drift: DataFrame, weights: dict[str, float], k: int = 3) -> DataFrame:
    """``dataset_id`` and the whole dataset document of every contributor.

    Drift is that of all data; all else is the contributor's own. Evidence are the ``k`` flagged samples of smallest id for each kind.
    """
    own = docs.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("domains"), F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("languages"))
    bad = F.col("duplicate") | F.col("corrupted") | F.col("suspicious")
    rates = flags.groupBy("source").agg(F.round(F.avg(bad.cast("double")), 6).alias("rate"), *[F.sum(F.col(f).cast("bigint")).alias(f) for f, *_ in _DEFECTS])
    place = F.row_number().over(Window.partitionBy("source", "rule").orderBy("doc_id"))
    kinds = F.array(*[F.when(F.col(f), F.struct(F.lit(f).alias("rule"), F.lit(chip).alias("chip"))) for f, _, chip in _DEFECTS if chip])
    shown = flags.select("source", "doc_id", F.inline(F.filter(kinds, lambda x: x.isNotNull()))).withColumn("place", place).filter(F.col("place") <= k)
    item = F.struct("rule", "place", F.struct(F.lit(None).cast("string").alias("scene"), F.array("chip", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("chip")).alias("x"))
    evidence = shown.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(item)), lambda r: r["x"]).alias("evidence"))
    out = own.join(rates, "source").join(evidence, "source", "left")
    for kind in ("feature", "class", "domain"):
        part = _rows(drift.filter(F.col("drift_kind") == kind), "pos", label=F.col("label"), reference=F.col("reference"), uploaded=F.col("uploaded"))
        out = out.join(F.broadcast(part.withColumnRenamed("a", f"{kind}Drift")))  # one row
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    share = lambda f: F.round(F.col(f) * 100.0 / F.col("n"), 2)
    none = F.lit(None).cast("string")
    score = clamp_pct(F.round(100 - sum((F.col(f) * 100.0 / F.col("n") * w for f, w in weights.items()), F.lit(0.0)))).cast("int")
    parts = {
        "file": F.struct(F.concat(F.lit("dataset-"), "source").alias("name"), F.lit("").alias("meta"), F.lit("Processed").alias("status"), none.alias("timestamp"), none.alias("scene")),
        "overview": F.array(pair("Total Samples", F.format_number("n", 0)), pair("Domains", F.col("domains").cast("string")), pair("Contributors", F.lit("1")), pair("Languages", F.col("languages"))),
        "quality": F.array(*[F.struct(F.lit(label).alias("label"), F.format_number(f, 0).alias("count"), F.round(share(f)).cast("int").alias("percent")) for f, label, _ in _DEFECTS]),
        "featureDrift": F.col("featureDrift"), "classDrift": F.col("classDrift"), "domainDrift": F.col("domainDrift"),
        "contributors": F.array(F.struct(F.col("source").alias("name"), risk_level(F.col("rate"), 0.12, 0.2, 0.4).alias("level"))),
        "anomalies": F.array(*[F.struct(F.lit(label).alias("name"), risk_level(F.round(F.col(f) / F.col("n"), 6), 0.02, 0.1, 0.5).alias("level"), F.lit("alert").alias("icon")) for f, label, chip in _DEFECTS if chip]),
        "evidence": F.coalesce("evidence", F.array().cast("array<struct<scene:string,chip:array<string>>>")),
        "summary": F.struct(score.alias("percent"), F.lit("Dataset Trust Score").alias("label"), trust_status(score).alias("status")),
    }
    return out.select(F.concat(F.lit("dataset-"), "source").alias("dataset_id"), F.struct(*[c.alias(name) for name, c in parts.items()]).alias("document"))


#: What is shown for an id without a report.
DEFAULT_DATASET = """{"file": {"name": "default", "meta": "", "status": "Sample"}, "overview": [], "quality": [], "featureDrift": [], "classDrift": [],
  "domainDrift": [], "contributors": [], "anomalies": [], "evidence": [], "summary": {"percent": 0, "label": "Dataset Trust Score", "status": "Needs Review"}}"""


def default_dataset() -> Column:
    return F.from_json(F.lit(DEFAULT_DATASET), SCHEMAS["dataset"])


def overlaid(defaults: DataFrame, fetched: DataFrame, urls: DataFrame, kind: str, key: str) -> DataFrame:
    """Documents fetched by HTTP laid over their defaults, whole or not at all.

    ``defaults``: ``key`` and ``document``; ``urls``: ``key`` and ``url``; ``fetched``: ``url`` and ``body``, as the HTTP source gives them. A request that
    failed, and a body that is no document of this ``kind``, leave the default and its status.
    """
    document = F.from_json("body", SCHEMAS[kind], {"mode": "PERMISSIVE"})
    known = F.get_json_object("body", f"$.{'entries' if kind == 'audit' else 'kpis' if kind == 'dashboard' else 'summary'}").isNotNull()
    live = urls.join(fetched, "url").select(key, F.when(known, document).alias("document")).filter("document is not null")
    joined = defaults.join(live.withColumnRenamed("document", "live"), key, "left")
    return joined.select(key, live_or_default(F.col("live"), F.col("document")).alias("document"), F.col("live").isNotNull().alias("is_live"))


def with_live(defaults: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``key``, ``document`` (the whole live one, else the default), ``status`` and ``is_live``."""
    joined = defaults.join(live.withColumnRenamed("document", "live"), key, "left")
    return joined.select(
        key,
        live_or_default(F.col("live"), F.col("document")).alias("document"),
        live_status(F.col("live"), F.col("document.file.status")).alias("status"),
        F.col("live").isNotNull().alias("is_live"),
    )
