"""Trust scores, the dashboard's list of assessments and its key figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.columns import clamp_pct, lookup, risk_level, shown_date, trust_status, trust_tone

# Our own weights of the defect percentages.
WEIGHTS = {"duplicate": 0.8, "corrupted": 1.2, "suspicious": 2.0, "unlabelled": 0.1}


def trust_score(rates: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """100 less the weighted defect percentages, as a whole number in [0, 100]."""
    penalty = reduce(lambda a, b: a + b, [F.coalesce(rates[k], F.lit(0.0)) * w for k, w in weights.items()])
    return clamp_pct(F.round(100 - penalty)).cast("int")


def assessed(rows: DataFrame) -> DataFrame:
    """Add status, tone and the shown date to name, type, score and at (a timestamp)."""
    score = F.col("score")
    return rows.select("name", "type", "score", trust_status(score).alias("status"), trust_tone(score).alias("tone"), shown_date(F.col("at")).alias("date"), "at")


def _as_of(rows: DataFrame, newest: DataFrame) -> DataFrame:
    """What has no time of its own is dated by the newest event; ``newest`` is one row."""
    return rows.join(F.broadcast(newest))


def dataset_scores(flags: DataFrame, newest: DataFrame) -> DataFrame:
    """One assessment per contributor's dataset."""
    rates = flags.groupBy("source").agg(*[(F.avg(F.col(f).cast("double")) * 100).alias(f) for f in WEIGHTS])
    scored = rates.select(F.concat(F.lit("dataset-"), "source").alias("name"), F.lit("Dataset").alias("type"), trust_score({f: F.col(f) for f in WEIGHTS}).alias("score"))
    return assessed(_as_of(scored, newest))


def model_scores(vectors: DataFrame, flips: DataFrame, newest: DataFrame) -> DataFrame:
    """One assessment per class of the nearest-centroid model: 100 less the percentage of its vectors that lie nearer to another class."""
    counts = vectors.groupBy("label").agg(F.count("*").alias("n"))
    wrong = flips.groupBy("label").agg(F.count("*").alias("k"))
    share = F.coalesce("k", F.lit(0)) * 100.0 / F.col("n")
    rows = counts.join(wrong, "label", "left").select(
        F.concat(F.lit("model-class-"), F.col("label").cast("string")).alias("name"), F.lit("Model").alias("type"), clamp_pct(F.round(100 - share)).cast("int").alias("score")
    )
    return assessed(_as_of(rows, newest))


def inference_scores(integrity: DataFrame, events: DataFrame) -> DataFrame:
    """One assessment per event type, dated by its newest event."""
    score = clamp_pct(F.round(100 - F.col("rate") * 1000)).cast("int")
    rows = integrity.join(events.groupBy("event_type").agg(F.max("ts").alias("at")), "event_type")
    return assessed(rows.select(F.concat(F.lit("inference-"), "event_type").alias("name"), F.lit("Inference").alias("type"), score.alias("score"), "at"))


def recent(assessments: list[DataFrame], n: int | None = None) -> DataFrame:
    """The union, newest day first, then by name; ``n`` limits the list, as a dashboard shows it."""
    union = reduce(lambda a, b: a.unionByName(b), assessments).orderBy(F.to_date("at").desc(), F.asc_nulls_last("name")).drop("at")
    return union if n is None else union.limit(n)


def kpis(assessments: DataFrame) -> DataFrame:
    """pos, label, value and sub-caption of each key figure."""
    of = lambda kind, *status: F.count_if((F.col("type") == kind) & (F.col("status").isin(*status) if status else F.lit(True)))
    text = lambda c: c.cast("string")
    checks, findings = of("Inference"), F.count_if(F.col("status") != "Trusted")
    share = F.when(checks > 0, F.round(of("Inference", "Trusted") * 100.0 / checks)).otherwise(0).cast("int")
    rows = (
        ("Datasets Assessed", of("Dataset"), F.concat(text(of("Dataset", "Needs Review", "Quarantined")), F.lit(" flagged for review"))),
        ("Models Certified", of("Model", "Trusted"), F.concat(text(of("Model", "Needs Review", "Quarantined")), F.lit(" pending re-check"))),
        ("Inference Verifications", checks, F.concat(text(share), F.lit("% trusted"))),
        ("Open Findings", findings, F.concat(text(F.count_if(F.col("status") == "Quarantined")), F.lit(" high severity"))),
    )
    sums = assessments.agg(*[c.alias(f"{kind}{i}") for i, (_, value, sub) in enumerate(rows) for kind, c in (("v", text(value)), ("s", sub))])
    items = [F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.col(f"v{i}").alias("value"), F.col(f"s{i}").alias("sub")) for i, (label, *_) in enumerate(rows)]
    return sums.select(F.inline(F.array(*items)))


def risks(triggers: DataFrame, drift: DataFrame) -> DataFrame:
    """label, level and icon of a model's risks: triggers found, and the distance of each drift (``drift_kind``, ``tvd``)."""
    found = triggers.agg(F.count("*").alias("k")).select(
        F.lit("Backdoor Detection").alias("label"), risk_level(F.col("k"), 1, 10, 100).alias("level"), F.lit("crosshair").alias("icon")
    )
    shown = {"prediction": ("Prediction Drift", "trend"), "confidence": ("Confidence Drift", "gauge")}
    moved = drift.filter(F.col("drift_kind").isin(*shown)).select(
        lookup({k: label for k, (label, _) in shown.items()}, F.col("drift_kind")).alias("label"),
        risk_level(F.col("tvd"), 0.1, 0.2, 0.4).alias("level"),
        lookup({k: icon for k, (_, icon) in shown.items()}, F.col("drift_kind")).alias("icon"),
    )
    return found.unionByName(moved)
