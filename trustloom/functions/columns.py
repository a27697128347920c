"""Column functions of the assurance documents. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which tone a level or a status is shown in.
RISK_TONES = {"low": "green", "medium": "amber", "high": "red", "critical": "red"}
AUDIT_TONES = {"Trusted": "green", "Verified": "green", "Completed": "slate", "Actioned": "sky"}

# Our own thresholds; nothing prescribes them.
TRUST_STATUS = ((60, "Quarantined", "red"), (75, "Needs Review", "amber"))
TIMESTAMP_FORMAT, DATE_FORMAT = "d MMM yyyy, hh:mm a", "d MMM yyyy"


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    """The value of ``key`` in a constant map, else ``default``; null keys take the default."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, F.coalesce(key, F.lit("\0")))
    return found if default is None else F.coalesce(found, F.lit(default))


def risk_tone(level: Column) -> Column:
    return lookup(RISK_TONES, level)


def audit_tone(status: Column) -> Column:
    return lookup(AUDIT_TONES, status, "slate")


def clamp_pct(value: Column) -> Column:
    """Into [0, 100]; null counts as 0 (``least`` and ``greatest`` alone would skip it)."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value, F.lit(0))))


def cycle_pick(items: Column, position: Column) -> Column:
    """The item at a position that wraps round."""
    return F.when(F.size(items) > 0, F.get(items, F.pmod(position, F.size(items))))


def find_or_first(items: Column, field: str, key: Column) -> Column:
    """The first item whose ``field`` is ``key``, else the first item; null for an empty array."""
    return F.coalesce(F.get(F.filter(items, lambda x: x[field] == key), 0), F.get(items, 0))


def live_or_default(live: Column, default: Column) -> Column:
    """The whole live document if there is one, else the whole default: never field by field."""
    return F.when(live.isNotNull(), live).otherwise(default)


def live_status(live: Column, status: Column) -> Column:
    return F.when(live.isNotNull(), F.lit("Backend live")).otherwise(status)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def risk_level(rate: Column, medium: float, high: float, critical: float) -> Column:
    return F.when(rate >= critical, "critical").when(rate >= high, "high").when(rate >= medium, "medium").otherwise("low")


def trust_status(score: Column) -> Column:
    out = None
    for limit, status, _ in TRUST_STATUS:
        out = F.when(score < limit, status) if out is None else out.when(score < limit, status)
    return out.otherwise("Trusted")


def trust_tone(score: Column) -> Column:
    out = None
    for limit, _, tone in TRUST_STATUS:
        out = F.when(score < limit, tone) if out is None else out.when(score < limit, tone)
    return out.otherwise("green")


def short_digest(digest: Column) -> Column:
    """First and last four digits, for display."""
    return F.concat(F.substring(digest, 1, 4), F.lit("..."), F.right(digest, F.lit(4)))


def shown_timestamp(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_FORMAT)


def shown_date(ts: Column) -> Column:
    return F.date_format(ts, DATE_FORMAT)


def parsed_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT))


def json_text(document: Column) -> Column:
    """A document as JSON, nulls and all. Its fractions are shares of at most six places; Spark writes those under a thousandth with an exponent,
    here they are written out. A quote inside a string has a backslash before it, so none but a field's value follows letter, quote and colon."""
    text = F.to_json(document, {"ignoreNullFields": "false"})
    for places in (4, 5, 6):
        text = F.regexp_replace(text, rf'(?<=[A-Za-z]":)(\d)\.(?:0|(\d+))E-{places}(?=[,}}])', "0." + "0" * (places - 1) + "$1$2")
    return text


def access_caption(mode: Column) -> Column:
    """The caption of an access mode; any mode but ``white``, or none, is black-box."""
    return F.when(mode == "white", "Full access to weights and gradients").otherwise("Query access to outputs only")
