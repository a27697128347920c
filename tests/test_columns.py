from pyspark.sql import functions as F

from trustloom.functions import columns as C


def _one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_clamp_takes_null_as_zero(spark):
    got = _one(spark, a=C.clamp_pct(F.lit(None).cast("int")), b=C.clamp_pct(F.lit(-3)), c=C.clamp_pct(F.lit(101)), d=C.clamp_pct(F.lit(40)))
    assert tuple(got) == (0, 0, 100, 40)


def test_tones(spark):
    got = _one(
        spark,
        a=C.audit_tone(F.lit("Trusted")),
        b=C.audit_tone(F.lit("unheard of")),
        c=C.audit_tone(F.lit(None).cast("string")),
        d=C.risk_tone(F.lit("critical")),
        e=C.risk_tone(F.lit("low")),
        f=C.risk_tone(F.lit("none")),
    )
    assert tuple(got) == ("green", "slate", "slate", "red", "green", None)


def test_cycle_pick_wraps(spark):
    items = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    got = _one(spark, a=C.cycle_pick(items, F.lit(0)), b=C.cycle_pick(items, F.lit(4)), c=C.cycle_pick(F.array().cast("array<string>"), F.lit(1)))
    assert tuple(got) == ("a", "b", None)


def test_find_or_first(spark):
    items = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("v")) for k, v in (("x", 1), ("y", 2))])
    empty = F.array().cast("array<struct<id:string,v:int>>")
    got = _one(spark, a=C.find_or_first(items, "id", F.lit("y"))["v"], b=C.find_or_first(items, "id", F.lit("z"))["v"], c=C.find_or_first(empty, "id", F.lit("z"))["v"])
    assert tuple(got) == (2, 1, None)


def test_live_is_taken_whole(spark):
    kind = "struct<a:int,b:int>"
    live, default = F.struct(F.lit(None).cast("int").alias("a"), F.lit(2).alias("b")), F.struct(F.lit(7).alias("a"), F.lit(8).alias("b"))
    got = _one(spark, x=C.live_or_default(live.cast(kind), default), y=C.live_or_default(F.lit(None).cast(kind), default), s=C.live_status(live, F.lit("Processed")))
    assert tuple(got["x"]) == (None, 2) and tuple(got["y"]) == (7, 8) and got["s"] == "Backend live"


def test_timestamps_round_trip(spark):
    got = _one(spark, t=C.shown_timestamp(C.parsed_timestamp(F.lit("18 Sep 2026, 12:35 PM"))), bad=C.parsed_timestamp(F.lit("soon")))
    assert tuple(got) == ("18 Sep 2026, 12:35 PM", None)


def test_status_and_percent(spark):
    got = _one(spark, a=C.trust_status(F.lit(54)), b=C.trust_status(F.lit(68)), c=C.trust_status(F.lit(81)), d=C.percent(F.lit(1200), F.lit(10000)), e=C.percent(F.lit(0), F.lit(0)), f=C.trust_tone(F.lit(72)))
    assert tuple(got) == ("Quarantined", "Needs Review", "Trusted", 12.0, 0.0, "amber")
    modes = _one(spark, a=C.access_caption(F.lit("white")), b=C.access_caption(F.lit("black")), c=C.access_caption(F.lit(None).cast("string")))
    assert modes["a"] != modes["b"] == modes["c"]
