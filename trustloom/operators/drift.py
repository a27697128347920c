"""Distribution drift between a reference and an uploaded part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Feature histogram: standardised values from -3 to 3 in steps of 0.25.
BINS, LOW, STEP = 25, -3.0, 0.25
#: Stands for an empty share in the population stability index.
FLOOR = 1e-6


def category_drift(rows: DataFrame, label: str, is_reference: str, kind: str) -> DataFrame:
    """drift_kind, pos, label and each side's share in percent; a label that one side lacks has 0 there."""
    sides = rows.groupBy(F.col(label).alias("label")).agg(
        F.sum(F.when(F.col(is_reference), 1).otherwise(0)).alias("r"), F.sum(F.when(F.col(is_reference), 0).otherwise(1)).alias("u")
    )
    return _shares(sides, kind, "label")


def _shares(sides: DataFrame, kind: str, order: str) -> DataFrame:
    whole = Window.partitionBy()  # one row per label or bin

    def share(c: str):
        total = F.sum(c).over(whole)
        return F.when(total > 0, F.round(F.col(c) * 100.0 / total, 6)).otherwise(F.lit(0.0))

    return sides.select(
        F.lit(kind).alias("drift_kind"),
        (F.row_number().over(Window.orderBy(F.col(order).asc_nulls_last())) - 1).cast("bigint").alias("pos"),
        "label",
        share("r").alias("reference"),
        share("u").alias("uploaded"),
    )


def feature_drift(rows: DataFrame, value: str, is_reference: str, kind: str = "feature") -> DataFrame:
    """A histogram of the value, standardised by the reference part; all 25 bins are there."""
    ref = F.when(F.col(is_reference), F.col(value))
    stats = rows.agg(F.avg(ref).alias("mean"), F.stddev_pop(ref).alias("sd"))
    z = (F.col(value) - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    place = F.floor((F.round(z, 9) - (LOW - STEP / 2)) / STEP).cast("int")
    placed = rows.join(F.broadcast(stats)).select(is_reference, place.alias("bin"))  # stats is one row
    counts = (
        placed.filter(F.col("bin").between(0, BINS - 1))
        .groupBy("bin")
        .agg(F.sum(F.when(F.col(is_reference), 1).otherwise(0)).alias("r"), F.sum(F.when(F.col(is_reference), 0).otherwise(1)).alias("u"))
    )
    spine = rows.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    filled = spine.join(counts, "bin", "left").select(
        F.format_string("%05.2f", F.lit(LOW) + F.col("bin") * STEP).alias("label"), "bin", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("u", F.lit(0)).alias("u")
    )
    return _shares(filled, kind, "bin")


def drift_score(drift: DataFrame) -> DataFrame:
    """Per kind: total variation distance, population stability index and Kolmogorov-Smirnov distance."""
    r, u = F.col("reference") / 100, F.col("uploaded") / 100
    rf, uf = F.greatest(r, F.lit(FLOOR)), F.greatest(u, F.lit(FLOOR))
    running = Window.partitionBy("drift_kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    gaps = drift.withColumn("gap", F.abs(F.sum(u - r).over(running)))
    return gaps.groupBy("drift_kind").agg(
        F.round(F.sum(F.abs(u - r)) / 2, 4).alias("tvd"), F.round(F.sum((uf - rf) * F.log(uf / rf)), 4).alias("psi"), F.round(F.max("gap"), 4).alias("ks")
    )
