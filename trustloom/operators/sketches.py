"""Mergeable sketches: distinct counts (HyperLogLog) and quantiles (KLL) that are kept by day or part and merged later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a quantile sketch; ranks are right to about 0.3 %.
K = 1024


def daily_distinct(events: DataFrame, group: str, value: str, precision: int = 12) -> DataFrame:
    """``group``, ``day`` and a sketch of the distinct values, some 4 KB: what is stored of a day, whatever it holds."""
    return events.groupBy(group, F.to_date("ts").alias("day")).agg(F.hll_sketch_agg(F.col(value).cast("string"), F.lit(precision)).alias("sketch"))


def merged_distinct(daily: DataFrame, group: str) -> DataFrame:
    """``group`` and the ``estimate`` over all of its days, from their sketches alone."""
    return daily.groupBy(group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def distinct_check(events: DataFrame, group: str, value: str, within: float = 0.05) -> DataFrame:
    """``group``, the ``exact`` count, and whether the merged sketches are ``close`` to it."""
    exact = events.groupBy(group).agg(F.countDistinct(F.col(value).cast("string")).alias("exact"))
    both = exact.join(merged_distinct(daily_distinct(events, group, value), group), group)
    return both.select(group, "exact", (F.abs(F.col("estimate") - F.col("exact")) <= within * F.col("exact")).alias("close"))


def quantile_sketches(scores: DataFrame, group: str, value: str, parts: int = 64) -> DataFrame:
    """``group`` and a sketch of its values. A group is sketched in parts that are merged, so none of any size is one task's."""
    part = F.pmod(F.xxhash64(value), F.lit(parts)).alias("part")
    some = scores.groupBy(group, part).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("sketch"))
    return some.groupBy(group).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def thresholds(scores: DataFrame, group: str, value: str, quantile: float) -> DataFrame:
    """``group`` and its ``threshold``: the value at the quantile, by sketch."""
    return quantile_sketches(scores, group, value).select(group, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)).alias("threshold"))


def threshold_check(scores: DataFrame, group: str, value: str, quantile: float, within: float = 0.01) -> DataFrame:
    """``group``, its rows ``n``, and whether the share of rows up to the threshold is ``close`` to the quantile (give or take a row)."""
    limits = thresholds(scores, group, value, quantile)
    below = scores.join(limits, group).groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(value) <= F.col("threshold")).cast("double")).alias("share"))
    return below.select(group, "n", (F.abs(F.col("share") - quantile) <= within + 1 / F.col("n")).alias("close"))
