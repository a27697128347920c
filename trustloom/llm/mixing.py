"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 64-bit hash. A source that needs a budget of b words more
than its whole repeats takes the documents whose hash lies below a threshold;
the threshold is found by histograms alone: sum the sizes by source and the top
hash bits, find the bucket in which the running sum crosses the budget, then
split that bucket only by its next bits, until the hash is used up. Nothing is
sorted, and thresholds of growing budgets are nested, so a larger budget keeps
what a smaller one took.

Memory is bounded by sources x ``2**bits`` sums. A hot source is summed
map-side before its one row per bucket and task is shuffled.

Defined results: null text or size counts 0 words; a null source is a source,
last in order; rows with equal content share a hash and are taken together;
documents of 0 words are never counted as taken; a source without words has
target 0; an empty table gives no row. All input columns are kept, whatever their names, but for
``source_size``, ``target`` and ``times``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import materialise, quoted, unpacked, whole_row


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by ``weight``, at most ``cap``
    times the source's own size, the excess reshared by weight.

    Resharing until none is above its cap ends at min(cap, level * weight) with
    one level for all; in order of cap / weight the capped sources come first,
    so the level follows from running sums. ``sources`` has one row per source.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    ordered = Window.orderBy("_ratio", "_at")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        sources.withColumn("_ratio", limit / F.col("weight"))
        .withColumn("_at", F.col("position"))
        .withColumn("_budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        # the first source that its level does not fill sets the level for all after it
        .withColumn("_first", F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_at", "_level")))
        .withColumn("_level", F.min("_first").over(Window.partitionBy())["_level"])
    )
    return levels.withColumn(
        "target", F.when(F.col("_level").isNull(), limit).otherwise(F.least(limit, F.col("_level") * F.col("weight")))
    ).drop("_ratio", "_at", "_budget", "_first", "_level")


def _digit(level: int, bits: int) -> Column:
    """The ``level``-th group of ``bits`` bits of the hash, from the top."""
    return F.shiftrightunsigned(F.shiftleft("hash", level * bits), 64 - bits)


def mix(docs: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0, bits: int = 8) -> DataFrame:
    """Add ``source_size``, ``target`` and ``times``, how often the mix takes each document (0, 1, ..., ``cap``).

    ``docs``: source, size and hash (long), and any other columns, which are kept; ``weights``: source,
    position, weight, one row per source. Only source, size and hash are gathered; the decision is
    applied to ``docs`` in place, by a join with one row per source.
    """
    whole, docs = docs, materialise(docs.select("source", "size", "hash"), "mix-sizes")
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = totals.join(weights, totals["source"].eqNullSafe(weights["source"])).drop(weights["source"])
    sources = (
        water_fill(sources, share, cap)
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    )
    sources = materialise(sources.select("source", "source_size", "target", "repeats", "budget"), "mix-sources")

    # the prefix of hash digits that leads to the boundary, and what is left of the budget below it
    edge = sources.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    at = docs.select("source", "size", "hash")
    for level in range(64 // bits):
        if level:  # only what lies in the boundary buckets
            match = at["source"].eqNullSafe(edge["source"]) & (F.shiftrightunsigned(at["hash"], 64 - level * bits) == edge["prefix"])
            at = materialise(at.join(edge.select("source", "prefix"), match, "left_semi"), f"mix-boundary{level}")
        sums = at.groupBy(F.col("source").alias("_source"), _digit(level, bits).alias("digit")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("_source").orderBy("digit"))
        sums = sums.withColumn("upto", running)
        crossing = sums.join(edge, sums["_source"].eqNullSafe(edge["source"])).filter(F.col("upto") > F.col("budget"))
        crossing = crossing.groupBy("source").agg(
            F.min(F.struct("digit", (F.col("budget") - (F.col("upto") - F.col("size"))).alias("budget"), "size", "prefix")).alias("x")
        )
        last = level == 64 // bits - 1
        edge = crossing.select(
            "source",
            (F.shiftleft("x.prefix", bits) + F.col("x.digit")).alias("prefix"),
            # at the last digit the bucket is one hash: it is taken if that comes nearer to the budget
            *([(F.col("x.budget") * 2 >= F.col("x.size")).alias("taken")] if last else [F.col("x.budget").alias("budget")]),
        )
        edge = materialise(edge, f"mix-edge{level}")

    sources = sources.withColumnRenamed("source", "_source")
    cut = sources.join(edge, sources["_source"].eqNullSafe(edge["source"]), "left").drop("source")
    cut = materialise(cut.select("_source", F.struct(*[c for c in cut.columns if c != "_source"]).alias("cut")), "mix-cut")
    # order of unsigned hashes: flip the sign bit and compare as signed
    flip = lambda c: c.bitwiseXOR(F.lit(-(2**63)))
    c, h = F.col("cut"), F.col("hash")
    below = flip(h) < flip(c["prefix"])
    extra = F.when(c["prefix"].isNull(), c["budget"] > 0).otherwise(below | (c["taken"] & (h == c["prefix"])))
    taken = F.when(F.col("size") > 0, c["repeats"] + extra.cast("int")).otherwise(0)
    names = [x for x in whole.columns if x.lower() not in ("source_size", "target", "times")]
    whole = whole.select("source", "size", "hash", whole_row(whole.select(*map(quoted, names))).alias("row"))
    joined = whole.join(cut, whole["source"].eqNullSafe(cut["_source"]))
    added = (c["source_size"].alias("source_size"), c["target"].alias("target"), F.least(taken, F.lit(int(cap))).alias("times"))
    return unpacked(joined, "row", names, *added)


def cycled_weights(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """``weights``, repeating, for the sources in code-point order, null last. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = docs.select("source").distinct().withColumn("position", F.row_number().over(order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.get(cycle, F.col("position") % len(weights)))
