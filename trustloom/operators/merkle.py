"""Verification of the audit ledger: a Merkle tree for each day, proofs of entries, and the blocks that an altered ledger differs in.

The leaves are the digests of a day's entries in the order of their ids. Ids are cut into blocks of ``FAN``, blocks into blocks of blocks and
so on, and inside a block neighbours are hashed in pairs; the last of an odd number goes up as it is. So each step groups at most ``FAN``
digests in a row, whatever a day holds, and a proof has one digest a level, log2 of the entries in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a block; a power of two.
FAN = 64
DEPTH = FAN.bit_length() - 1


def leaves(events: DataFrame) -> DataFrame:
    """``day``, ``event_id`` and the digest of each entry. Rows that repeat an id are leaves of their own, ordered by digest."""
    text = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.sha2(text, 256).alias("digest"))


def _halved(nodes: Column) -> Column:
    """The level above: pairs of neighbours hashed, an odd last node unchanged."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) + 1) / 2).cast("int") - 1)
    both = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)), 256)
    return F.transform(pairs, lambda i: F.coalesce(both(i), F.get(nodes, 2 * i)))


def _levels(nodes: Column) -> Column:
    """All levels of a block, from its nodes to its root."""
    step = lambda held, _: F.concat(held, F.array(_halved(F.element_at(held, -1))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(nodes), step)


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes``: day, place, digest -> day, block, its children in order and their levels."""
    rows = nodes.groupBy("day", F.floor(F.col("place") / FAN).alias("block"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("children"))
    return rows.withColumn("levels", _levels(F.col("children.digest")))


def _roots(blocks: DataFrame) -> DataFrame:
    return blocks.select("day", F.col("block").alias("place"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))


def _tree(events: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each height, and the root of each day. Their number follows the logarithm of the largest id."""
    most = events.agg(F.max("event_id")).first()[0] or 0
    heights, nodes = [], leaves(events).withColumnRenamed("event_id", "place")
    while True:
        heights.append(_blocks(nodes))
        nodes, most = _roots(heights[-1]), most // FAN
        if not most:
            return heights, nodes


def day_roots(events: DataFrame) -> DataFrame:
    """``day`` and ``root``."""
    return _tree(events)[1].select("day", F.col("digest").alias("root"))


def block_roots(events: DataFrame) -> DataFrame:
    """``day``, ``block`` (event_id div ``FAN``) and ``root``: what is recorded of a ledger to find alterations in it."""
    return _roots(_blocks(leaves(events).withColumnRenamed("event_id", "place"))).select("day", F.col("place").alias("block"), F.col("digest").alias("root"))


def altered_blocks(recorded: DataFrame, events: DataFrame) -> DataFrame:
    """The blocks whose root is not the recorded one: ``changed``, ``missing`` (all entries are gone) or ``added``."""
    now = block_roots(events).withColumnRenamed("root", "computed")
    both = recorded.withColumnRenamed("root", "recorded").join(now, ["day", "block"], "full_outer")
    finding = F.when(F.col("computed").isNull(), "missing").when(F.col("recorded").isNull(), "added").otherwise("changed")
    return both.filter(~F.col("recorded").eqNullSafe(F.col("computed"))).select("day", "block", finding.alias("finding"), "recorded", "computed")


def _siblings(blocks: DataFrame) -> DataFrame:
    """``day``, ``place``, ``digest`` and ``path``: for each child its siblings on the way to the day's root, and whether they stand on the left.

    ``blocks`` have ``above``, the path of their own root.
    """
    rows = blocks.select("day", "levels", "above", F.posexplode("children").alias("i", "child"))

    def at(level: Column) -> Column:
        here = F.floor(F.col("i") / F.pow(F.lit(2.0), level)).cast("int")
        sibling = F.get(F.element_at("levels", level + 1), here.bitwiseXOR(F.lit(1)))
        return F.struct(sibling.alias("digest"), (here.bitwiseAND(F.lit(1)) == 1).alias("left"))

    path = F.filter(F.transform(F.sequence(F.lit(0), F.lit(DEPTH - 1)), at), lambda s: s["digest"].isNotNull())
    whole = F.when(F.col("above").isNull(), path).otherwise(F.concat(path, "above"))
    return rows.select("day", "child.place", "child.digest", whole.alias("path"))


def proofs(events: DataFrame) -> DataFrame:
    """``day``, ``event_id``, ``digest`` and ``path`` of every entry: the digests that lead from it to its day's root."""
    up = None
    for blocks in reversed(_tree(events)[0]):
        # paths are joined to blocks and each entry's is made after that, so none is shuffled
        if up is None:
            blocks = blocks.withColumn("above", F.lit(None).cast("array<struct<digest:string,left:boolean>>"))
        else:
            blocks = blocks.join(up.select("day", F.col("place").alias("block"), F.col("path").alias("above")), ["day", "block"])
        up = _siblings(blocks)
    return up.select("day", F.col("place").alias("event_id"), "digest", "path")


def folded(digest: Column, path: Column) -> Column:
    """The root that a proof leads to."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])), 256))


def verified(proofs: DataFrame, roots: DataFrame) -> DataFrame:
    """``day``, ``event_id``, the number of digests of its proof, and whether it leads to the recorded root."""
    found = proofs.join(roots, "day", "left")
    holds = F.coalesce(folded(F.col("digest"), F.col("path")) == F.col("root"), F.lit(False))
    return found.select("day", "event_id", F.size("path").alias("digests"), holds.alias("holds"))
