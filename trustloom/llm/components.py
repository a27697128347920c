"""Connected components of a link table, by alternating large and small stars.

Each step replaces links by links to the smallest neighbour (a map-side minimum
and a join), keeps connectivity, and ends when all nodes of a component point to
its smallest node. The number of steps grows with the logarithm of the graph.
Before each step every input partition contracts its own links by union-find, without a
shuffle; a small graph is then nearly done. The minima are written before they are joined, so that the join is a plain
shuffled one of which Spark splits the hot nodes, or a broadcast where they are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import discard, materialise


#: Nodes that a task holds while it contracts its links.
_NODES = 1_000_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step. ``links``: a > b."""
    if large:
        links = materialise(_contracted(links), "components-contracted")
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "components-least")
    joined = both.join(least, "u")
    if large:
        # every larger neighbour of u is linked to the smallest node around u
        pairs = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # u and its smaller neighbours are linked to the smallest of them
        pairs = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    pairs = pairs.filter("a != b")
    out = materialise(pairs if large else pairs.distinct(), "components-links")
    discard(least)
    if large:
        discard(links)
    return out


def _contracted(links: DataFrame) -> DataFrame:
    """Each partition's links as stars to the smallest node of what it connects itself, some ``_NODES`` nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def stars() -> Iterator[pa.RecordBatch]:
            pairs = [(x, r) for x in parent if (r := root(x)) != x]
            parent.clear()
            for at in range(0, len(pairs), 50_000):
                part = list(zip(*pairs[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > _NODES:
                yield from stars()
        yield from stars()

    return links.select("a", "b").mapInArrow(run, links.select("a", "b").schema)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of a link.

    ``links``: columns a and b of one orderable type, in any order, without nulls.
    """
    links = materialise(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-start"
    )
    before = _state(links)
    while before[0]:
        middle = _star(links, large=True)
        after = _star(middle, large=False)
        discard(middle)
        discard(links)
        links = after
        state = _state(links)
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
