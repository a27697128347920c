"""Ranked lexical search by Fagin's threshold algorithm over shards of the documents.

The documents are dealt out in shards. A task holds one shard at a time as a forward index (the impact of every term in every
document) and as one list for each term, sorted by impact. For each item it reads the lists of the item's terms in turn,
some postings deeper each time, looks the full score of each new document up in the forward index, and stops when the
threshold (the sum of the impacts reached in the lists) falls strictly below the score of the k-th best; so no document that it has not
seen can reach or tie with that one. The k best of a task go on to its next shard, where they stop most searches early. The
best of all tasks are merged. A shard's size is bounded, so no list is ever sorted whole, and what is shuffled are k rows for each
item and task.

Impacts need counts of the whole corpus (documents, terms, documents of each term). So a first pass writes the forward index of the
terms that the items have, some bytes a posting; texts are read once and never shuffled. Items are taken in blocks of about
``block_terms`` terms, each with passes of its own, so what is sent to the tasks does not grow with the items.

Defined results: null text has no terms, and neither a document nor an item without terms is in any result; a repeated row of a document is a
document of its own; of an item a repeated row counts once, and rows of one item_id with different texts are one item that has the terms of all;
null ids are ids, a null doc_id comes last among equal scores; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import materialise

#: A-Z become lower case and the other ASCII characters but digits and letters become blanks.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Cells of the forward index that a task holds at once (four bytes each).
_CELLS = 1 << 24


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and any non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and its ``terms``, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t.decode() for t in terms(x)] for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct().mapInArrow(run, "item_id bigint, terms array<string>")
    return rows.groupBy("item_id").agg(F.flatten(F.collect_list("terms")).alias("terms")).filter(F.size("terms") > 0)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), and of the terms in the vocabulary their numbers ``terms`` and counts ``tfs``, of every document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            n, cuts, numbers, counts = [], [0], [], []
            for x in batch.column(1).cast(pa.binary()):
                words = terms(x.as_py())
                n.append(len(words))
                tf = Counter(words)
                both = tf.keys() & known.keys()
                numbers += [known[t] for t in both]
                counts += [tf[t] for t in both]
                cuts.append(len(numbers))
            cuts = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (numbers, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Shard:
    """A forward index and impact-sorted lists of some documents."""

    def __init__(self, m: np.ndarray, cuts: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, width: int):
        rows = np.repeat(np.arange(len(m)), np.diff(cuts))
        tf = tfs.astype(np.int64)
        impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[rows])).astype(np.int32)
        self.forward = np.zeros((len(m), width), np.int32)
        self.forward[rows, numbers] = impact
        order = np.lexsort((-impact, numbers))
        self.docs, self.impacts = rows[order], impact[order]
        self.starts = np.searchsorted(numbers[order], np.arange(width + 1))

    def search(self, columns: np.ndarray, weights: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The documents seen and their scores, enough of them to hold the k best; ``least``: the k-th best score known so far, if there are k."""
        starts, ends = self.starts[columns], self.starts[columns + 1]
        some = ends > starts
        columns, weights, starts, ends = columns[some], weights[some], starts[some], ends[some]
        seen = np.zeros(len(self.forward), bool)
        found, scores, depth, step = [], [], 0, 8
        top = np.zeros(0, np.int64)
        while (open_ := starts + depth < ends).any():
            new = np.concatenate([self.docs[s + depth : min(e, s + depth + step)] for s, e in zip(starts[open_], ends[open_])])
            new = np.unique(new[~seen[new]])
            if len(new):
                seen[new] = True
                score = self.forward[np.ix_(new, columns)].astype(np.int64) @ weights
                found.append(new)
                scores.append(score)
                top = np.concatenate((top, score))
                top = np.partition(top, len(top) - k)[-k:] if len(top) > k else top
            depth += step
            left = starts + depth < ends
            threshold = int(weights[left] @ self.impacts[starts[left] + depth - 1].astype(np.int64))
            kth = max([x for x in (least, int(top.min()) if len(top) == k else None) if x is not None], default=None)
            if kth is not None and threshold < kth:
                break
            step = min(2 * step, 512)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found]), np.concatenate([none, *scores])


def _best_of_tasks(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], width: int, documents: int, terms_in_all: int, k: int) -> DataFrame:
    """``item`` (its place in ``queries``), ``doc_id``, ``score`` and ``task``: the k best of each task."""
    held = index.sparkSession.sparkContext.broadcast(queries)
    rows_at_once = max(16, _CELLS // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        queries = held.value
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [empty] * len(queries)  # of each item: scores, whether the id is null, ids
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                ids = batch.column(0).fill_null(0).to_numpy()
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                m = np.array([25 + 75 * n * documents // terms_in_all for n in batch.column(1).to_pylist()], np.int64)
                numbers, tfs = (batch.column(c).flatten().to_numpy() for c in (2, 3))
                cuts = np.concatenate(([0], np.cumsum(np.fromiter((len(x) for x in batch.column(2)), np.int64, batch.num_rows))))
                shard = Shard(m, cuts, numbers, tfs, width)
                for q, (columns, weights) in enumerate(queries):
                    held_scores, held_none, held_ids = best[q]
                    found, scores = shard.search(columns, weights, k, int(held_scores[-1]) if len(held_scores) == k else None)
                    use = scores > 0
                    found, scores = found[use], scores[use]
                    if len(found):
                        s, o, i = np.concatenate((held_scores, scores)), np.concatenate((held_none, none[found])), np.concatenate((held_ids, ids[found]))
                        order = np.lexsort((i, o, -s))[:k]
                        best[q] = s[order], o[order], i[order]
        items = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        scores, none, ids = (np.concatenate([b[j] for b in best] or [empty[j]]) for j in range(3))
        task = np.full(len(items), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(scores, pa.int64()), pa.array(task, pa.int32())],
            ["item", "doc_id", "score", "task"],
        )

    return index.mapInArrow(run, "item int, doc_id bigint, score bigint, task int")


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 20_000) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents of highest score for each item."""
    spark = docs.sparkSession
    asked = materialise(_item_terms(items), "lexical-items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    parts = [_rank_block(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect(), k) for b in range(blocks)]
    found = reduce(DataFrame.unionAll, [p for p in parts if p is not None] or [spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint, task int")])
    # what many tasks found of one item meets in two steps
    few = _first(found.withColumn("part", F.col("task") % 64), k, "item_id", "part").select("item_id", "doc_id", "score")
    return _first(few, k, "item_id").select("item_id", "rank", "doc_id", "score")


def _rank_block(docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    names = sorted({t for r in asked for t in r["terms"]})
    if not names:
        return None
    index = materialise(forward_index(docs, {t.encode(): i for i, t in enumerate(names)}), "lexical-forward")
    documents, total = index.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = {r["t"]: r["n"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row per term of the block
    number = {t: i for i, t in enumerate(names)}
    queries = []
    for r in asked:
        counts = sorted((number[t], c) for t, c in Counter(r["terms"]).items() if number[t] in df)
        queries.append((np.array([i for i, _ in counts], np.int64), np.array([c * term_weight(documents, df[i]) for i, c in counts], np.int64)))
    best = _best_of_tasks(index, queries, len(names), documents, total, k)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], "item int, item_id bigint")
    return materialise(best.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score", "task"), "lexical-best")  # the block's items
