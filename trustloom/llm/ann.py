"""Nearest neighbours by additive quantisation, with the error of each code as a bound.

A vector's direction is coded as the sum of one word of each of several full-dimensional codebooks. The codebooks are
trained one after the other on residuals (k-means on a bounded sample), a vector is encoded by beam search over
all of them, and its length, the scale of its reconstruction and what the code leaves of it are stored. A query scores all codes by
look-up tables of its inner products with the words. The best are scored by the exact inner product in double precision, and
so is every other that could still be as near as the last of them: a score by look-up is wrong by no more than what the code leaves.
So nothing near is missed, whatever the vectors; poor codes cost exact scores, not neighbours.

Work is dealt as blocks of queries against blocks of vectors with their codes, each of bounded size. Blocks of queries are large, so
vectors are copied seldom; each pair of blocks gives the ``k`` nearest of each query, and a merge keeps the best. Equal vectors are one
class in the index: of each class only the ``k + 1`` smallest ids can be among the nearest, so a hot vector costs no more than another.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, neither as query nor as candidate; ties go to the smaller id; repeated
rows (equal id and vector) count once; fewer candidates than ``k`` give fewer rows; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import materialise

#: Words of a codebook.
WORDS = 256
#: Queries that are scored together.
_TILE = 32


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def train_codebooks(sample: np.ndarray, books: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``books`` x WORDS x dimensions, by k-means on the residuals of the sample."""
    rng, left, out = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        words = left[rng.choice(len(left), WORDS, replace=len(left) < WORDS)].copy()
        for _ in range(rounds):
            near = np.argmax(left @ words.T - 0.5 * (words**2).sum(1), axis=1)
            sums, counts = np.zeros_like(words), np.bincount(near, minlength=WORDS)
            np.add.at(sums, near, left)
            words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        near = np.argmax(left @ words.T - 0.5 * (words**2).sum(1), axis=1)
        left = left - words[near]
        out.append(words)
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8, one per codebook) and the reconstructions."""
    n = len(vectors)
    left, codes = vectors[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    for words in books:
        # squared error of each beam entry less each word
        error = (left**2).sum(2)[:, :, None] - 2 * (left @ words.T) + (words**2).sum(1)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1] - 1), axis=1)[:, :beam]
        entry, word = best // WORDS, best % WORDS
        rows = np.arange(n)[:, None]
        left = left[rows, entry] - words[word]
        codes = np.concatenate((codes[rows, entry], word[:, :, None].astype(np.uint8)), axis=2)
        cost = flat[rows, best]
    chosen = codes[np.arange(n), np.argmin(cost, axis=1)]
    return chosen, sum(words[chosen[:, j]].astype(np.float64) for j, words in enumerate(books))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """By way of the greatest component, so that no square overflows or vanishes."""
    most = np.abs(vectors).max(axis=1)
    return most * np.linalg.norm(vectors / most[:, None], axis=1)


def by_lookup(codebooks: np.ndarray, code: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The inner product of each query with what each code (books x rows) stands for, by tables of its inner products with the words."""
    tables = codebooks @ queries.T  # books x words x queries
    scores = np.empty((len(queries), code.shape[1]))
    for at in range(0, code.shape[1], 4096):
        part = code[:, at : at + 4096]
        sums = tables[0][part[0]]
        for table, words in zip(tables[1:], part[1:]):
            sums += table[words]
        scores[:, at : at + 4096] = sums.T
    return scores


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed from the first component to the last."""
    out = np.empty(len(left))
    for at in range(0, len(left), 1 << 15):
        out[at : at + (1 << 15)] = np.cumsum(left[at : at + (1 << 15)] * right[at : at + (1 << 15)], axis=1)[:, -1] + 0.0
    return out


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    books: int = 32,
    sample_rows: int = 8192,
    rerank: int = 150,
    query_block: int = 1 << 14,
    code_block: int = 1 << 16,
) -> DataFrame:
    """The ``k`` nearest found of every row for which ``is_query`` holds, among all other rows.

    ``vectors``: vec_id and embedding. The codebooks are fitted on at most ``sample_rows`` vectors, the smallest
    by hash; every row is indexed. The ``rerank`` best of each query and block by look-up are scored exactly, and all that may be as near.
    Returns query_id, rank, vec_id and score.
    """
    valid = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    valid = valid.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims = length["n"]
    valid = valid.filter(F.size("v") == dims).withColumn("class", F.xxhash64("v"))

    # the smallest ids of each distinct vector; first within salts, so that no class meets in one task
    narrow = valid.select("vec_id", "v", "class").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = Window.partitionBy("class", "v", "salt").orderBy("vec_id")
    second = Window.partitionBy("class", "v").orderBy("vec_id")
    narrow = narrow.withColumn("at", F.dense_rank().over(first)).filter(F.col("at") <= k + 1).drop("at", "salt").dropDuplicates(["class", "v", "vec_id"])
    narrow = narrow.withColumn("at", F.row_number().over(second)).filter(F.col("at") <= k + 1)
    classes = materialise(narrow.groupBy("class", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-classes")

    sample = classes.select("v").orderBy(F.xxhash64("v", F.lit(1)), "v").limit(sample_rows)
    sampled = np.array([r["v"] for r in sample.toLocalIterator()]).reshape(-1, dims)
    codebooks = train_codebooks(sampled / lengths(sampled)[:, None], books)
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)  # books x 256 x dimensions
    # what sums in single precision may be wrong by
    slack = (dims + books) * 2.0**-22 * float(np.linalg.norm(codebooks, axis=2).max(axis=1).sum())

    asked = materialise(valid.filter("q").select("vec_id", "v").distinct(), "ann-queries")
    count, queries = classes.count(), asked.count()
    # smaller blocks of codes where there are few, so that all cores have some; the grid does not change what is found
    code_block = min(code_block, max(1024, (1 << 22) // dims))
    code_blocks, query_blocks = max(1, -(-count // code_block)), max(1, -(-queries // query_block))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    code_blocks = max(code_blocks, min(-(-2 * cores // query_blocks), -(-count // 4096)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.float64)
            for at in range(0, len(every), 1024):
                length = lengths(every[at : at + 1024])
                v = every[at : at + 1024] / length[:, None]
                codes, made = encode(v, shared.value)
                scale = (v * made).sum(1) / np.maximum((made**2).sum(1), 1e-30)
                left = np.linalg.norm(v - scale[:, None] * made, axis=1) + np.abs(scale) * slack + 1e-12
                columns = [batch.column(c).slice(at, 1024) for c in ("ids", "v", "block")] + [pa.array([c.tobytes() for c in codes], pa.binary())]
                columns += [pa.array(scale * length), pa.array(left * length)]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "v", "block", "codes", "scale", "wrong"])

    # single precision is sent where the vectors come in it
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    blocked = classes.withColumn("block", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(code_blocks)).cast("int"))
    codes = blocked.select("ids", F.col("v").cast(kind).alias("v"), "block")
    codes = codes.mapInArrow(encoded, f"ids array<bigint>, v {kind}, block int, codes binary, scale double, wrong double")
    codes = materialise(codes, "ann-codes")
    asked = asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(np.float64)

    def search(own: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if own.num_rows and index.num_rows:
            code = np.ascontiguousarray(np.frombuffer(b"".join(index.column("codes").to_pylist()), np.uint8).reshape(-1, books).T)
            scale, wrong, held = index.column("scale").to_numpy(), index.column("wrong").to_numpy(), matrix(index.column("v"))
            lists = index.column("ids").combine_chunks()
            starts, members = lists.offsets.to_numpy(), lists.values.to_numpy()
            first, names, vectors = members[starts[:-1]], own.column("vec_id").to_numpy(), matrix(own.column("v"))
            best, want = min(max(rerank, k + 1), len(scale)), min(k + 1, len(scale))
        for at in range(0, own.num_rows if index.num_rows else 0, _TILE):
            some = vectors[at : at + _TILE]
            length = lengths(some)
            near = by_lookup(shared.value, code, (some / length[:, None]).astype(np.float32)) * scale
            top = np.argpartition(-near, best - 1, axis=1)[:, :best]
            sure = exact(np.repeat(some, best, axis=0), held[top.ravel()]).reshape(-1, best)
            last = -np.partition(-sure, want - 1, axis=1)[:, want - 1] / length
            near += wrong
            np.put_along_axis(near, top, np.inf, axis=1)
            for i, (query, name) in enumerate(zip(some, names[at : at + _TILE].tolist())):
                rows = np.flatnonzero(near[i] >= last[i])
                score = np.concatenate([exact(held[rows[j : j + (1 << 15)]], query[None, :]) for j in range(0, len(rows), 1 << 15)])
                # of more than k + 1 classes the others come after k ids that are not the query's own
                chosen = np.lexsort((first[rows], -score))[: k + 1]
                found = [(-score[j], id_) for j in chosen.tolist() for id_ in members[starts[rows[j]] : starts[rows[j] + 1]].tolist() if id_ != name]
                found = sorted(found)[:k]
                out.append((np.full(len(found), name), np.array([x[1] for x in found], np.int64), np.array([-x[0] for x in found])))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    pair = ["qblock", "block"]
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1)))).groupBy(*pair)
    right = codes.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).groupBy(*pair)
    near = left.cogroup(right).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
