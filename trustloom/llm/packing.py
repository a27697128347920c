"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of
at most ``capacity`` counts, whatever the number of documents. The plan (which
lengths share a sequence, how often) is made from the histogram on the driver and is as
small; which document takes which place follows from its rank among the pieces of its length: the
rank inside its input partition plus the counts of the partitions before, which a shuffled join by length and
partition brings to the pieces (rows of some 40 bytes; the ids are not moved).

Reduction: a set of pieces that fits and dominates every other set with the same
largest piece is fixed for good: the piece alone if nothing fits beside it, the piece and its exact
complement, or the piece and the largest that fits if no two or three others can fill more.
The rest is packed best-fit in order of decreasing length.

Defined results: null text is the empty text (one piece, the end id); only documents longer than
the capacity are cut; rows of equal ``doc_id`` are documents of their own; an empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import materialise
from trustloom.llm.tokenize import encoder


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix dominating sets; takes them out of ``count`` (by length) and returns (times, lengths)."""
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def fix(times: int, *lengths: int) -> None:
        fixed.append((int(times), lengths))
        for n in lengths:
            count[n] -= times

    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while count[length]:
                rest = capacity - length
                count[length] -= 1
                sizes = np.nonzero(count[: rest + 1])[0]  # others that fit beside one piece
                count[length] += 1
                if not len(sizes):
                    # two of this length can't share either: rest < length or no second one
                    fix(count[length] if length > rest else 1, length)
                elif sizes[-1] == rest:
                    fix(min(count[length], count[rest]) if rest != length else count[length] // 2, length, rest)
                else:
                    k, small = int(sizes[-1]), int(sizes[0])
                    others = np.repeat(sizes, np.minimum(count[sizes] - (sizes == length), 3))
                    if len(others) >= 3 and others[:3].sum() <= rest:
                        break
                    if len(others) >= 2 and 2 * small <= rest:
                        pairs = others[:, None] + others[None, :]
                        np.fill_diagonal(pairs, 0)
                        if pairs[pairs <= rest].max(initial=0) > k:
                            break
                    # the bounds above hold for one more piece only while counts stay above it
                    fix(max(1, min(count[length], count[k]) // 2) if k != length else 1, length, k)
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram, equal bins together; returns (times, lengths)."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left

    def put(times: int, lengths: tuple[int, ...]) -> None:
        if times:
            bins[capacity - sum(lengths)].append((times, lengths))

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            room = min((r for r, b in bins.items() if r >= length and b), default=None)
            times, lengths = bins[room].pop() if room is not None else (left, ())
            fit = (capacity if room is None else room) // length
            full = min(times, left // fit)
            put(full, lengths + (length,) * fit)
            left -= full * fit
            times -= full
            if times and left and left < fit:
                put(1, lengths + (length,) * left)
                times, left = times - 1, 0
            if room is not None:
                put(times, lengths)
    return [x for b in bins.values() for x in b]


def plan_sequences(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, its places in order of rank: rows of (first rank, first
    sequence, offset); rank r of a run takes sequence first + r - first rank."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    plan = reduce_dominated(count, capacity)
    plan += best_fit(count, capacity)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: np.array(x, np.int64).reshape(-1, 3) for length, x in runs.items()}


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """The pieces of every text, of at most ``capacity`` ids: doc_id, piece, start, length, ids, and
    ``part`` and ``rank``, the place among the pieces of equal length in this input partition."""
    encode = encoder(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in encode(batches):
            rows = defaultdict(list)
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids.as_py()
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    end = first if not piece else start + capacity
                    row = (name, piece, start, end - start, ids[4 * start : 4 * end], part, seen[end - start])
                    for k, v in zip(("doc_id", "piece", "start", "length", "ids", "part", "rank"), row):
                        rows[k].append(v)
                    seen[end - start] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[f.name], f.type) for f in _PIECES], schema=_PIECES
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, rank bigint"
    )


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("rank", pa.int64())]
)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (with
    length, part and rank; any other columns are kept)."""
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_sequences(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(
        counts.select(
            F.col("length").alias("_length"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
        ),
        "packing-bases",
    )
    plan = pieces.sparkSession.sparkContext.broadcast(runs)  # at most a few runs per length and room left
    keep = [c for c in pieces.columns if c not in ("part", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(lengths):
                mine, own = np.nonzero(lengths == n)[0], plan.value[int(n)]
                at = np.searchsorted(own[:, 0], rank[mine], side="right") - 1
                sequence[mine] = own[at, 1] + rank[mine] - own[at, 0]
                offset[mine] = own[at, 2]
            columns = [batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "sequence_id", "offset"])

    # the bases have a row per length and input partition, so they grow with the corpus: never a broadcast
    bases = bases.hint("shuffle_hash")
    ranked = pieces.join(bases, (pieces["length"] == bases["_length"]) & (pieces["part"] == bases["_part"]))
    ranked = ranked.select(*keep, (F.col("rank") + F.col("_base")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keep).schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")
