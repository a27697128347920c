"""Substring dedup: repeated 50-word windows, by super-k-mer partitioning.

A window of ``k`` words is assigned to the bucket of its minimiser, the smallest hash of
its ``m``-word grams. Consecutive windows with one minimiser travel together as one packed string, a super-k-mer.

1. A scan of the texts lists the super-k-mers by position: minimiser, and a hash of the content.
2. Minimisers of one document only are dropped: their windows can't repeat across documents.
3. Equal super-k-mers meet (map-side) in their smallest document; only that copy's words are
   packed and sent to the bucket. So a group of copies of any size is one string.
4. Each bucket sorts its windows by their words and finds each window's smallest document, exactly.
   A bucket with more than ``hot`` different super-k-mers (the edges of a very common passage) is
   split: its windows are grouped one by one, with map-side minima.
5. What is found is one row per super-k-mer, with its runs of repeated windows (64 at most) in an array. It is joined
   to the positions of all copies, which gives at most one row per position, and the covered words are removed.

Defined results: null text has no words; texts of fewer than ``k`` words keep all; a null ``doc_id``
neither loses words nor causes loss; rows of equal ``doc_id`` never cause each other loss; an
empty table gives no row. All input columns are returned, whatever their names; ``n_words``, ``n_removed`` and
``kept_text`` replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.llm.common import materialise, unpacked, whole_row

_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Windows in a super-k-mer at most, so that a text of one repeated word gives rows of bounded size.
_LONGEST = 64

def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def super_kmers(words: list[bytes], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, minimiser and content hash of each super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(words) < k:
        return none, none, none, none
    with np.errstate(over="ignore"):
        h = _word_hashes(words)
        grams = np.zeros(len(h) - m + 1, np.uint64)
        for j, p in enumerate(_powers(_P, m)):
            grams += h[j : j + len(grams)] * p
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(_Q)
        grams ^= grams >> np.uint64(29)
        width, least, step = k - m + 1, grams, 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        windows = len(words) - k + 1
        starts = np.concatenate(([0], np.nonzero(least[1:] != least[:-1])[0] + 1))
        lengths = np.diff(np.append(starts, windows))
        if lengths.max() > _LONGEST:
            parts = -(-lengths // _LONGEST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = np.repeat(starts, parts) + nth * _LONGEST
            lengths = np.diff(np.append(starts, windows))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_Q, len(h)), dtype=np.uint64)))
        inverse = _powers(pow(_Q, -1, 1 << 64), len(h))
        content = (sums[starts + lengths + k - 1] - sums[starts]) * inverse[starts]
        content ^= content >> np.uint64(31)
    return starts, lengths, least[starts].view(np.int64), content.view(np.int64)


def _list_positions(docs: DataFrame, k: int, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            found = [super_kmers(t.as_py().encode("utf-8", "surrogatepass").split(), k, m) for t in batch.column(2)]
            sizes = [len(x[0]) for x in found]
            starts, lengths, minimisers, contents = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(4))
            columns = [np.repeat(ids, sizes), np.repeat(keys, sizes), starts.astype(np.int32), lengths.astype(np.int32), minimisers, contents]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "uid", "start", "n", "minimiser", "content"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    listed = docs.filter("doc_id is not null and text is not null").select("doc_id", "uid", "text")
    return listed.mapInArrow(run, "doc_id bigint, uid bigint, start int, n int, minimiser bigint, content bigint")


def _pack(docs: DataFrame, k: int) -> DataFrame:
    """The packed string of each wanted super-k-mer; windows of hot buckets one by one (then ``window`` is true)."""
    schema = "minimiser bigint, content bigint, n int, at int, window boolean, packed binary, doc_id bigint, last bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(i) for i in range(3))):
                words, rows, doc = text.as_py().encode("utf-8", "surrogatepass").split(), [], doc.as_py()
                for x in wanted.as_py():
                    a, n = x["start"], x["n"]
                    own = (x["minimiser"], x["content"], n)
                    if x["hot"]:
                        rows += [(*own, i, True, b" ".join(words[a + i : a + i + k]), doc, x["last"]) for i in range(n)]
                    else:
                        rows.append((*own, 0, False, b" ".join(words[a : a + n + k - 1]), doc, x["last"]))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
                names = [x.split(" ")[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    return docs.select("doc_id", "text", "wanted").mapInArrow(run, schema)


_RUNS = "array<struct<at:int,length:int,first:bigint>>"
_FOUND = f"minimiser bigint, content bigint, n int, runs {_RUNS}"


def _sort_buckets(packed: DataFrame, k: int) -> DataFrame:
    """The runs of windows of each super-k-mer that start in a smaller document than its ``last``, if it has any."""

    def bucket(rows: list[tuple]) -> Iterator[tuple]:
        windows = []
        for r, row in enumerate(rows):
            words = row[3].split(b" ")
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            starts = [0, *ends[:-1]]
            windows += [(row[3][starts[i] : ends[i + k - 1] - 1], row[4], r, i) for i in range(row[2])]
        windows.sort()  # equal windows together, the smallest document first
        first: list[list[int]] = [[0] * row[2] for row in rows]
        for _, same in groupby(windows, key=itemgetter(0)):
            least = None
            for _, doc, r, i in same:
                least = doc if least is None else least
                first[r][i] = least
        for row, firsts in zip(rows, first):
            at, runs = 0, []
            for doc, run in groupby(firsts):
                length = sum(1 for _ in run)
                if doc < row[5]:
                    runs.append({"at": at, "length": length, "first": doc})
                at += length
            if runs:
                yield (*row[:3], runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        runs = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("first", pa.int64())]))
        kinds, names = [pa.int64(), pa.int64(), pa.int32(), runs], ["minimiser", "content", "n", "runs"]

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for _, group in groupby(rows(), key=itemgetter(0)):
            out += bucket(list(group))
            if len(out) > 20_000:
                yield flushed()
                out = []
        if out:
            yield flushed()

    ordered = packed.select("minimiser", "content", "n", "packed", "doc_id", "last").repartition("minimiser")
    return ordered.sortWithinPartitions("minimiser").mapInArrow(run, _FOUND)


def _spans(docs: DataFrame, k: int, m: int, hot: int) -> DataFrame:
    """doc_id, uid and the (start, length) of the removed runs of words."""
    listed = materialise(_list_positions(docs, k, m), "substring-listed")
    minimisers = listed.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialise(minimisers.filter("low < high").select("minimiser"), "substring-shared")
    listed = materialise(listed.join(shared, "minimiser", "left_semi"), "substring-candidates")

    one = F.min(F.struct("doc_id", "uid", "start")).alias("one")
    strings = materialise(listed.groupBy("minimiser", "content", "n").agg(one, F.max("doc_id").alias("last")), "substring-strings")
    crowded = materialise(strings.groupBy("minimiser").count().filter(F.col("count") > hot).select("minimiser", F.lit(True).alias("hot")), "substring-hot")
    wanted = (
        strings.join(crowded, "minimiser", "left")
        .select("one.doc_id", "one.uid", F.struct("one.start", "n", "minimiser", "content", "last", F.coalesce("hot", F.lit(False)).alias("hot")).alias("x"))
        .groupBy("doc_id", "uid")
        .agg(F.collect_list("x").alias("wanted"))
    )
    # one row of the texts for each (doc_id, uid) is enough; repeated rows only pack the same strings again
    packed = materialise(_pack(docs.select("doc_id", "uid", "text").join(wanted, ["doc_id", "uid"]), k), "substring-packed")

    found = _sort_buckets(packed.filter("not window"), k)
    windows = packed.filter("window")
    firsts = materialise(windows.groupBy("packed").agg(F.min("doc_id").alias("first")), "substring-firsts")
    single = windows.join(firsts, "packed").filter("first < last")
    single = single.groupBy("minimiser", "content", "n").agg(F.collect_set(F.struct("at", "first")).alias("windows"))
    found = found.unionAll(single.select("minimiser", "content", "n", _joined_windows(F.col("windows")).alias("runs")))
    found = materialise(found, "substring-found")  # one row per super-k-mer

    hits = listed.join(found, ["minimiser", "content", "n"])
    earlier = F.filter("runs", lambda r: r["first"] < F.col("doc_id"))
    spans = F.transform(earlier, lambda r: F.struct((F.col("start") + r["at"]).alias("start"), (r["length"] + k - 1).alias("length")))
    hits = hits.select("doc_id", "uid", spans.alias("spans")).filter(F.size("spans") > 0)
    return hits.groupBy("doc_id", "uid").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _joined_windows(windows: Column) -> Column:
    """Single windows (at, first) of one super-k-mer as runs of consecutive ones of equal ``first``."""

    def step(runs: Column, w: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        goes_on = (F.size(runs) > 0) & (last["first"] == w["first"]) & (last["at"] + last["length"] == w["at"])
        longer = F.struct(last["at"].alias("at"), (last["length"] + 1).alias("length"), last["first"].alias("first"))
        new = F.struct(w["at"].alias("at"), F.lit(1).alias("length"), w["first"].alias("first"))
        return F.when(goes_on, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(new)))

    return F.aggregate(F.array_sort(windows), F.array().cast(_RUNS), step)


def remove_repeats(docs: DataFrame, k: int = 50, m: int = 8, hot: int = 128) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by one blank."""
    added = ("n_words", "n_removed", "kept_text")
    docs = docs.drop(*added)
    uid = F.xxhash64("text").alias("uid")
    spans = _spans(docs.select("doc_id", "text", uid), k, m, hot)
    joined = docs.select("doc_id", uid, whole_row(docs).alias("row")).join(spans, ["doc_id", "uid"], "left").select("spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).field("text"), batch.column(0)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words), bool)
                for x in spans.as_py() or ():
                    gone[x["start"] : x["start"] + x["length"]] = True
                left = [w for w, g in zip(words, gone) if not g] if gone.any() else words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            columns = [batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", *added])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    schema = StructType([joined.schema["row"], *StructType.fromDDL("n_words bigint, n_removed bigint, kept_text string")])
    return unpacked(joined.mapInArrow(run, schema), "row", docs.columns, *added)
