"""Interaction of filters: what each removes, alone and after the others, in every order.

Four filters look at a text by itself; E fails copies, identical to the text of a smaller doc_id anywhere in the table. Copies are found
by partition refinement: documents are split by their length in code points, then by the hashes of successive blocks of the text (each
block eight times as long as the one before, so the rounds follow the logarithm of the longest text), and after each split the
documents that are alone in their class drop out. The full texts of what is left are compared, and the ids that are not the smallest of their
text are marked. Only lengths, hashes and flags go through the rounds; in every count a class of any size is one row per task, and of
equal texts one per task is shuffled for the comparison.

Every filter's result is a bit, so a document is a mask. The masks are counted by part, and all orders are
worked out on those counts: 32 masks a part, whatever the number of documents.

Defined results: null text is the empty text; a null part is the empty string; a null doc_id comes after every other and is no smaller id
than another; rows that repeat a doc_id and text fail E only if a smaller id has the text; of several labels of a document any 1 counts; a document
without a label is neither good nor toxic; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.llm.common import materialise, text_of

LETTERS = "ABCDE"
#: A filter's bit in a mask.
BIT = {f: 1 << i for i, f in enumerate(LETTERS)}
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")
#: Places where the blocks of a text start, and their code points; the last reach beyond any text.
BLOCKS = [(64 * (8**i - 1) // 7, 64 * 8**i) for i in range(9)]
#: Classes that are broadcast at most (eight bytes each); more are joined by a shuffle.
_BROADCAST_CLASSES = 500_000


def fails(text: str) -> int:
    """The mask of the filters A to D that the text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at the six ASCII white-space characters only
    upper = len(raw) - len(raw.translate(None, _UPPER))
    out = BIT["A"] * (len(words) < 200) + BIT["B"] * (100 * len(set(words)) < 50 * len(words))
    return out + BIT["C"] * (100 * upper > 3 * len(text)) + BIT["D"] * (_MARKS.search(raw) is not None)


def _read(docs: DataFrame, part: str, bits: int) -> DataFrame:
    """``doc_id``, ``part``, ``text``, its ``length`` and the hashes of its ``blocks``, of which ``bits`` bits are kept."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.length(text).cast("bigint").alias("length"))
    places = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("n")) for at, n in BLOCKS])
    kept = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("bigint")
    hashed = F.transform(F.filter(places, lambda b: b["at"] < F.col("length")), lambda b: F.xxhash64(F.substring(F.col("text"), b["at"] + 1, b["n"])).bitwiseAND(kept))
    return rows.withColumn("blocks", hashed)


def _split(cls: Column, block: Column) -> Column:
    """The class of what was in ``cls`` and has this hash of its next block."""
    return F.xxhash64(cls, block)


def _masked(rows: DataFrame) -> DataFrame:
    """``mask`` of A to D in the place of ``text``; every other column is carried along."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([fails(x.as_py()) for x in batch.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], masks], [*kept, "mask"])

    return rows.mapInArrow(run, StructType([*rows.select(*kept).schema, *StructType.fromDDL("mask int")]))


def _refined(rows: DataFrame) -> DataFrame:
    """The rows that are not alone in their ``class`` when they have been split by length and by every block."""
    alive, turn = rows.withColumn("class", F.col("length")), 0
    while True:
        shared = alive.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("most")).filter("n > 1")
        shared = materialise(shared, "audit-classes")
        alive = materialise(alive.join(shared.select("class"), "class"), "audit-alive")
        most = shared.agg(F.max("most")).first()[0]
        if most is None or most <= turn:
            return alive
        block = F.get("blocks", F.lit(turn))
        alive = alive.withColumn("class", F.when(block.isNotNull(), _split(F.col("class"), block)).otherwise(F.col("class")))
        turn += 1


def marked_copies(docs: DataFrame, rows: DataFrame, part: str = "lang", bits: int = 64) -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of the rows whose text a smaller doc_id has; ``rows``: those of all documents."""
    alive = _refined(rows)
    classes = materialise(alive.groupBy("class").agg(F.count("*").alias("n")), "audit-survivors")
    wanted = F.broadcast(classes.select("class")) if classes.count() <= _BROADCAST_CLASSES else classes.select("class")
    texts = _read(docs, part, bits).withColumn("class", F.aggregate("blocks", F.col("length"), _split))
    whole = texts.join(wanted, "class").groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    whole = materialise(whole, "audit-texts")
    firsts = materialise(whole.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "audit-firsts")
    later = "first is not null and (doc_id is null or doc_id > first)"
    found = alive.join(firsts.filter("texts = 1"), "class").filter(later).select("doc_id", "part", "mask")
    # classes in which hashes clash: their documents go by the text itself
    clash = firsts.filter("texts > 1").select("class")
    unlike = texts.join(clash, "class").join(whole, ["class", "text"]).filter(later)
    return found.unionAll(_masked(unlike.select("doc_id", "part", "text")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", bits: int = 64) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents.

    ``kept`` after this step, ``removed`` here, ``redundant`` (fail this filter, removed before), ``unique_fails`` (fail no other), of the
    removed ``good_lost`` and ``toxic_lost`` by their labels, and ``shapley``: what the filter removes in all orders together.
    """
    rows = materialise(_masked(_read(docs, part, bits)), "audit-rows")
    copies = materialise(marked_copies(docs, rows, part, bits), "audit-copies")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = materialise(marks.agg(one("quality"), one("toxic")), "audit-labels")
    # a copy leaves the mask that it has without E for the one with it
    e = BIT["E"]
    of = lambda df, mask, k: df.select("doc_id", "part", mask.alias("mask"), F.lit(k).alias("k"))
    every = of(rows, F.col("mask"), 1).unionAll(of(copies, F.col("mask"), -1)).unionAll(of(copies, F.col("mask") + e, 1))
    sums = {"n": F.col("k").cast("bigint"), "good": F.col("k") * F.coalesce("quality", F.lit(0)), "bad": F.col("k") * F.coalesce("toxic", F.lit(0))}
    cells = every.join(marks, "doc_id", "left").groupBy("part", "mask").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    cells = materialise(cells, "audit-cells")  # 32 rows a part at most
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *sums)).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = packed.select("part", "cells", F.explode(orders).alias("filter_order")).select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bits_of = F.create_map(*[F.lit(x) for f in LETTERS for x in (f, BIT[f])])
    bit = lambda step: F.element_at(bits_of, F.substring("filter_order", step, F.lit(1)))
    own = bit(F.col("step"))
    earlier = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda i: i < F.col("step")), F.lit(0), lambda acc, i: acc.bitwiseOR(bit(i)))
    steps = steps.withColumns({"own": own, "earlier": earlier})

    def total(field: str, test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(test(c["mask"]), c[field]).otherwise(0))

    own, earlier = F.col("own"), F.col("earlier")
    here = lambda m: (m.bitwiseAND(earlier) == 0) & (m.bitwiseAND(own) != 0)
    out = steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(earlier) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("bad", here).alias("toxic_lost"),
        "own",
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "own")).alias("shapley")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
