"""Near-duplicates of a dataset: MinHash signatures, banded hashing, exact verification. Everything is a Spark expression.

Two texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. One hash of a shingle chooses a bin
and, as the least of its bin, is the bin's value (one-permutation MinHash); ``ROWS`` bins are a band, and texts that agree in a band
are candidates. A pair at the limit agrees in one of the bands with probability 1 - (1 - 0.8^5)^25, 0.99995, and a candidate is verified on the whole sets.

Texts of equal sets (by 128 bits of hash) are one class before that, so a group of copies of any size is one row. A row carries its 25 keys, not its set: the sets of those
that a pair names are made anew from their texts. What the report needs is whether a document has
a near-duplicate of smaller id. Sketches of 128 bytes tell nearly all pairs of similarity 0.5 and less from those at the limit within the join, before a set is looked at. The classes of a band are first held against the band's first class only, one pair a row; those which
that settles are done, and only the rest look through their bands. A band of many classes is cut into blocks of ``block`` there,
so no task holds it; the pairs of a band that are left are those of its unsettled classes, quadratic only in a family of texts that are alike but under the limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.columns import percent
from trustloom.sources.storage import materialise

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Words of a sketch, each of 16 bins of four bits, and the bits in which the sketches of texts at the limit may differ: 102 on average, five standard deviations of 14.7 more.
WORDS, APART = 16, 176


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once and not wherever it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The set of 64-bit hashes of the runs of ``n`` words (fewer words: of all of them; none: empty)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " "))))

    return _bound(words, hashes)


def band_keys(hashes: Column) -> Column:
    """A key for each band of the set that is not empty. The bin of a hash stands in its word's upper bits, so one sort brings the least of each bin to its front."""
    word = lambda h: F.shiftleft(F.pmod(h, F.lit(BANDS * ROWS)), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    bin_ = lambda x: F.shiftright(x, 56)
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(s, F.greatest(i - 1, F.lit(0))))))

    def keys(least: Column) -> Column:
        band = lambda b: F.filter(least, lambda x: F.floor(bin_(x) / ROWS) == b)
        key = lambda b: _bound(band(b), lambda xs: F.when(F.size(xs) > 0, F.xxhash64(b, xs)))
        return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key))

    return _bound(_bound(F.sort_array(F.transform(hashes, word)), first), keys)


def sketch(ordered: Column) -> Column:
    """256 bins, by the upper eight bits of the hashes, with four bits of the least hash of each; of the sorted set."""
    bin_ = lambda x: F.shiftrightunsigned(x, 56)
    least = F.filter(ordered, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(ordered, F.greatest(i - 1, F.lit(0))))))
    bits = lambda x: F.call_function("shiftleft", x.bitwiseAND(F.lit(15)), (bin_(x) % 16 * 4).cast("int"))

    def words(own: Column) -> Column:
        of = lambda j: F.filter(own, lambda x: F.shiftrightunsigned(x, 60) == j)
        return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda j: F.aggregate(of(j), F.lit(0).cast("long"), lambda w, x: w.bitwiseOR(bits(x))))

    return _bound(least, words)


def _may_be_alike(size_a: str, sketch_a: str, size_b: str, sketch_b: str) -> Column:
    """Sets of similarity 0.8 have such sizes, always, and such sketches but for one in a million."""
    sizes = 5 * F.least(size_a, size_b) >= 4 * F.greatest(size_a, size_b)
    apart = sum((F.bit_count(F.get(sketch_a, F.lit(j)).bitwiseXOR(F.get(sketch_b, F.lit(j)))) for j in range(WORDS)), F.lit(0))
    differing = (F.col(size_a) + F.col(size_b)) / 9  # elements of one set only, at most; each changes one bin at most, and two of its bits on average
    return sizes & (apart <= F.least(F.lit(float(APART)), 2 * differing + 5 * F.sqrt(differing)))


def _alike(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs ``a``, ``b`` (b < a) those of similarity 0.8 or more. Only the texts that are in a pair are read, and their sets made anew."""
    pairs = materialise(pairs.select("a", "b").distinct(), "near-pairs")
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = docs.select("doc_id", "text").join(asked, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", shingles(F.col("text")).alias("hashes"))
    sets = materialise(sets, "near-sets")
    of = lambda name: sets.select(F.col("doc_id").alias(name), F.col("hashes").alias(f"set_{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(9 * common >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def near_duplicates(docs: DataFrame, block: int = 256) -> DataFrame:
    """``doc_id`` and ``near_duplicate``: whether a document of smaller id is a copy or a near-duplicate. Texts without words are copies of each other."""
    rows = docs.select("doc_id", shingles(F.col("text")).alias("hashes"))
    of = _bound(F.sort_array("hashes"), lambda s: F.struct(F.xxhash64(s).alias("x"), F.xxhash64(F.lit(1), s).alias("y"), sketch(s).alias("sketch")))
    rows = rows.select("doc_id", F.size("hashes").alias("size"), of.alias("of"), band_keys(F.col("hashes")).alias("keys"))
    rows = materialise(rows.select("doc_id", "size", "of.x", "of.y", "of.sketch", "keys"), "near-rows")
    firsts = materialise(rows.groupBy("x", "y").agg(F.min("doc_id").alias("first")), "near-firsts")
    own = rows.withColumnRenamed("doc_id", "first").join(firsts, ["first", "x", "y"]).dropDuplicates(["first"])
    own = materialise(own.select("first", "size", "sketch", "keys"), "near-own")
    bands = materialise(own.select("first", F.explode("keys").alias("key")), "near-bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("lead")).filter("n > 1")
    shared = materialise(shared, "near-shared")
    met = materialise(bands.join(shared, "key"), "near-met")

    # one row of each pair, whose first members' sketches then come by id
    about = lambda name: own.select(F.col("first").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    alike = _may_be_alike("size_a", "sketch_a", "size_b", "sketch_b")
    leads = met.filter("first != lead").select(F.col("first").alias("a"), F.col("lead").alias("b")).distinct()
    leads = leads.join(about("a"), "a").join(about("b"), "b").filter(alike)
    settled = materialise(_alike(leads, docs), "near-settled")
    open_ = met.filter("first != lead").join(settled.select(F.col("a").alias("first")).distinct(), "first", "left_anti")
    # every block of a band's classes as partners; a class that looks for one is sent to each block of the bands that have such classes
    blocks = F.ceil(F.col("n") / block).cast("int")
    sought = met.join(open_.select("key").distinct(), "key", "left_semi")
    partners = sought.select("key", F.pmod(F.xxhash64("first"), blocks).cast("int").alias("block"), F.col("first").alias("b")).join(about("b"), "b")
    seekers = open_.select("key", blocks.alias("blocks"), F.col("first").alias("a"), "lead").join(about("a"), "a")
    seekers = seekers.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = (F.col("b") < F.col("a")) & (F.col("b") != F.col("lead")) & alike  # all of it is the join's own condition: other pairs are never rows
    more = materialise(_alike(seekers.join(partners, ["key", "block"]).filter(others), docs), "near-more")
    found = settled.unionAll(more).select(F.col("a").alias("first"), F.lit(True).alias("hit")).distinct()
    classes = firsts.join(found, "first", "left").select("x", "y", "first", F.col("hit").isNotNull().alias("hit"))
    flagged = rows.select("doc_id", "x", "y").join(classes, ["x", "y"])
    return flagged.select("doc_id", (F.col("hit") | (F.col("doc_id") != F.col("first"))).alias("near_duplicate"))


def duplicate_quality(flags: DataFrame, near: DataFrame) -> DataFrame:
    """label, count and percent of exact copies (``flags``: duplicate) and of copies and near-duplicates together."""
    one = lambda df, label, flag: df.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0)).alias("count")).select(F.lit(label).alias("label"), "count", percent(F.col("count"), F.col("total")).alias("percent"))
    return one(flags, "Duplicates", "duplicate").unionByName(one(near, "Duplicates and Near-Duplicates", "near_duplicate"))
