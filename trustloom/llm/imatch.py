"""I-Match document fingerprints over randomised lexicon subsets, in Spark expressions only.

Terms are the distinct lower-case letter and digit runs of a text, as 64-bit hashes.
Document frequencies are counted exactly per term, over all documents (a map-side sum); the lexicon is the set of terms whose
inverse document frequency lies in the band, by default 2.5 to 5: in over 0.67 % and at most 8.2 % of the documents. The terms in the band, and the
common ones below it, go into the plan as constants. They are at most e**5 = 148 times as many as a document has terms on
average, whatever the corpus.

A term of the lexicon falls into one of 128 disjoint random subsets, in eight levels of
sixteen: a subset of level k holds a share of 2**-(k+1) / 16 of the lexicon. A
document's fingerprint is, per subset, four hex digits of the hash of its sorted terms in
it, ``0000`` if it has none. So two fingerprints tell in how many subsets of each level the texts have any term, and in how
many their terms differ. As a subset of share q misses all of D terms with probability exp(-q D), both counts have a most likely D: the number of
terms that either has, and the number that only one has. Likeness is what the second lacks of the first, so it does not depend
on how many terms fall into a subset.

Defined results: null text is the empty text; a text with fewer than ``LEAST`` terms of the lexicon takes others as well, up
to so many: first terms above the band, by their hash, then common ones, rarest first; so one term more or less changes one term. A text
without terms has only zeros; two fingerprints
of only zeros have likeness 1; repeated rows have equal fingerprints; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import materialise, text_of

#: Bits of a term's hash below those that choose its subset.
_LOW_BITS = 20
LEVELS, SLOTS = 8, 16
#: Terms that a fingerprint needs, if the text has as many; fewer do not tell texts apart.
LEAST = 16
#: Ranges of doc_id at most; their borders are constants of the plan.
_RANGES = 20_000
_NOT_A_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct term hashes."""
    words = F.filter(F.split(F.lower(text), _NOT_A_TERM), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


@dataclass(frozen=True)
class Lexicon:
    """``band``: the terms in the band; ``common``: those below it, rarest first."""

    band: list[int]
    common: list[int]

    def inside(self, term: Column) -> Column:
        """Whether a term is in the band."""
        return term.isin(self.band) if self.band else F.lit(False)

    def chosen(self, own: Column) -> Column:
        """The terms of a text (distinct) that are in the band and, up to ``LEAST``, others."""
        common = F.lit(self.common).cast("array<bigint>") if self.common else F.array().cast("array<bigint>")

        def filled(band: Column) -> Column:
            rare = F.array_sort(F.array_except(F.array_except(own, band), common))
            others = F.concat(rare, F.filter(common, lambda t: F.array_contains(own, t)))
            return F.when(F.size(band) >= LEAST, band).otherwise(F.concat(band, F.slice(others, F.lit(1), F.greatest(F.lit(0), LEAST - F.size(band)))))

        return _let(F.filter(own, self.inside), filled)


def lexicon(docs: DataFrame, low_idf: float = 2.5, high_idf: float = 5.0) -> Lexicon:
    """The terms with ``low_idf <= ln(documents / df) <= high_idf``."""
    df = docs.select(F.explode(terms(text_of())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(1, docs.count()))) / F.col("df"))
    told = df.filter(idf <= high_idf).withColumn("low", idf < low_idf)
    held = sorted((-r["df"], r["term"], r["low"]) for r in told.toLocalIterator())  # bounded as said above
    return Lexicon([t for _, t, low in held if not low], [t for _, t, low in reversed(held) if low])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprint(text: Column, held: Lexicon) -> Column:
    """The 512 hex digits of a text."""

    def digits(mine: Column) -> Column:
        digest = F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(mine), F.lit(65535)) + 1), 4, "0"))
        return F.when(F.size(mine) == 0, "0000").otherwise(digest)

    def slots(these: Column) -> Column:
        def slot(j: Column) -> Column:
            return _let(F.filter(these, lambda t: F.shiftrightunsigned(t, 40).bitwiseAND(F.lit(SLOTS - 1)) == j), digits)

        return F.array_join(F.transform(F.array(*[F.lit(j).cast("long") for j in range(SLOTS)]), slot), "")

    def level(found: Column, k: int) -> Column:
        mask, want = ((1 << (k + 1)) - 1) << _LOW_BITS, 1 << (k + _LOW_BITS)
        if k == LEVELS - 1:  # the last level takes what is left as well
            mask, want = ((1 << k) - 1) << _LOW_BITS, 0
        return _let(F.filter(found, lambda t: t.bitwiseAND(F.lit(mask)) == want), slots)

    return _let(terms(text), lambda own: _let(F.sort_array(held.chosen(own)), lambda found: F.concat(*[level(found, k) for k in range(LEVELS)])))


#: The share of the lexicon that a subset of each level holds; the last level takes what is left.
SHARES = [2.0 ** -min(k + 1, LEVELS - 1) / SLOTS for k in range(LEVELS)]


def _terms_behind(hits: Column) -> Column:
    """The most likely number of terms of which ``hits`` (one number a level) subsets hold any: the zero of the likelihood's slope, halved in on by
    its logarithm. More than 2**25 terms fill all subsets alike."""
    levels = F.arrays_zip(hits.alias("x"), F.array(*[F.lit(q) for q in SHARES]).alias("q"))

    def slope(d: Column) -> Column:
        one = lambda acc, s: acc + s["q"] * (s["x"] * (1 / (F.exp(s["q"] * d) - 1)) - (SLOTS - s["x"]))
        return F.aggregate(levels, F.lit(0.0), one)

    def halve(range_: Column, _) -> Column:
        middle = (range_["low"] + range_["high"]) / 2
        up = slope(F.pow(F.lit(2.0), middle)) > 0
        return F.struct(F.when(up, middle).otherwise(range_["low"]).alias("low"), F.when(up, range_["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.struct(F.lit(-3.0).alias("low"), F.lit(25.0).alias("high")), halve)
    return F.pow(F.lit(2.0), _let(found, lambda r: (r["low"] + r["high"]) / 2))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common terms of two fingerprints, from 0 to 1."""

    def level(k: Column) -> Column:
        pair = F.struct(F.substring(a, k * SLOTS * 4 + 1, F.lit(SLOTS * 4)).alias("a"), F.substring(b, k * SLOTS * 4 + 1, F.lit(SLOTS * 4)).alias("b"))

        def counted(p: Column) -> Column:
            slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: F.struct(F.substring(p["a"], j * 4 + 1, F.lit(4)).alias("a"), F.substring(p["b"], j * 4 + 1, F.lit(4)).alias("b")))
            any_ = lambda s: (s["a"] != "0000") | (s["b"] != "0000")
            both = lambda s: F.struct(F.size(F.filter(s, any_)).alias("any"), F.size(F.filter(s, lambda x: x["a"] != x["b"])).alias("unlike"))
            return _let(slots, both)

        return _let(pair, counted)

    def share(levels: Column) -> Column:
        unlike = F.transform(levels, lambda x: x["unlike"])
        estimate = 1 - _terms_behind(unlike) / _terms_behind(F.transform(levels, lambda x: x["any"]))
        return F.when(~F.exists(unlike, lambda x: x > 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level), share))


def _borders(docs: DataFrame, rows_per_range: int) -> np.ndarray:
    """Ids that cut the rows into ranges of about equal size: one per ``rows_per_range`` rows, and 20,000 at most, as a range is sorted
    with spills and may be large. They come from some 20 ids per range, as in Spark's own range partitioning, and
    only balance the ranges: any borders give the same result."""
    count = docs.count()
    ranges = max(1, min(count // rows_per_range, _RANGES))
    some = docs.filter("doc_id is not null").select("doc_id").sample(fraction=min(1.0, 20 * ranges / max(1, count)), seed=5)
    ids = np.sort(some.toArrow().column(0).to_numpy())
    return np.unique(ids[len(ids) * np.arange(1, ranges) // ranges]) if len(ids) else ids


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, rows_per_range: int = 2000) -> DataFrame:
    """Add ``next_<column>`` of the next row in ascending doc_id (null first, rows of
    equal doc_id in order of ``columns``); the first row follows the last. ``derived``: columns made of a row's others, which are
    computed once per row, after the shuffle.

    The ids are cut into ranges; each range is sorted by itself, and the first rows of the ranges, found by
    their ids, are joined to the ends. A row is shuffled once.
    """
    derived = derived or {}
    cuts = _borders(docs, rows_per_range)
    # two levels of borders, so that a row is compared with about 2 * sqrt(ranges) of them
    wide = max(1, int(len(cuts) ** 0.5))
    outer = F.size(F.filter(F.lit(cuts[wide::wide]), lambda x: x <= F.col("doc_id"))) if len(cuts) > wide else F.lit(0)
    inner = F.slice(F.lit(cuts), outer * wide + 1, F.lit(wide)) if len(cuts) else F.array().cast("array<bigint>")
    place = F.coalesce(outer * wide + F.size(F.filter(inner, lambda x: x <= F.col("doc_id"))), F.lit(0))
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place)
    ranged = docs.select("doc_id", *columns, place.alias("_range"))
    known = [*columns, *derived]

    starts = ranged.groupBy("_range").agg(F.min(F.struct("doc_id")).alias("_start")).select("_range", F.col("_start.doc_id").alias("_start"))
    starts = materialise(starts, "next-starts")
    heads = ranged.join(starts.select("_start"), ranged["doc_id"].eqNullSafe(starts["_start"]))
    heads = heads.groupBy("_range").agg(F.min(F.struct("doc_id", *columns)).alias("_first")).select("_range", "_first.*").withColumns(derived)
    heads = materialise(heads.select(F.col("_range").alias("_after"), F.struct(*known).alias("_first")), "next-heads")
    following = Window.orderBy("_range")  # one row per range
    after = F.coalesce(F.lead("_range").over(following), F.min("_range").over(Window.partitionBy()))
    ends = starts.select("_range", after.alias("_after")).join(heads, "_after").select("_range", "_first")

    inside = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), *columns)
    led = ranged.repartition("_range").withColumns(derived).withColumn("_next", F.lead(F.struct(*known)).over(inside))
    joined = led.join(ends, "_range").withColumn("_next", F.coalesce("_next", "_first"))
    return joined.select("doc_id", *known, *[F.col("_next")[c].alias(f"next_{c}") for c in known])
