"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

*Voters.* Words, and beginnings of words (patterns that catch inflections), that stand out in the toxic ones of the labelled
texts are ranked by their likelihood ratio and dealt to lexicon voters and pattern voters; further voters look at how many different
ones a text holds and how densely. A voter fires or does not.

*Label model.* All documents' votes are counted in Spark by pattern: with 16 voters there are at most 65,536 patterns, whatever the
number of documents. A latent class model is fitted on the counts by expectation and maximisation: how often each voter fires in either class
(its accuracy) and, since voters that share words fire together, a tree of dependences, in which each voter depends on the class and on
the voter with which it has most information in common beyond the class (its correlations). The labelled rows anchor the classes: they weigh as
much as all documents together.

*Classifier.* A logistic model on the words, patterns and their density is fitted to the posterior labels of a bounded sample and scores every
whole text. Labels, language, source and doc_id are no inputs.

Bounded are only the rows that voters and classifier are fitted on, at most ``labelled_rows`` labelled ones of smallest hash;
the label model counts all documents, and all are scored.

Defined results: null text is the empty text, which holds no word; held out is a row by its doc_id alone, a null one too; of several labels of a
document any 1 counts, and null ones none; equal texts count once in the choice of words; without labels of both kinds nothing can be learned
and every score is 0; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import materialise, text_of
from trustloom.llm.cotrain import Logistic, fit_logistic

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6, 7)
LEXICONS, PATTERNS = 5, 4
#: Words that hold a gram, of a thousand words, from which a density voter fires.
DENSITIES = (3, 6, 10, 15)
VOTERS = LEXICONS + PATTERNS + len(DENSITIES) + 3
_CACHE = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def grams(word: str) -> list[str]:
    """The word, and its beginnings (marked by a star) where it is longer."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def gram_counts(sample: DataFrame) -> DataFrame:
    """``gram``, and in how many texts of the sample (``text``, ``toxic``) it occurs (``n``) and how many of those are toxic (``k``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(n)
            out = [pa.array(names, pa.string()), pa.array([n[g] for g in names], pa.int64()), pa.array([k[g] for g in names], pa.int64())]
            n.clear()
            k.clear()
            return pa.RecordBatch.from_arrays(out, ["gram", "n", "k"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = {g for w in words_of(text.as_py()) for g in grams(w)}
                n.update(found)
                if toxic:
                    k.update(found)
                if len(n) > _CACHE:
                    yield counted()
        yield counted()

    parts = sample.select("text", "toxic").mapInArrow(run, "gram string, n bigint, k bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def telling_grams(sample: DataFrame, size: int, least: float = 15.0) -> list[str]:
    """At most ``size`` words and as many beginnings, those of greatest likelihood ratio for toxic texts, greatest first; ties by name.

    A beginning is left out if it says no more than a chosen word of it, as all its texts hold that word.
    """
    n, k = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not k or k == n:
        return []
    share = k / n
    hit, miss = F.col("k"), F.col("n") - F.col("k")
    term = lambda seen, p: F.when(seen > 0, seen * F.log(seen / (F.col("n") * p))).otherwise(0.0)
    rows = materialise(gram_counts(sample), "toxicity-grams").filter((hit >= 3) & (hit > 0.6 * F.col("n")))
    rows = rows.withColumn("ratio", F.round(2 * (term(hit, share) + term(miss, 1 - share)), 6)).filter(F.col("ratio") >= least)
    best = lambda stem: rows.filter(F.endswith("gram", F.lit("*")) == F.lit(stem)).orderBy(F.desc("ratio"), "gram").limit(size).collect()
    chosen = sorted(best(False) + best(True), key=lambda r: (-r["ratio"], r["gram"].endswith("*"), r["gram"]))
    seen = {(w[:i], r["n"], r["k"]) for r in chosen for w in [r["gram"]] if w[-1] != "*" for i in STEMS}
    return [r["gram"] for r in chosen if r["gram"][-1] != "*" or (r["gram"][:-1], r["n"], r["k"]) not in seen]


@dataclass
class Reader:
    """Turns texts into rows of features: a column for each gram, then the shape of the hits."""

    names: list[str]
    known: dict[str, int] = field(default_factory=dict)
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.known = {g: i for i, g in enumerate(self.names)}

    def hits(self, text: str) -> tuple[set[int], int, int]:
        """The grams of the text, how many of its words hold one, and its words."""
        found, held = set(), 0
        words = words_of(text)
        for word, times in words.items():
            ids = self.cache.get(word)
            if ids is None:
                ids = tuple(self.known[g] for g in grams(word) if g in self.known)
                if len(self.cache) > _CACHE:
                    self.cache.clear()
                self.cache[word] = ids
            if ids:
                found.update(ids)
                held += times
        return found, held, sum(words.values())


def votes(bits: np.ndarray, held: np.ndarray, words: np.ndarray, names: list[str]) -> np.ndarray:
    """A row of 16 booleans for each row of grams: lexicons, patterns, and voters on density and number."""
    stems = np.array([g[-1] == "*" for g in names], bool)
    out = np.zeros((len(bits), VOTERS), bool)
    for first, kinds, columns in ((0, LEXICONS, np.flatnonzero(~stems)), (LEXICONS, PATTERNS, np.flatnonzero(stems))):
        for v in range(kinds):  # dealt by rank, so that voters are about equally good
            out[:, first + v] = bits[:, columns[v::kinds]].any(axis=1)
    rest = [held * 1000 >= d * words for d in DENSITIES] + [held >= 2, held >= 4, bits.sum(axis=1) >= 4]
    out[:, LEXICONS + PATTERNS :] = np.stack(rest, 1) & (held > 0)[:, None]
    return out


@dataclass
class LabelModel:
    """Two classes; each voter depends on the class and on its ``parent`` (-1: on the class alone)."""

    prior: float
    parent: list[int]
    fires: np.ndarray  # by class, value of the parent, voter

    def log_likelihood(self, votes: np.ndarray) -> np.ndarray:
        """Of each row of votes in either class."""
        above = np.stack([votes[:, p] if p >= 0 else np.zeros(len(votes), bool) for p in self.parent], 1).astype(int)
        out = np.zeros((len(votes), 2))
        for c in (0, 1):
            p = self.fires[c][above, np.arange(votes.shape[1])]
            out[:, c] = np.log(np.where(votes, p, 1 - p)).sum(axis=1) + np.log(self.prior if c else 1 - self.prior)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        both = self.log_likelihood(votes)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


def _fires(votes: np.ndarray, mass: np.ndarray, parent: list[int]) -> np.ndarray:
    """``mass``: of each row of votes in either class."""
    out = np.zeros((2, 2, votes.shape[1]))
    for c in (0, 1):
        for j, up in enumerate(parent):
            for value in (0, 1):
                use = votes[:, up] == bool(value) if up >= 0 else np.ones(len(votes), bool)
                out[c, value, j] = (mass[use, c] @ votes[use, j] + 0.5) / (mass[use, c].sum() + 1)
    return out


def _tree(votes: np.ndarray, mass: np.ndarray, least: float = 1e-3) -> list[int]:
    """The spanning forest of greatest mutual information between voters, given the class; weaker dependences are left out."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for own in mass.T:
        share = max(1e-12, own.sum())
        one = (own @ votes) / share
        both = (votes * own[:, None]).T @ votes.astype(float) / share
        for a, b, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None, :] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both)):
            joint = np.clip(joint, 1e-12, 1)
            info += share / mass.sum() * joint * np.log(joint / np.clip(np.outer(a, b), 1e-12, 1))
    parent, inside = [-1] * m, {0}
    while len(inside) < m:
        j, up = max(((j, i) for i in inside for j in range(m) if j not in inside), key=lambda x: (info[x[1], x[0]], -x[0], -x[1]))
        parent[j] = up if info[up, j] >= least else -1
        inside.add(j)
    return parent


def _fitted(votes: np.ndarray, mass: np.ndarray, parent: list[int]) -> LabelModel:
    return LabelModel(float(np.clip(mass[:, 1].sum() / mass.sum(), 1e-4, 0.5)), parent, _fires(votes, mass, parent))


def fit_label_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, known: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
    """``votes``: the patterns; ``weight``: how many documents have each; ``known``: how many labelled rows of either class have each.

    The labelled rows give the first model and weigh as much as all documents in each round, so the classes stay those
    of the labels. Without any, ``start`` is a first guess of each pattern's probability of toxic.
    """
    if known is not None:
        known = known * (weight.sum() / known.sum())
        p = _fitted(votes, known, _tree(votes, known)).posterior(votes)
    else:
        p, known = np.clip(start, 0.02, 0.98), 0
    for turn in range(rounds):
        mass = weight[:, None] * np.stack((1 - p, p), 1) + known
        if turn % 10 == 0:  # what voters have in common beyond the class, as it is known by now
            parent = _tree(votes, mass)
        model = _fitted(votes, mass, parent)
        p = model.posterior(votes)
    return model


@dataclass
class Toxicity:
    names: list[str]
    labels: LabelModel | None = None
    linear: Logistic | None = None

    def inputs(self, bits: np.ndarray, held: np.ndarray, words: np.ndarray) -> np.ndarray:
        share = 1000 * held / np.maximum(1, words)
        shape = [held > 0, held > 1, np.log1p(held), np.log1p(share), *[np.minimum(1, share / d) for d in DENSITIES], *[share >= d for d in DENSITIES]]
        return np.hstack((bits, np.stack(shape, 1))).astype(np.float32)

    def score(self, *features: np.ndarray) -> np.ndarray:
        if self.linear is None:
            return np.zeros(len(features[0]))
        return 1 / (1 + np.exp(-self.linear.logit(self.inputs(*features))))


def _features(rows: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """``keep``, the packed bits of the grams in ``text``, how many words hold one, and the words."""
    width = len(names)
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(names)
        for batch in batches:
            bits, held, words = np.zeros((batch.num_rows, width), bool), [], []
            for row, text in zip(bits, batch.column("text")):
                found, h, w = reader.hits(text.as_py())
                row[list(found)] = True
                held.append(h)
                words.append(w)
            packed = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)] if width else [b""] * batch.num_rows, pa.binary())
            columns = [batch.column(c) for c in keep] + [packed, pa.array(held, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "grams", "held", "words"])

    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, grams binary, held bigint, words bigint")


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.uint8).reshape(batch.num_rows, -(-width // 8))
    return np.unpackbits(raw, axis=1)[:, :width].astype(bool), batch.column("held").to_numpy(), batch.column("words").to_numpy()


def _patterns(features: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of votes among all rows and how many have each: 65,536 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fired = votes(*_unpacked(batch, len(names)), names) @ (1 << np.arange(VOTERS))
                found, n = np.unique(fired, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["votes", "n"])

    counted = features.select("grams", "held", "words").mapInArrow(run, "votes bigint, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    found = np.array([r["votes"] for r in counted], np.int64)
    return (found[:, None] >> np.arange(VOTERS) & 1).astype(bool), np.array([r["n"] for r in counted], float)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = 20_000, grams_of_each: int = 128) -> tuple[Toxicity, DataFrame]:
    """The fitted classifier, and the features of all documents."""
    own = F.col("doc_id").cast("bigint").alias("doc_id")
    marks = labels.filter("doc_id is not null and toxic is not null").select(own, "toxic").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(13))
    chosen = docs.select(own).distinct().join(marks, "doc_id").orderBy(order, "doc_id").limit(labelled_rows)
    chosen = materialise(chosen, "toxicity-chosen")
    # at most labelled_rows ids are broadcast; of equal texts one is kept
    sample = _texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = materialise(sample, "toxicity-sample")
    model = Toxicity(telling_grams(sample, grams_of_each))
    features = materialise(_features(_texts(docs), model.names, "doc_id"), "toxicity-features")
    if not model.names:
        return model, features
    patterns, weight = _patterns(features, model.names)
    known = _features(sample, model.names, "toxic").toArrow()  # the sample's features
    known = known.combine_chunks().to_batches()[0]
    order = np.lexsort((known.column("words").to_numpy(), known.column("held").to_numpy(), np.array(known.column("grams").to_pylist(), dtype=object)))
    known = known.take(pa.array(order))  # the order of the rows is that of their contents, so reruns agree
    own = _unpacked(known, len(model.names))
    y = known.column("toxic").to_numpy()
    cast = votes(*own, model.names)
    place = {x: i for i, x in enumerate((patterns @ (1 << np.arange(VOTERS))).tolist())}
    known_counts = np.zeros((len(patterns), 2))
    np.add.at(known_counts, ([place[x] for x in (cast @ (1 << np.arange(VOTERS))).tolist()], y), 1)
    model.labels = fit_label_model(patterns, weight, known=known_counts)
    p = model.labels.posterior(cast)
    if p.min() < 0.5 <= p.max():
        model.linear = fit_logistic(model.inputs(*own), p, penalty=3e-3)
    return model, features


def score_toxicity(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model, features = train(docs, labels, **sample)
    held = docs.sparkSession.sparkContext.broadcast(model)  # some hundred words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = held.value.score(*_unpacked(batch, len(held.value.names)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
