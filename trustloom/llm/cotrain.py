"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees a lexicon of informative words and the shape of the text; the metadata view sees the other columns
(length, and each language and source that a thousandth of the labelled sample has, by a weight of its own). Both are logistic models. Over rounds, each view scores all
unlabelled documents in Spark, and the other view also trains on those of which its calibrated probability is confident. A view
without signal is never confident and so teaches nothing. The final score joins the calibrated views, fitted on held-out
labelled rows. Every document is scored on its whole text.

Only the fit is bounded: it takes at most ``labelled_rows`` labelled rows, and of what each view is confident of at most
``taught_rows`` rows of each class, in both cases those of smallest hash. The features of all unlabelled documents are
written once (some 200 bytes a row), so that rounds don't read texts again; texts are never shuffled.

A document is good if its label says quality 1 and not toxic. ``score`` is the probability of good.

Defined results: null text is the empty text; null language or source is a value of its own; null ``n_chars`` is taken
as the length of the text; a toxic label is not good whatever its quality, other labels without quality are ignored, and of
several labels of one document the worst counts; without labels of both kinds every score is 0.5 and everything is
kept; repeated rows are scored each; an empty table gives no row; an input column named like an output is replaced,
others are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.llm.common import materialise, unpacked, whole_row

_TERM = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = "!|%$#&*@{}<>"
#: A language or source has a weight of its own if so large a share of the labelled sample has it.
_LEAST_SHARE = 0.001


def tokens_and_shape(text: str) -> tuple[set[str], list[float]]:
    """The distinct lower-case words, and numbers that describe the text's form."""
    terms = _TERM.findall(text.lower())
    distinct = set(terms)
    raw = text.encode("utf-8", "replace")
    n, words, lines = max(1, len(text)), text.split(), text.split("\n")
    size = max(1, len(words))
    shape = [
        np.log1p(len(words)),
        len(distinct) / max(1, len(terms)),
        len(set(words)) / size,
        len(set(lines)) / len(lines),
        sum(map(len, terms)) / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / n,
        (len(raw) - len(raw.translate(None, _DIGITS))) / n,
        len(terms) / size,
        sum(map(len, words)) / size,
        *[min(1.0, text.count(c) / size) for c in _MARKS],
    ]
    # squares and an interaction let the linear model bound a range
    return distinct, shape + [x * x for x in shape[:9]] + [shape[0] * shape[1]]


@dataclass
class Logistic:
    """Logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> Logistic:
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = ((x - mean) / scale).astype(np.float32)
    w, b = np.zeros(z.shape[1]), 0.0
    vw, vb, sw, sb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, steps + 1):  # Adam on the full sample
        gap = 1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32) + b, -30, 30))) - y
        gw, gb = z.T @ gap.astype(np.float32) / len(y) + penalty * w, gap.mean()
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        sw, sb = 0.99 * sw + 0.01 * gw * gw, 0.99 * sb + 0.01 * gb * gb
        rate, c1, c2 = 0.05, 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (vw / c1) / (np.sqrt(sw / c2) + 1e-8)
        b = b - rate * (vb / c1) / (np.sqrt(sb / c2) + 1e-8)
    return Logistic(mean, scale, w, b)


@dataclass
class CoTrained:
    lexicon: dict[str, int] = field(default_factory=dict)
    places: dict[tuple[str, str | None], int] = field(default_factory=dict)
    text_view: Logistic | None = None
    metadata_view: Logistic | None = None
    joint: Logistic | None = None

    def text_rows(self, found: list[tuple[set[str], list[float]]]) -> np.ndarray:
        words = np.zeros((len(found), len(self.lexicon)), np.float32)
        if not found:
            return words
        known = self.lexicon.keys()
        for row, (terms, _) in zip(words, found):
            row[[self.lexicon[t] for t in known & terms]] = 1
        return np.hstack((np.array([s for _, s in found], np.float32), words))

    def text_rows_of_bits(self, bits: list[bytes], shape: list[list[float]]) -> np.ndarray:
        """The same from packed bits of the lexicon's words."""
        rows = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -(-len(self.lexicon) // 8))
        words = np.unpackbits(rows, axis=1)[:, : len(self.lexicon)].astype(np.float32)
        return np.hstack((np.array(shape, np.float32), words)) if bits else words

    def metadata_rows(self, rows: list[tuple]) -> np.ndarray:
        """``rows``: (lang, source, n_chars)."""
        out = np.zeros((len(rows), len(self.places) + 2), np.float32)
        for x, (lang, source, n_chars) in zip(out, rows):
            x[0] = np.log1p(max(0, n_chars or 0))
            x[1] = x[0] ** 2
            for value in (("lang", lang), ("source", source)):
                if value in self.places:
                    x[2 + self.places[value]] = 1
        return out

    def score(self, found: list[tuple[set[str], list[float]]], rows: list[tuple]) -> np.ndarray:
        """Columns: score, text view, metadata view."""
        if self.joint is None:
            return np.full((len(found), 3), 0.5)
        t, m = self.text_view.logit(self.text_rows(found)), self.metadata_view.logit(self.metadata_rows(rows))
        return 1 / (1 + np.exp(-np.stack((self.joint.logit(np.stack((t, m), 1)), t, m), 1)))


def informative_terms(sample: DataFrame, size: int) -> dict[str, int]:
    """The words whose presence says most about the label, by chi-square. ``sample``: good, terms."""
    totals = sample.agg(F.count("*").alias("n"), F.avg("good").alias("share")).first()
    n, share = totals["n"], totals["share"] or 0.0
    counts = sample.select("good", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("good").alias("g"))
    gain = (F.col("g") - F.col("c") * share) ** 2 / (F.col("c") * max(1e-9, share * (1 - share))) * (1 - F.col("c") / max(1, n))
    best = counts.filter((F.col("c") >= 3) & (F.col("c") < n)).select("term", F.round(gain, 9).alias("gain"))
    return {r["term"]: i for i, r in enumerate(best.orderBy(F.desc("gain"), "term").limit(size).collect())}


def metadata_values(sample: DataFrame) -> dict[tuple[str, str | None], int]:
    """A column for each language and source that ``_LEAST_SHARE`` of the sample has: a thousand of either at most."""
    least, found = max(3, ceil(_LEAST_SHARE * sample.count())), []
    for column in ("lang", "source"):
        rows = sample.groupBy(column).count().filter(F.col("count") >= least).select(column).collect()
        found += sorted(((column, r[0]) for r in rows), key=lambda x: (x[1] is not None, x[1] or ""))
    return {value: i for i, value in enumerate(found)}


def _calibrated(view: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    return fit_logistic(view.logit(x)[:, None], y, steps=200)


def _good(labels: DataFrame) -> DataFrame:
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | toxic))
    return known.groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & ~toxic).cast("int").alias("good"))


def _described(docs: DataFrame, *keep: str, lexicon: dict[str, int] | None = None) -> DataFrame:
    """``keep``, lang, source, n_chars, and the ``terms`` (with a lexicon, a bit for each of its words) and ``shape`` of each text."""
    kept = [*keep, "lang", "source", "n_chars"]

    def bits(terms: set[str]) -> bytes:
        row = np.zeros(len(lexicon), np.uint8)
        row[[lexicon[t] for t in lexicon.keys() & terms]] = 1
        return np.packbits(row).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [tokens_and_shape(t.as_py()) for t in batch.column("text")]
                terms = pa.array([sorted(t) for t, _ in found], pa.list_(pa.string())) if lexicon is None else pa.array([bits(t) for t, _ in found], pa.binary())
                columns = [batch.column(c) for c in kept] + [terms, pa.array([s for _, s in found], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "terms", "shape"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    made = StructType.fromDDL(f"terms {'array<string>' if lexicon is None else 'binary'}, shape array<float>")
    return docs.mapInArrow(run, StructType([*docs.select(*kept).schema, *made]))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = 12_000, taught_rows: int = 2_000, lexicon_size: int = 400, rounds: int = 3, confident: float = 0.97) -> CoTrained:
    """Fit on at most ``labelled_rows`` labelled documents, the smallest by a hash of their id, and on at most ``taught_rows`` of each
    class that each view teaches the other; only their rows of features come to the driver."""
    marks = _good(labels)
    order = F.xxhash64("doc_id", F.lit(9))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    chosen = ids.join(marks, "doc_id").orderBy(order, "doc_id").limit(labelled_rows)
    chosen = materialise(chosen, "quality-sample")
    # at most labelled_rows ids and marks are broadcast
    sample = _inputs(docs).join(F.broadcast(chosen), "doc_id")
    # one row of each document, however often it is repeated
    sample = sample.groupBy("doc_id", "good").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")).select("doc_id", "good", "row.*")
    sample = _described(sample, "doc_id", "good").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(4)) == 0)
    sample = materialise(sample, "quality-described")
    fitting = sample.filter("not held")
    model = CoTrained(lexicon=informative_terms(fitting, lexicon_size), places=metadata_values(fitting))

    def features(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
        got = rows.toArrow().to_pylist()
        got.sort(key=lambda r: (r["doc_id"], r["n_chars"], r["shape"]))
        terms, shape = [r["terms"] for r in got], [r["shape"] for r in got]
        text = model.text_rows_of_bits(terms, shape) if "says" in rows.columns else model.text_rows([(set(t), s) for t, s in zip(terms, shape)])
        return got, text, model.metadata_rows([(r["lang"], r["source"], r["n_chars"]) for r in got])

    got, *views = features(sample.withColumn("terms", F.array_intersect("terms", F.lit(list(model.lexicon)).cast("array<string>"))))
    y, held = np.array([r["good"] for r in got], float), np.array([r["held"] for r in got], bool)
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return model
    unlabelled = materialise(_unlabelled(docs, marks, model), "quality-unlabelled")
    taught: list[tuple] = [(None, None), (None, None)]
    for turn in range(rounds):
        fitted = []
        for x, (more, what) in zip(views, taught):
            own = (x[~held], y[~held])
            fitted.append(fit_logistic(*own) if more is None else fit_logistic(np.concatenate((own[0], more)), np.concatenate((own[1], what))))
        model.text_view, model.metadata_view = fitted
        if turn == rounds - 1:
            break
        scales = [_calibrated(f, x[held], y[held]) for f, x in zip(fitted, views)]
        sure = materialise(_confident(unlabelled, model, scales, confident), "quality-confident")
        for k, other in ((0, 1), (1, 0)):  # each view learns from the other
            says = F.col("says")[other]
            parts = [sure.filter(says == c).orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "n_chars").limit(taught_rows) for c in (0, 1)]
            rows, *found = features(parts[0].unionAll(parts[1]))
            if rows:
                taught[k] = (found[k], np.array([r["says"][other] for r in rows], float))
            else:
                taught[k] = (None, None)
    logits = np.stack([f.logit(x[held]) for f, x in zip(fitted, views)], 1)
    model.joint = fit_logistic(logits, y[held], steps=300)
    return model


def _unlabelled(docs: DataFrame, marks: DataFrame, model: CoTrained) -> DataFrame:
    """Features of all documents without a label: their words of the lexicon, shape and metadata."""
    known = _inputs(docs).filter("doc_id is not null")
    described = _described(known, "doc_id", lexicon=dict(model.lexicon))
    return described.join(marks.select("doc_id"), "doc_id", "left_anti")  # features are joined, not texts


_FEATURES = "doc_id bigint, lang string, source string, n_chars bigint, terms binary, shape array<float>"


def _confident(unlabelled: DataFrame, model: CoTrained, scales: list[Logistic], confident: float) -> DataFrame:
    """The rows of which a view is confident; ``says``: the class that the text view and the metadata view give, or null."""
    spark = unlabelled.sparkSession
    held = spark.sparkContext.broadcast((model, scales))  # a few hundred words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scales = held.value
        for batch in (b for b in batches if b.num_rows):
            text = model.text_rows_of_bits(batch.column("terms").to_pylist(), batch.column("shape").to_pylist())
            metadata = model.metadata_rows(list(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))))
            says = []
            for view, scale, x in zip((model.text_view, model.metadata_view), scales, (text, metadata)):
                p = 1 / (1 + np.exp(-scale.logit(view.logit(x)[:, None])))
                says.append([int(v > 0.5) if v >= confident or v <= 1 - confident else None for v in p])
            pairs = [list(s) for s in zip(*says)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(pairs, pa.list_(pa.int32()))], [*batch.schema.names, "says"])
            yield out.filter(pa.array([s != [None, None] for s in pairs], pa.bool_()))

    return unlabelled.mapInArrow(run, f"{_FEATURES}, says array<int>")


def _inputs(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.col("n_chars"), F.length(text)).cast("bigint").alias("n_chars"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample: int) -> DataFrame:
    """All columns of ``docs`` and ``score``, ``text_score``, ``metadata_score`` and ``keep`` (score >= threshold)."""
    added = ("score", "text_score", "metadata_score", "keep")
    docs = docs.drop(*added)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **sample))  # a few hundred words and weights
    row = docs.select(whole_row(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).column(0)
                texts = [t.as_py() or "" for t in part.field("text")]
                rows = [
                    (lang, source, len(t) if n is None else n)
                    for lang, source, n, t in zip(*(part.field(c).to_pylist() for c in ("lang", "source", "n_chars")), texts)
                ]
                scores = model.value.score([tokens_and_shape(t) for t in texts], rows)
                columns = [part] + [pa.array(scores[:, i], pa.float64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores[:, 0] >= threshold)], ["row", *added])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    schema = StructType([*row.schema, *StructType.fromDDL("score double, text_score double, metadata_score double, keep boolean")])
    return unpacked(row.mapInArrow(run, schema), "row", docs.columns, *added)
