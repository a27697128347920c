"""Lexical search, the filter audit and toxicity against brute force, on tables with awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustloom.llm import filter_audit, lexical, weak_supervision

DOCS = "doc_id long, text string, lang string, source string, score long, rank int, mask int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(n: int = 60) -> list[tuple]:
    r = random.Random(3)
    words = ["ab", "Ab", "cde", "é", "Éx", "f1", "zz9", "the", "the", "the", "of", "rare"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ".", "-x", "_y", "\t", " "]) for _ in range(r.choice([0, 1, 5, 40, 250]))) for _ in range(n)]
    texts += [None, "", " \n ", "#!?", "rare", "rare", "RARE rare", "the " * 20_000, texts[3], texts[3], texts[4]]
    rows = [(i, t, ["en", "fr", None, ""][i % 4], "s", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[3], "en", "s", 1, 2, 3), (None, "only this null id", None, "s", 1, 2, 3), (7, "another text of id 7", "fr", "s", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11 ranked lexical search

ITEMS = [(1, "the ab rare"), (1, "the ab rare"), (2, None), (3, "nowhere"), (4, "É zz9 zz9 F1; of"), (5, ""), (None, "cde"), (6, "ab"), (6, "cde the"), (7, "the")]


def brute_ranks(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t, *_ in docs]
    counts = [(i, c) for i, c in counts if c]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = Counter(w for t in {t for i, t in items if i == item} for w in TERM.findall(lower(t)))
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * big_n) // big_l
            s = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cells", "block"), [(1 << 24, 20_000), (200, 4)])
def test_ranks_are_those_of_brute_force(spark, docs, monkeypatch, cells, block):
    monkeypatch.setattr(lexical, "_CELLS", cells)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.rank_documents(docs, items, k=10, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_ranks(corpus(), ITEMS, 10)


def test_search_stops_before_the_lists_end():
    """Long lists of few common terms: the threshold ends the search, and what it leaves out can't be among the best."""
    r = np.random.default_rng(1)
    n, width = 20_000, 3
    tfs = r.integers(1, 200, (n, width))
    m = r.integers(30, 400, n)
    shard = lexical.Shard(m, np.arange(0, width * n + 1, width), np.tile(np.arange(width), n), tfs.ravel(), width)
    weights = np.array([900, 500, 700])
    found, scores = shard.search(np.arange(width), weights, 10, None)
    whole = (10**9 * tfs // (1000 * tfs + 8 * m[:, None])) @ weights
    assert sorted(scores)[-10:] == sorted(whole)[-10:]
    assert len(found) < n // 4
    again, _ = shard.search(np.arange(width), weights, 10, int(whole.max()) + 10**7)  # better ones are known from elsewhere
    assert len(again) < len(found)


def test_search_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(empty, items).collect() == []
    assert lexical.rank_documents(docs, items.filter("false")).collect() == []
    assert lexical.rank_documents(docs.filter("text is null"), items).collect() == []


# 12 filter interaction audit

LABELS = [(i, i % 2, None if i % 7 == 0 else int(i % 3 == 0)) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1), (999, 1, 1)]


def brute_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = [j for j, other, *_ in docs if (other or "") == t and j is not None and (i is None or j < i)]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(smaller)}
        good = i is not None and any(j == i and q == 1 for j, q, _ in labels)
        toxic = i is not None and any(j == i and x == 1 for j, _, x in labels)
        rows.append((lang or "", {f for f, b in bad.items() if b}, good, toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, made = [r for r in rows if r[0] == part], []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                made.append([part, order, step, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        total = Counter()
        for x in made:
            total[x[1][x[2] - 1]] += x[4]
        out += [(*x, total[x[1][x[2] - 1]]) for x in made]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 1])
def test_audit_is_that_of_brute_force(spark, docs, bits):
    """With hashes of one bit nearly every class holds different texts of one length; only their comparison tells them apart."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels, bits=bits)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute_audit(corpus(), LABELS)


def test_blocks_cover_every_text():
    assert all(at + n == following for (at, n), (following, _) in zip(filter_audit.BLOCKS, filter_audit.BLOCKS[1:]))
    assert sum(filter_audit.BLOCKS[-1]) > 1 << 29


def test_copies_that_differ_late(spark):
    """Equal lengths and first blocks, a difference in the last block only."""
    body = "word " * 3000
    rows = [(i, body + x, "en", "s", 1, 2, 3) for i, x in enumerate(["a", "b", "a", "c", "b", "a"])]
    docs = spark.createDataFrame(rows, DOCS)
    found = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD' and step = 1").first()
    assert (found["removed"], found["kept"], found["good_lost"]) == (3, 3, 0)


def test_audit_of_an_empty_table(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect() == []


# 13 toxicity


def toxic_corpus(n: int = 600) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(11)
    bad = ["grumph", "snorf", "blegh", "wuzzle"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(["an", "th", "er", "on", "re", "in"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "ing", "er"]))
        rows.append((i, " ".join(words), "en", "s", 1, 2, 3))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    rows += [(None, "grumph snorf you blegh wuzzle", None, None, 1, 2, 3), (n + 1, None, "en", "s", 1, 2, 3), (n + 2, "", "en", "s", 1, 2, 3), rows[0], (n + 3, "grumph " * 50_000, "en", "s", 1, 2, 3)]
    labels += [(0, 1, None), (3, None, 1), (None, 1, 1), (n + 1, 1, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_corpus()
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def scores(rows) -> np.ndarray:
    return np.array(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in rows))


def test_toxic_documents_are_found_where_no_label_was_learned(toxic):
    docs, labels, rows = toxic
    found = weak_supervision.score_toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    unseen = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and (r["held_out"] or r["doc_id"] % 3 == 1)]
    right = sum((r["doc_id"] % 6 == 0) == bool(r["predicted"]) for r in unseen)
    assert right >= 0.98 * len(unseen)
    assert by_id[None]["predicted"] == 1 and by_id[603]["predicted"] == 1
    assert by_id[601]["score"] == by_id[602]["score"] < 0.5
    again = weak_supervision.score_toxicity(docs.repartition(7), labels).collect()
    assert np.allclose(scores(found), scores(again), rtol=0, atol=1e-9)


def test_scores_use_no_labels_of_held_out_rows_and_no_other_columns(toxic):
    docs, labels, _ = toxic
    other = labels.withColumn("toxic", F.when(weak_supervision.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    changed = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    one, two = (scores(weak_supervision.score_toxicity(d, x).collect()) for d, x in ((docs, labels), (changed, other)))
    assert np.allclose(one, two, rtol=0, atol=1e-9)


def test_toxicity_without_labels(toxic, empty, spark):
    docs, labels, rows = toxic
    none = weak_supervision.score_toxicity(docs, labels.filter("false")).collect()
    assert len(none) == len(rows) and {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert weak_supervision.score_toxicity(empty, labels).collect() == []


def test_gram_counts_are_exact(spark):
    rows = [("Hello hello helm", 1), ("help", 0), ("", 0), ("hell-o", 1)]
    found = {r["gram"]: (r["n"], r["k"]) for r in weak_supervision.gram_counts(spark.createDataFrame(rows, "text string, toxic int").repartition(3)).collect()}
    assert found == {"hello": (1, 1), "hell*": (2, 2), "hello*": (1, 1), "helm": (1, 1), "helm*": (1, 1), "help": (1, 0), "help*": (1, 0), "hell": (1, 1), "o": (1, 1)}


def test_label_model_finds_accuracies_and_correlations():
    """Voters of known accuracy, two of them copies of a third but for noise: a model that took them as independent would be too sure."""
    r = np.random.default_rng(5)
    n = 40_000
    y = r.random(n) < 0.2
    rates = np.array([[0.05, 0.7], [0.1, 0.8], [0.02, 0.5], [0.15, 0.75], [0.1, 0.6], [0.2, 0.7]])
    cast = r.random((n, 6)) < np.where(y[:, None], rates[:, 1], rates[:, 0])
    copies = cast[:, [0, 0]] ^ (r.random((n, 2)) < 0.03)
    cast = np.hstack((cast, copies))
    patterns, weight = np.unique(cast, axis=0, return_counts=True)
    model = weak_supervision.fit_label_model(patterns, weight.astype(float), patterns.mean(axis=1))
    assert abs(model.prior - 0.2) < 0.03
    linked = {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0}
    assert sum(pair <= {0, 6, 7} for pair in linked) == 2  # the three are joined by two edges of the tree
    for c in (0, 1):
        truth = cast[y == bool(c)].mean(axis=0)
        fitted = model.posterior(cast) if c else 1 - model.posterior(cast)
        assert np.abs((fitted @ cast) / fitted.sum() - truth).max() < 0.04
    p = model.posterior(cast)
    assert abs(p[p > 0.5].mean() - y[p > 0.5].mean()) < 0.03  # as sure as it is right


def test_votes_follow_grams_and_density():
    names = ["bad", "worse", "evil*"]
    bits = np.array([[1, 0, 0], [0, 0, 0], [1, 1, 1]], bool)
    fired = weak_supervision.votes(bits, np.array([1, 0, 30]), np.array([1000, 50, 1000]), names)
    assert fired.shape == (3, weak_supervision.VOTERS)
    assert not fired[1].any()
    assert fired[0].sum() == 1 and fired[0, 0]
    assert fired[2, [0, 1, weak_supervision.LEXICONS]].all() and fired[2, -7:-1].all()


def test_features_of_batches_without_rows():
    none = pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["grams", "held", "words"])
    bits, held, words = weak_supervision._unpacked(none, 9)
    assert bits.shape == (0, 9) and len(held) == len(words) == 0
