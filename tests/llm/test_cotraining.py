"""Co-training against the same rules written plainly: one list of rows, no Spark."""

from __future__ import annotations

import random
import struct
from collections import Counter
from math import ceil

import numpy as np
import xxhash

from trustloom.llm.cotrain import fit_logistic, score_quality, tokens_and_shape


def spark_hash(doc_id: int, salt: int) -> int:
    h = xxhash.xxh64_intdigest(struct.pack("<i", salt), xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42))
    return h - (1 << 64) if h >> 63 else h


def tables():
    r = random.Random(21)
    good_words, bad_words, plain = ["fine", "clear", "useful"], ["junk", "spam"], [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs, labels = [], []
    for i in range(900):
        good = r.random() < 0.6
        words = [r.choice(plain) for _ in range(r.randint(10, 60))] + [r.choice(good_words if good else bad_words) for _ in range(r.choice([0, 1, 2, 4]))]
        r.shuffle(words)
        text = " ".join(words)
        source = r.choice(["s1", "s2", None]) if good else r.choice(["s2", "s3", "s4"])
        docs.append((i, text, r.choice(["en", "fr"]), source, len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


def plain_scores(docs, labels, rounds=3, confident=0.97) -> dict[int, list[float]]:
    mark = {i: q for i, q, _ in labels}
    described = {d[0]: tokens_and_shape(d[1]) for d in docs}
    by_id = {d[0]: d for d in docs}
    known = sorted(mark)
    held = {i: spark_hash(i, 10) % 4 == 0 for i in known}
    fitting = [i for i in known if not held[i]]
    share, n = np.mean([mark[i] for i in fitting]), len(fitting)
    c, g = Counter(), Counter()
    for i in fitting:
        c.update(described[i][0])
        if mark[i]:
            g.update(described[i][0])
    gain = {t: round((g[t] - c[t] * share) ** 2 / (c[t] * share * (1 - share)) * (1 - c[t] / n), 9) for t in c if 3 <= c[t] < n}
    lexicon = sorted(gain, key=lambda t: (-gain[t], t))[:400]
    places = []
    for column in (2, 3):
        values = Counter(by_id[i][column] for i in fitting)
        places += [(column, v) for v in sorted((v for v in values if values[v] >= max(3, ceil(0.001 * n))), key=lambda v: (v is not None, v or ""))]

    def text_row(i):
        return described[i][1] + [float(t in described[i][0]) for t in lexicon]

    def metadata_row(i):
        size = np.log1p(by_id[i][4])
        return [size, size**2] + [float(by_id[i][column] == v) for column, v in places]

    rows = [lambda ids: np.array([text_row(i) for i in ids], np.float32), lambda ids: np.array([metadata_row(i) for i in ids], np.float32)]
    rest = sorted(set(by_id) - set(mark))
    y, test = np.array([mark[i] for i in fitting], float), [i for i in known if held[i]]
    y_test = np.array([mark[i] for i in test], float)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    taught = [[], []]
    for turn in range(rounds):
        views = [fit_logistic(np.concatenate((make(fitting), make([i for i, _ in more]))) if more else make(fitting), np.concatenate((y, [v for _, v in more]))) for make, more in zip(rows, taught)]
        if turn == rounds - 1:
            break
        says = []
        for view, make in zip(views, rows):
            scale = fit_logistic(view.logit(make(test))[:, None], y_test, steps=200)
            p = sigmoid(scale.logit(view.logit(make(rest))[:, None]))
            says.append([(i, float(v > 0.5)) for i, v in zip(rest, p) if v >= confident or v <= 1 - confident])
        taught = [says[1], says[0]]
    joint = fit_logistic(np.stack([v.logit(make(test)) for v, make in zip(views, rows)], 1), y_test, steps=300)
    everyone = sorted(by_id)
    logits = np.stack([v.logit(make(everyone)) for v, make in zip(views, rows)], 1)
    return {i: [s, *x] for i, s, x in zip(everyone, sigmoid(joint.logit(logits)), sigmoid(logits))}, sum(map(len, taught))


def test_scores_are_those_of_plain_cotraining(spark):
    docs, labels = tables()
    due, taught = plain_scores(docs, labels)
    assert taught > 50  # the views do teach each other here
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = score_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = np.array([[r["score"], r["text_score"], r["metadata_score"]] for r in sorted(found, key=lambda r: r["doc_id"])])
    want = np.array([due[i] for i in sorted(due)])
    assert np.abs(got - want).max() < 0.02 and np.abs(got - want).mean() < 1e-3
