"""I-Match against brute force: fingerprints digit by digit, and likeness against the true shares of common terms."""

from __future__ import annotations

import math
import random
import struct
from collections import Counter

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from trustloom.llm import imatch


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def term_hashes(text: str) -> set[int]:
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def chosen(own: set[int], df: Counter, n: int, low: float, high: float) -> set[int]:
    idf = {t: math.log(n / df[t]) if df[t] else math.inf for t in own}
    band = {t for t in own if low <= idf[t] <= high}
    rare = sorted(t for t in own if idf[t] > high)
    common = sorted(((df[t], -t) for t in own if idf[t] < low))
    return band | set([*rare, *[-t for _, t in common]][: max(0, imatch.LEAST - len(band))])


def brute_fingerprint(found: set[int]) -> str:
    out = []
    for k in range(imatch.LEVELS):
        for j in range(imatch.SLOTS):
            mine = []
            for t in sorted(found):
                low = t >> 20 & 0x7F
                level = min((low & -low).bit_length() - 1, imatch.LEVELS - 1) if low else imatch.LEVELS - 1
                if level == k and (t & (1 << 64) - 1) >> 40 & (imatch.SLOTS - 1) == j:
                    mine.append(t)
            h = 42
            for t in mine:
                h = xxhash.xxh64_intdigest(struct.pack("<q", t), h)
            out.append(f"{signed(h) % 65535 + 1:04x}" if mine else "0000")
    return "".join(out)


def corpus() -> list[str]:
    r = random.Random(8)
    common = [f"the{i}" for i in range(30)]
    rare = [f"w{i}é" for i in range(3000)]
    texts = [" ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(r.choice([0, 3, 12, 60, 400]))) for _ in range(150)]
    return [*texts, "", "The0 THE0, the0!", " ".join(common), " ".join(common[:15] + ["only"]), texts[3]]


def test_fingerprints_are_those_of_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df = Counter(t for x in texts for t in term_hashes(x))
    for low, high in ((2.5, 5.0), (1.5, 4.0), (0.5, 20.0)):
        held = imatch.lexicon(docs, low, high)
        found = {r["doc_id"]: r["f"] for r in docs.select("doc_id", imatch.fingerprint(F.col("text"), held).alias("f")).collect()}
        for i, x in enumerate(texts):
            assert found[i] == brute_fingerprint(chosen(term_hashes(x), df, len(texts), low, high)), (i, low, high)


def test_likeness_is_unbiased(spark):
    """Against the true share of common terms of the same lexicon: mean error under 0.02, root mean square error under 0.1."""
    r = random.Random(9)
    pool, rows = [f"w{k}" for k in range(3000)], []
    for i in range(600):
        n, share = r.choice([20, 60, 200, 700, 2000]), r.random()
        mine = r.sample(pool, n)
        both, rest = mine[: int(n * share)], mine[int(n * share) :]
        one, two = rest[::2], rest[1::2]
        rows.append((i, " ".join(both + one), " ".join(both + two), len(both) / n))
    held = imatch.lexicon(spark.createDataFrame([x for i, a, b, _ in rows for x in ((i, a), (i, b))], "doc_id int, text string"), 0.0, 50.0)
    frame = spark.createDataFrame(rows, "i int, a string, b string, due double")
    pair = [imatch.fingerprint(F.col(c), held) for c in "ab"]
    found = frame.select("due", pair[0].alias("a"), pair[1].alias("b")).select("due", imatch.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    error = np.array([x["l"] - x["due"] for x in found])
    assert abs(error.mean()) < 0.02 and (error**2).mean() ** 0.5 < 0.1
    assert all(0 <= x["l"] <= 1 for x in found)


def test_one_term_at_the_border_changes_little(spark):
    """A text with one lexicon term fewer than are needed differs from one with enough by that term, not by all its common ones."""
    fill = [(i, " ".join(f"c{k}" for k in range(40))) for i in range(300)]
    a, b = ([f"r{k}" for k in range(n)] + [f"c{k}" for k in range(40)] for n in (15, 16))
    docs = spark.createDataFrame([*fill, (900, " ".join(a)), (901, " ".join(b))], "doc_id long, text string")
    held = imatch.lexicon(docs)
    prints = {r["doc_id"]: r["f"] for r in docs.filter("doc_id >= 900").select("doc_id", imatch.fingerprint(F.col("text"), held).alias("f")).collect()}
    near = spark.createDataFrame([(prints[900], prints[901])], "a string, b string").select(imatch.likeness(F.col("a"), F.col("b")).alias("l")).first()["l"]
    assert near > 0.75  # 15 of 17 in truth
