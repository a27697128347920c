"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string"


def sentence(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["an", "th", "er", "on", "re", "é", "Ti"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, short, empty and null texts, a long one, a repeated row, clashing columns."""
    base, passage = sentence(1, 130), sentence(2, 70)
    texts = [" ".join(base), " ".join(base), None, "", " \n\t ", "One", "one", "x y", " ".join([*base[:60], "changed", *base[61:]])]
    texts += [" ".join([*sentence(10 + i, 20), *passage, *sentence(30 + i, 15)]) for i in range(4)]
    texts += [" ".join(["same"] * 400), " ".join(["same"] * 300), " ".join(sentence(5, 9)) + "  double\n\nline ", " ".join(sentence(50, 9000))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 7, "h") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, " ".join(base), "en", "s1", 3, 7, "h")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


# 1 SimHash


def brute_fingerprint(text: str | None, n: int = 3) -> int:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, empty):
    from trustloom.llm.simhash import simhash_components

    got = simhash_components(docs).collect()
    fps = [(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got]
    assert sorted(fps, key=repr) == sorted([(r[0], brute_fingerprint(r[1])) for r in corpus()], key=repr)
    parent = {f: f for _, f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    for r in got:
        same = [d for d, f in fps if root(f) == root(r["fp"] & (1 << 64) - 1) and d is not None]
        assert r["component_id"] == min(same)
    assert simhash_components(empty).collect() == []


def test_ball_links_connect_all_within_two_bits(spark):
    from trustloom.llm.components import connected_components
    from trustloom.llm.simhash import ball_links

    r = random.Random(3)
    values = {r.getrandbits(12) - (1 << 63) for _ in range(150)} | {0, -1, 1, 3, 7, 1 << 62}
    links = ball_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    found = {x["node"]: x["component"] for x in connected_components(links).collect()}
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(found.get(v, v) == root(v) for v in values)


def test_components_of_a_long_chain(spark):
    from trustloom.llm.components import connected_components

    order = list(range(300))
    random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_near_duplicates_by_similarity(spark):
    from trustloom.llm.simhash import near_duplicates

    base = sentence(7, 300)
    near = [w if i not in (40, 120, 200) else "new" for i, w in enumerate(base)]  # 0.9
    far = [w if i % 20 else "new" for i, w in enumerate(base)]  # under 0.8
    rows = [(3, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (1, " ".join(far)), (4, " ".join(sentence(8, 300))), (5, None), (6, ""), (None, "x")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 2, 2: 2, 9: 2, 1: 1, 4: 4, 5: 5, 6: 5}


def test_near_duplicates_by_sets_of_shingles(spark):
    from trustloom.llm.simhash import near_duplicates

    filler = ["0"] * 500  # one shingle that outweighs all others
    base = sentence(60, 300)
    rows = [(1, " ".join([*sentence(61, 100), *filler])), (2, " ".join([*sentence(62, 100), *filler])), (3, " ".join(base)), (4, " ".join([*base, *filler]))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_near_duplicates_of_many_copies(spark):
    """One original and hundreds of copies that are alike only through it, a template family below the similarity with true pairs in it."""
    from trustloom.llm.simhash import near_duplicates, shingle_hashes

    def edited(base, seed, edits, span):
        r, out = random.Random(seed), list(base)
        for at in r.sample(range(0, len(out) - 5, span), edits):
            out[at] = f"e{seed}x{at}"
        return " ".join(out)

    base, template = sentence(70, 400), sentence(71, 400)
    rows = [(1000, " ".join(base))] + [(i, edited(base, i, 6, 6)) for i in range(1, 301)]  # 0.86 to the original, 0.76 to each other
    for i in range(100):
        family = edited(template, 2000 + i, 15, 6)  # under 0.75 to the template, under 0.6 to each other
        rows += [(2000 + i, family), (3000 + i, edited(family.split(), 3000 + i, 6, 6))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [(i, set(shingle_hashes(t, 5).tolist())) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert len({root(i) for i in parent}) == 101
    assert all(got[i] == 1 for i in (1000, *range(1, 301)))
    assert all(root(got[i]) == root(i) for i in got)
    assert sum(got[3000 + i] == 2000 + i for i in range(100)) >= 95  # 0.86 alike, found with probability 0.98 each


# 2 mixing


def test_mix_meets_its_targets(spark):
    from trustloom.llm.mixing import cycled_weights, mix

    r = random.Random(5)
    rows = [(i, ["b", "a", None, "c", "é"][min(4, int(r.random() ** 2 * 5))], r.randint(0, 40), r.getrandbits(64) - (1 << 63), "x") for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, hash long, target string")
    clashes = ("prefix", "budget", "taken", "repeats", "cut", "row", "_source", "a.b", "Times")
    frame = frame.withColumns({c: F.lit(c) for c in clashes})
    mixed = mix(frame, cycled_weights(frame))
    assert mixed.columns == [c for c in frame.columns if c not in ("target", "Times")] + ["source_size", "target", "times"]
    assert {tuple(r) for r in mixed.select(*[f"`{c}`" for c in clashes[:-1]]).distinct().collect()} == {clashes[:-1]}
    got = mix(frame, cycled_weights(frame)).collect()
    sources = ["a", "b", "c", "é", None]
    size = {s: sum(x[2] for x in rows if x[1] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        rest, over = total - sum(2 * size[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        want = {s: 2 * size[s] if s in capped else rest * weight[s] / over for s in sources}
        new = {s for s in sources if s not in capped and want[s] > 2 * size[s]}
        if not new:
            break
        capped |= new
    for s in sources:
        mine = [x for x in got if x["source"] == s]
        taken = sum(x["times"] * x["size"] for x in mine)
        assert {x["source_size"] for x in mine} == {size[s]} and abs(mine[0]["target"] - want[s]) < 1e-6
        assert abs(taken - want[s]) <= 40 and all(0 <= x["times"] <= 2 for x in mine)
    again = mix(frame.repartition(5), cycled_weights(frame)).collect()
    assert sorted((x["doc_id"], x["times"]) for x in got) == sorted((x["doc_id"], x["times"]) for x in again)


def test_mix_of_empty_sources(spark):
    from trustloom.llm.mixing import cycled_weights, mix

    kind = "doc_id long, source string, size long, hash long"
    frame = spark.createDataFrame([(1, "a", 0, 5), (2, "b", 10, 5), (2, "b", 10, 5)], kind)
    assert sorted((x["doc_id"], x["target"], x["times"]) for x in mix(frame, cycled_weights(frame)).collect())[0] == (1, 0.0, 0)
    none = spark.createDataFrame([], kind)
    assert mix(none, cycled_weights(none)).collect() == []


# 3 token files


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**40, 2**53 + 3, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n, top):
    from trustloom.llm import simple8b

    values = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True)
    values[: n // 9] = top
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, n) == values).all()


def test_escapes_at_the_border():
    from trustloom.llm import simple8b

    values = np.array([2**60 - 1, 2**60, 2**64 - 1, 0, 2**59, 1] * 400, np.uint64)
    assert (simple8b.decode(*simple8b.encode(values), len(values)) == values).all()


AWKWARD = ["", " ", "\n", "a  b", "a\n\nb", " a", "a ", "x\ty", "<|endoftext|> a<|endoftext|>b", "it's I'LL we'Re 12 3.5 ½ ²", "\x85a b\xa0c", "Σ ΑΣ ́a é İ", "\x1c a\x1db", "日本 テスト", "ĲŉǅǄ ß ſ ƀ ɏ ª º · \xad x\xady"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name):
    import public_tokenizers

    from trustloom.llm.tokenize import WordTokenizer

    own = WordTokenizer(public_tokenizers.path(name))
    assert own.kind in ("dropped", "bytes")
    texts = [*AWKWARD, *[r[1] for r in corpus()], "\x00a \x00", "l'été, où? L'ÉTÉ: ça; va... [x] <y> 1.5%"]
    for group in (texts, texts[::-1], *[[t] for t in texts], []):
        ids, counts = own.encode_many(pa.array(group, pa.string()))
        parts = np.split(ids, np.cumsum(counts)[:-1]) if group else []
        for text, part in zip(group, parts):
            assert part.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, text[:50]
        assert len(parts) == len(group) and counts.sum() == len(ids)


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from trustloom.llm.token_files import read_token_files, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    got = read_token_files(write_token_files(docs, f"file://{tmp_path}/ids", path, 1)).orderBy("start").collect()
    plain = Tokenizer.from_file(path)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, row in zip(got, rows):
        ids = [*plain.encode(row[1] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"]) == (start, len(ids)) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert read_token_files(write_token_files(empty, f"file://{tmp_path}/none", path, 1)).collect() == []


# 4 nearest neighbours


def test_nearest_with_copies_and_unusable_vectors(spark):
    from trustloom.llm.ann import nearest

    r = np.random.default_rng(2)
    v = r.normal(size=(600, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    rows += [(600, None, "c"), (620, [0.0] * 16, "c"), (640, [1.0, None] + [0.0] * 14, "c"), (660, [float("nan")] * 16, "c"), (680, [1.0], "c"), (None, [1.0] * 16, "c"), rows[20]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=10, code_block=200, query_block=64).collect()
    hits = asked = 0
    for q in range(0, 600, 20):
        scores = v.astype(float) @ v[q].astype(float)
        best = [i for i in sorted(range(600), key=lambda i: (-round(scores[i], 9), i)) if i != q][:10]
        mine = sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, 11))
        assert all(abs(x["score"] - scores[x["vec_id"]]) < 1e-9 for x in mine)
        hits, asked = hits + len({x["vec_id"] for x in mine} & set(best)), asked + 10
    assert {x["query_id"] for x in got} == set(range(0, 600, 20)) and hits / asked >= 0.95
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(x["query_id"], x["rank"], x["vec_id"]) for x in nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert nearest(few.limit(0), F.lit(True)).collect() == []


def test_recall_of_nearest_with_little_reranking(spark, sf_dir):
    """Of 2,000 vectors 2 % are scored exactly, so the codes have to find the right ones."""
    from trustloom.llm.ann import nearest

    frame = spark.read.parquet(f"{sf_dir}/../sf0.1/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").toPandas()
    v, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    got: dict = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, k=20, rerank=40).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = asked = 0
    for at in np.flatnonzero(ids % 20 == 0):
        order = [i for i in np.argsort(-(v @ v[at]), kind="stable") if i != at][:20]
        hits, asked = hits + len(got[ids[at]] & set(ids[order])), asked + 20
    assert asked == 20 * len(got) and hits / asked >= 0.9


def test_nearest_of_lengths_far_apart_and_of_near_copies(spark):
    """Few long vectors and many short ones, and 700 that differ in the sixth place; the codes alone don't tell them apart."""
    from trustloom.llm.ann import nearest

    r = np.random.default_rng(4)
    v = r.normal(size=(3000, 64)) * np.exp(3 * r.normal(size=(3000, 1)))
    v[1000:1700] = r.normal(size=64) + 1e-6 * r.normal(size=(700, 64))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for x in nearest(frame, F.col("vec_id") % 20 == 0, k=20, rerank=25, sample_rows=400, code_block=1100, query_block=90).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert len(got) == 150
    for q, found in got.items():
        scores = np.cumsum(v * v[q], axis=1)[:, -1]
        want = [i for i in np.lexsort((np.arange(3000), -scores)).tolist() if i != q][:20]
        assert found == [(i, scores[i]) for i in want]


# 5 WARC


def test_warc_round_trip(spark, tmp_path):
    from trustloom.llm.common import materialise
    from trustloom.llm.warc import assemble, read_records, write_warc

    hostile = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9
    rows = [(5, "u5", "b" * 150), (3, "u3\r\nX: y", "b" * 150), (9, None, "b" * 150), (1, "u1", "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", hostile), (7, "u7", hostile), (8, "ü", "ü\x00é" * 90_000), (8, "ü", "ü\x00é" * 90_000), (None, "n", "b" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string").withColumn("record", F.lit(1)).repartition(2)
    write_warc(pages, f"file://{tmp_path}/warc")
    got = assemble(materialise(read_records(spark, f"file://{tmp_path}/warc"), "t")).collect()
    members = []
    for part in (tmp_path / "warc").glob("part-*"):
        left = part.read_bytes()
        while left:
            one = zlib.decompressobj(31)
            members.append(one.decompress(left))
            assert one.eof
            left = one.unused_data
    records = [m for m in members if m]
    assert len(records) == 3 * len(rows) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in records)
    for m in records:  # a member holds one record and nothing else
        head, _, rest = m.partition(b"\r\n\r\n")
        assert len(rest) - 4 == int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert len(got) == len(rows) and all(r["request"] is not None and r["metadata"] is not None for r in got)
    page = lambda r: int(r["metadata"]["fields"]["page-id"]) if "page-id" in r["metadata"]["fields"] else None
    kinds = {page(r): r["response"]["type"] for r in got}
    assert kinds == {5: "revisit", 3: "response", 9: "revisit", 1: "response", 2: "response", 4: "response", 6: "response", 7: "revisit", 8: "response", None: "revisit"}
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        own = texts[page(r)]
        if r["response"]["type"] == "response":
            assert bytes(r["response"]["payload"]) == own and r["response"]["computed_digest"] == hashlib.sha256(own).hexdigest()
        else:
            assert r["original"]["payload_bytes"] == len(own) and r["metadata"]["fields"]["refers-to-page-id"] == ("3" if own[:1] == b"b" else "6")
        assert r["response"]["payload_digest"] == "sha256:" + hashlib.sha256(own).hexdigest()
    write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert read_records(spark, f"file://{tmp_path}/none").count() == 0


# 6 substring dedup


@pytest.mark.parametrize("hot", [128, 1])
def test_repeated_windows_go(docs, empty, hot):
    from trustloom.llm.substring import remove_repeats

    first: dict[tuple, int] = {}
    rows = corpus()
    for d, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    want = []
    for d, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    clashing = docs.withColumns({"n_words": F.lit("clash"), **{c: F.lit(c) for c in ("_uid", "_cuts", "uid_of_text", "spans", "a.b", "_Doc")}})
    got = remove_repeats(clashing, hot=hot)
    assert got.columns == [c for c in clashing.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text"]
    assert {tuple(r) for r in got.select("_uid", "_cuts", "uid_of_text", "spans", "`a.b`", "_Doc").distinct().collect()} == {("_uid", "_cuts", "uid_of_text", "spans", "a.b", "_Doc")}
    assert sorted([tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()], key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 400
    assert remove_repeats(empty).collect() == []


def test_found_runs_are_one_row_for_each_string(spark, monkeypatch):
    """A passage in thousands of documents, between words of their own: the join to its places gives a row per place at most."""
    from trustloom.llm import substring

    made, write = {}, substring.materialise
    monkeypatch.setattr(substring, "materialise", lambda df, label: made.setdefault(label, write(df, label)))
    passage = sentence(2, 120)
    rows = [(i, " ".join([f"a{i}", *[f"b{i % 7}"] * 3, *passage, f"c{i % 11}", f"d{i}"])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring.remove_repeats(frame, hot=8).groupBy("n_removed").count().collect()
    listed, found = made["substring-candidates"], made["substring-found"]
    key = ["minimiser", "content", "n"]
    assert found.count() == found.select(*key).distinct().count() and found.filter(F.size("runs") > 64).count() == 0
    assert listed.join(found, key).count() <= listed.count()
    assert {r["n_removed"] for r in got} <= {0, 120, 121, 122, 123, 124} and max(got, key=lambda r: r["count"])["n_removed"] >= 120


# 7 packing


def test_plans_use_every_piece_once():
    from trustloom.llm.packing import plan_sequences

    r = random.Random(4)
    for _ in range(150):
        room = r.choice([7, 30, 100])
        counts = {r.randint(1, room): r.randint(1, 25) for _ in range(r.randint(1, 14))}
        sequences: dict[int, list[tuple[int, int]]] = {}
        for length, runs in plan_sequences(counts, room).items():
            for rank in range(counts[length]):
                at = np.searchsorted(runs[:, 0], rank, side="right") - 1
                sequences.setdefault(int(runs[at, 1] + rank - runs[at, 0]), []).append((int(runs[at, 2]), length))
        assert sum(map(len, sequences.values())) == sum(counts.values())
        for pieces in sequences.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= room
        assert len(sequences) <= 1.25 * sum(k * n for k, n in counts.items()) / room + 2 + sum(n for k, n in counts.items() if 2 * k > room)


def test_reduction_keeps_the_optimum():
    from functools import lru_cache

    from trustloom.llm.packing import plan_sequences, reduce_dominated

    @lru_cache(None)
    def fewest(items: tuple[int, ...], room: int) -> int:
        if not items:
            return 0
        best, head, rest = 99, items[0], items[1:]
        for mask in range(1 << len(rest)):
            chosen = [x for i, x in enumerate(rest) if mask >> i & 1]
            if head + sum(chosen) <= room:
                best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if not mask >> i & 1), room))
        return best

    r = random.Random(6)
    for _ in range(60):
        room = r.choice([10, 12, 15])
        items = sorted((r.randint(1, room) for _ in range(r.randint(1, 7))), reverse=True)
        count = np.bincount(items, minlength=room + 1)
        fixed = reduce_dominated(count, room)
        left = tuple(n for n in range(room, 0, -1) for _ in range(count[n]))
        assert sum(t for t, _ in fixed) + fewest(left, room) == fewest(tuple(items), room)
        assert plan_sequences({}, room) == {}


def test_packed_pieces(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from trustloom.llm.queries import packed_documents

    got = packed_documents(docs).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text, *_ in corpus():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for piece, (a, b) in enumerate([(0, first), *[(x, x + 2048) for x in range(first, len(ids), 2048)]]):
            want.append((d, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert packed_documents(empty).collect() == []


# 8 chat formatting


def test_chat_round_trip(spark):
    from trustloom.llm.chat_format import format_conversations, loss_texts, parse_formatted

    nasty = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST] [\\", "<s>[ROLE]x[/ROLE]", "[TURN]", "a\\nb $1", "", None, "日本\n[TURN", "TURN]", "/s>", "<"]
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant", None, "[/ROLE]", "to<s>ol"]), r.choice(nasty), 1) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 1, "user", "x", 1), (None, None, "assistant", "y", 1), (0, 0, "user", "tie", 1), (500, 1, "user", "twice", 1), (500, 1, "user", "twice", 1)]
    kind = "conv_id long, turn long, role string, text string, formatted int"
    done = format_conversations(spark.createDataFrame(rows, kind).repartition(3))
    got = done.select("conv_id", parse_formatted(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    turns: dict = {}
    for c, t, role, text, _ in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {x["conv_id"] for x in got} == set(turns)
    for x in got:
        want = [(role, text) for _, _, role, text in sorted(turns[x["conv_id"]])]
        assert [tuple(t) for t in x["turns"]] == want
        assert x["loss"] == [text for role, text in want if role == "assistant"]
    merged = done.filter("conv_id = 500").first()["formatted"]
    assert merged == "<s>[INST]twice[TURN]twice[/INST]"
    assert format_conversations(spark.createDataFrame([], kind)).collect() == []


# 9 quality


def test_quality_on_held_out_labels(spark, sf_dir):
    from trustloom.llm.cotrain import score_quality

    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    held = labels.filter("doc_id % 3 = 0").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    got = score_quality(docs, labels.filter("doc_id % 3 != 0")).join(held, "doc_id").select("good", "keep").collect()
    good, bad = [r["keep"] for r in got if r["good"]], [not r["keep"] for r in got if not r["good"]]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) >= 0.9


def test_quality_without_labels(docs, empty, spark):
    from trustloom.llm.cotrain import score_quality

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_quality(docs.withColumn("score", F.lit("clash")), none)
    assert got.count() == len(corpus()) and {(r["score"], r["keep"]) for r in got.collect()} == {(0.5, True)}
    one = spark.createDataFrame([(0, None, 1), (1, 1, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, one).filter("keep").count() == len(corpus()) and score_quality(empty, one).collect() == []


# 10 I-Match


def test_imatch_fingerprints(docs, empty):
    from trustloom.llm.imatch import fingerprint, lexicon, likeness

    held = lexicon(docs, 0.0, 20.0)
    got = docs.select("doc_id", "text", fingerprint(F.coalesce("text", F.lit("")), held).alias("f")).collect()
    assert all(re.fullmatch("[0-9a-f]{512}", r["f"]) for r in got)
    by_text: dict = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["f"])
    assert all(len(x) == 1 for x in by_text.values()) and by_text[""] == {"0" * 512}
    base, half = corpus()[0][1], corpus()[0][1].split()
    pairs = [(base, base, 1.0, 1.0), ("", "", 1.0, 1.0), (base, " ".join(half[:65] + sentence(77, 65)), 0.05, 0.8), (base, " ".join(x + "q" for x in half), 0.0, 0.1)]
    frame = docs.sparkSession.createDataFrame(pairs, "a string, b string, low double, high double")
    near = frame.withColumn("l", likeness(fingerprint(F.col("a"), held), fingerprint(F.col("b"), held))).collect()
    assert all(r["low"] <= r["l"] <= r["high"] for r in near), [r["l"] for r in near]
    assert empty.select(fingerprint(F.col("text"), lexicon(empty))).collect() == []


def test_imatch_of_rare_vocabulary(spark):
    """Texts that share one term of medium frequency and have only rare or only common ones besides are not alike."""
    from trustloom.llm.imatch import fingerprint, lexicon, likeness

    rows = [(i, " ".join(["zed"] * (i < 10) + [f"r{i}x{k}" for k in range(50)])) for i in range(2000)]
    rows += [(5000 + i, " ".join(["mid"] * (i < 10) + [f"c{(i % 2) * 20 + k}" for k in range(20)])) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = lexicon(frame)
    prints = {r["doc_id"]: r["f"] for r in frame.filter("doc_id in (0, 1, 5000, 5001, 5002)").select("doc_id", fingerprint(F.col("text"), held).alias("f")).collect()}
    pairs = spark.createDataFrame([(prints[0], prints[1]), (prints[5000], prints[5001]), (prints[5000], prints[5002])], "a string, b string")
    rare, common, equal = (r["l"] for r in pairs.select(likeness(F.col("a"), F.col("b")).alias("l")).collect())
    assert rare < 0.3 and common < 0.3 and equal == 1.0


@pytest.mark.parametrize("rows_per_range", [1, 3, 1000])
def test_next_row(spark, rows_per_range):
    from trustloom.llm.imatch import with_next

    ids = [None, *random.Random(2).sample(range(-50, 5000), 60)]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    got = {r["doc_id"]: r["next_text"] for r in with_next(frame, ["text"], rows_per_range=rows_per_range).collect()}
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert with_next(frame.filter("doc_id = 0 and doc_id = 1"), ["text"]).collect() == []


def test_lexicon_is_exact(spark):
    """Terms in more than 8.2 % of the documents are out, however many other terms there are."""
    from trustloom.llm.imatch import lexicon, terms

    rows = [(i, " ".join([*(["often"] if i < 90 else []), *(["seldom"] if i < 80 else []), *[f"w{i}x{k}" for k in range(300)]])) for i in range(1000)]
    inside = lexicon(spark.createDataFrame(rows, "doc_id long, text string"))
    got = spark.createDataFrame([("often seldom new",)], "text string").select(F.transform(terms(F.col("text")), inside.inside).alias("x")).first()
    assert got["x"] == [False, True, False]
    band = lexicon(spark.createDataFrame(rows, "doc_id long, text string"), 2.42, 2.6)
    got = spark.createDataFrame([("often seldom w1x1",)], "text string").select(F.transform(terms(F.col("text")), band.inside).alias("x")).first()
    assert got["x"] == [False, True, False]


# recall of near-duplicates


def test_recall_of_near_duplicates_at_the_limit(spark):
    """Pairs of similarity just over 0.8 against brute force: at least 0.9 are found, and no pair under 0.8."""
    from trustloom.llm.simhash import near_duplicates, shingle_hashes

    rows, alike = [], {}
    for i in range(300):
        r = random.Random(i)
        base = sentence(10_000 + i, r.randint(250, 450))
        other, k = list(base), 0
        sets = lambda w: set(shingle_hashes(" ".join(w), 5).tolist())
        a = sets(base)
        while True:
            changed = list(other)
            changed[r.randrange(len(changed))] = f"new{i}x{k}"
            b, k = sets(changed), k + 1
            if len(a & b) < (0.8 if i % 4 else 0.7) * len(a | b):
                break
            other = changed
        b = sets(other if i % 4 else changed)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other if i % 4 else changed))]
        alike[i] = len(a & b) / len(a | b)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = {i: got[2 * i + 1] == 2 * i for i in alike}
    due = [i for i in alike if alike[i] >= 0.8]
    assert len(due) == 225 and max(alike[i] for i in due) < 0.84
    assert sum(found[i] for i in due) >= 0.9 * len(due)
    assert not any(found[i] for i in alike if alike[i] < 0.8)


# the queries themselves, on awkward tables


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), DOCS).withColumn("target", F.lit("t")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 0), (9, None, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    v = np.random.default_rng(1).normal(size=(90, 8)).tolist()
    vectors = [(i, x, 0) for i, x in enumerate(v)] + [(100, None, 0), (120, [0.0] * 8, 0), (20, v[20], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_op1_query(spark, awkward_dir):
    from trustloom.llm.queries import op1_simhash

    got = op1_simhash(spark, awkward_dir)
    want = sorted(((r[0], f"{brute_fingerprint(r[1]):016x}") for r in corpus()), key=repr)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got.collect()), key=repr) == want


def test_op2_query(spark, awkward_dir):
    from trustloom.llm.queries import op2_mixing

    got = [r.asDict() for r in op2_mixing(spark, awkward_dir).collect()]
    size = {r[0]: len(words(r[1])) for r in corpus()}
    of = {}
    for r in corpus():
        of[r[3]] = of.get(r[3], 0) + len(words(r[1]))
    source = {r[0]: r[3] for r in corpus()}
    assert len(got) == len(corpus())
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[source[r["doc_id"]]] and 0 <= r["taken"] <= 2 * r["size"]
    assert sorted(map(repr, got)) == sorted(repr(r.asDict()) for r in op2_mixing(spark, awkward_dir).collect())


def test_op3_query(spark, awkward_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    from trustloom.llm.queries import op3_token_files

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in op3_token_files(spark, awkward_dir).orderBy("start").collect()] == want


def test_op4_query(spark, awkward_dir):
    from trustloom.llm.queries import op4_ann

    v = np.random.default_rng(1).normal(size=(90, 8)).astype(np.float32).astype(float)
    got: dict = {}
    for r in op4_ann(spark, awkward_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < 1e-12
    want = {q: [int(i) for i in np.argsort(-(v @ v[q]), kind="stable") if i != q][:20] for q in range(0, 90, 20)}
    assert got == want


def test_op9_query(spark, awkward_dir, sf_dir):
    """The scores are those that the model of the same fit gives row by row."""
    from trustloom.llm.cotrain import tokens_and_shape, train
    from trustloom.llm.queries import op9_quality

    few = op9_quality(spark, awkward_dir).collect()
    assert len(few) == len(corpus())
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    rows = docs.collect()
    want = model.score([tokens_and_shape(r["text"] or "") for r in rows], [(r["lang"], r["source"], r["n_chars"]) for r in rows])
    got = {r["doc_id"]: r for r in op9_quality(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        g = got[r["doc_id"]]
        assert np.allclose((g["score"], g["text_score"], g["metadata_score"]), w, atol=1e-3) and g["keep"] == (g["score"] >= 0.5)


def test_op10_query(spark, awkward_dir):
    from trustloom.llm.queries import op10_imatch

    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = []
    for i, (r, text) in enumerate(zip(order, texts)):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(i + 1) % len(texts)][:half]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = op10_imatch(spark, awkward_dir).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[0] == prints[1] == prints[None] and prints[2] == prints[3]


# the pipeline


def test_pipeline_on_the_smallest_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
    from trustloom.llm.common import given

    before = given()
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert given() - before <= 4  # the last stage's input and its own tables
    assert {"doc_id", "piece", "sequence_id"} <= set(rows[0].asDict()) and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


CLASHES = {c: F.lit for c in ("size", "hash", "score", "keep", "n_words", "kept_text", "uid", "key", "_key", "others", "row", "times", "target", "component_id", "a.b")}


def stage_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "substring_dedup", "mixing"])
def test_stages_on_awkward_tables(spark, awkward_dir, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = stage_rows(spark, [r[:5] for r in corpus()])
    got = stage(spark, docs, awkward_dir)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == c for r in rows for c in CLASHES)
    before = {}
    for r in corpus():
        before.setdefault(r[0], []).append(r)
    assert {r["doc_id"] for r in rows} <= set(before)
    if name != "substring_dedup":
        assert all(any((r["text"], r["lang"], r["source"], r["n_chars"]) == x[1:5] for x in before[r["doc_id"]]) for r in rows)
    assert stage(spark, docs.limit(0), awkward_dir).collect() == []


def test_packing_stage_on_awkward_tables(spark, awkward_dir):
    """Every row's pieces hold all its ids, whatever the other columns are called; the null id is carried along."""
    import corpus_pipeline

    docs = stage_rows(spark, [r[:5] for r in corpus()])
    rows = corpus_pipeline.packing(spark, docs, awkward_dir).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in corpus()}
    assert all(0 < r["length"] <= 2048 and r["offset"] + r["length"] <= 2048 for r in rows)
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] for p in places.values())
    assert corpus_pipeline.packing(spark, docs.limit(0), awkward_dir).collect() == []


def test_near_dedup_keeps_one_row_of_repeats(spark, awkward_dir):
    import corpus_pipeline

    copy, other = " ".join(sentence(1, 130)), " ".join(sentence(9, 90))
    rows = [(1, copy), (1, copy), (None, copy), (None, copy), (2, copy), (2, other), (None, other + " end"), (None, "alone"), (5, None), (6, " ")]
    docs = stage_rows(spark, [(i, t, "en", "s", None) for i, t in rows])
    got = corpus_pipeline.near_dedup(spark, docs, awkward_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, copy), (2, other), (None, "alone"), (5, None)], key=repr)


def test_substring_stage_against_brute_force(spark, docs):
    import corpus_pipeline

    first: dict[tuple, int] = {}
    numbered = sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0])
    for d, text, *_ in numbered:
        w = words(text)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    want = []
    for d, text, lang, source, n_chars, *_ in corpus():
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        if any(gone) and all(gone):
            continue
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, kept if any(gone) else text, lang, source, len(kept) if any(gone) else n_chars))
    got = corpus_pipeline.substring_dedup(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_files_name_their_store(tmp_path):
    from trustloom.llm.files import committed, reader

    with pytest.raises(ValueError, match="names no store"):
        reader(f"{tmp_path}/x")
    with pytest.raises(KeyError), committed(f"file://{tmp_path}/x", 3) as out:
        out.write(b"half")
        raise KeyError
    assert list(tmp_path.iterdir()) == []
    with committed(f"file:{tmp_path}/x", 4) as out:
        out.write(b"whole")
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and reader(f"file:{tmp_path}/x").read() == b"whole"
