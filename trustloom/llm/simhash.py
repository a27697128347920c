"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that lies within half
the radius of both. Every distinct fingerprint emits all its variants, the
variants are shuffled, and those that several fingerprints emitted give links.

A variant's group holds only fingerprints within half the radius of it, so a
group has at most ``1 + bits`` members (radius 2) whatever the data, and is kept
as one word: bit i of the mask says that the variant with bit i flipped is a
fingerprint. Copies meet before that, in a map-side minimum per fingerprint, so a
group of copies of any size is one row per task. All members of a group lie within the
radius of each other, so a star to the smallest member loses no connection.

Defined results: null text is the empty text; a text without words has
fingerprint zero and links like any other; repeated rows are copies; a null
``doc_id`` is carried along and never is a component's id unless no row of the
component has one; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import materialise
from trustloom.llm.components import connected_components

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles that are turned into bits at once.
_CHUNK = 1 << 15
#: Differing bits of 64 up to which near-duplicates are of one family; those of similarity 0.8 differ in 9.6 on average.
_FAMILY_BITS = 16
#: Variants that a task emits.
_VARIANTS = 1_000_000


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``n``-word shingle of the text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
    ends = (ends[n - 1 :] - 1).tolist()
    joined = b" ".join(words)
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th further 64-bit hash of each hash; the 0th is itself."""
    if k:
        with np.errstate(over="ignore"):
            h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def fingerprint_words(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``64 * words`` majority bits of the hashes, as signed 64-bit integers."""
    out = []
    for k in range(words):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _CHUNK):
            part = _mix(hashes[at : at + _CHUNK], k)
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            for s in range(0, len(bits), 255):
                counts += bits[s : s + 255].sum(axis=0, dtype=np.uint8)
        set_bits = (2 * counts > len(hashes)).astype(np.uint8)
        out.append(int(np.packbits(set_bits).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """``doc_id`` and ``fp`` (array of ``words`` longs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_words(shingle_hashes(t.as_py(), shingle), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fp"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp array<bigint>")


def _set_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """``doc_id``, ``fps`` (array of ``words`` longs) of the set of shingles, and ``digest`` (16 bytes) of that set, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            columns = [pa.array([fingerprint_words(x, words) for x in sets], pa.list_(pa.int64())), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fps", "digest"])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fps array<bigint>, digest binary")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def ball_links(fps: DataFrame, bits: int = 64, radius: int = 2, key: tuple[str, ...] = ()) -> DataFrame:
    """Links ``a``, ``b`` (b < a) that connect all of the distinct values ``fp`` of
    equal ``key`` within ``radius`` (0 or 2) bits, as a chain of links each within the radius."""
    if radius not in (0, 2):
        raise ValueError("radius must be 0 or 2")
    if radius == 0:
        return fps.select(*key, F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    groups = _ball_groups(fps, bits, key)
    stars = groups.select(*key, F.explode("members").alias("a"), F.array_min("members").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return stars.filter((F.col("a") != F.col("b")) & near).distinct()


def _ball_groups(fps: DataFrame, bits: int, key: tuple[str, ...] = (), held: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """``variant`` and ``members`` of each value that several of the distinct values ``fp`` of equal ``key`` come to
    by flipping one of the lowest ``bits`` bits at most; any two values within two of these bits are members of a group.
    ``held``: columns and the aggregates of them that each group also has of its members."""
    # a table of fingerprints is small to read and large once exploded, so it is spread by what a task emits
    spread = fps.repartition(-(-fps.count() * (bits + 1) // _VARIANTS) or 1)
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda i: i)
    i, flip = F.col("i"), _bit(F.col("i"))
    # i = bits stands for the fingerprint itself, in a bit of the mask where there is room for it
    room = bits < 63
    mask = flip if room else F.when(i < bits, flip).otherwise(F.lit(0).cast("long"))
    own = {} if room else {"own": (i == bits).cast("int")}
    held = held or {}
    variants = spread.select(*key, "fp", *held, F.explode(flips).alias("i")).select(
        *key,
        *held,
        F.when(i < bits, F.col("fp").bitwiseXOR(flip)).otherwise(F.col("fp")).alias("variant"),
        mask.alias("mask"),
        *[c.alias(name) for name, c in own.items()],
    )
    groups = variants.groupBy(*key, "variant").agg(F.bit_or("mask").alias("mask"), *[F.max(name).alias(name) for name in own], *[f(c).alias(c) for c, f in held.items()])
    n = F.bit_count("mask") if room else F.bit_count("mask") + F.col("own")
    groups = groups.filter(n >= 2)
    itself = F.col("mask").bitwiseAND(_bit(F.lit(bits))) != 0 if room else F.col("own") == 1
    members = F.concat(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col("mask").bitwiseAND(_bit(i)) != 0),
            lambda i: F.col("variant").bitwiseXOR(_bit(i)),
        ),
        F.when(itself, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
    )
    return groups.select(*key, *held, "variant", members.alias("members"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` (the smallest doc_id
    reachable over links of ``radius`` or fewer differing bits) of every row."""
    fps = materialise(fingerprints(docs, shingle).select("doc_id", F.col("fp")[0].alias("fp")), "simhash-fps")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    links = materialise(ball_links(classes.select("fp"), radius=radius), "simhash-links")
    labels = connected_components(links)
    joined = materialise(
        classes.join(labels, classes["fp"] == labels["node"], "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("label")
        ),
        "simhash-labelled",
    )
    firsts = materialise(joined.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-firsts")
    members = materialise(joined.join(firsts, "label").select("fp", "component_id"), "simhash-members")
    return fps.join(members, "fp").select("doc_id", "fp", "component_id")


def _tables(bits: int, similarity: float, recall: float) -> int:
    """Slices of ``bits`` bits of which, with probability ``recall``, one differs by at most two for texts of this similarity."""
    apart = acos(2 * similarity / (1 + similarity)) / pi  # by the angle between the sets of shingles
    found = sum(comb(bits, i) * apart**i * (1 - apart) ** (bits - i) for i in range(3))
    return max(1, ceil(log(1 - recall) / log(max(1e-12, 1 - found))))


def _keyed_slices(classes: DataFrame, tables: int, bits: int, *more: str) -> DataFrame:
    """``fp`` and ``first`` (and ``more``) of each class and slice; ``fp``: the number of the slice over its ``bits`` bits of the long fingerprint."""
    each = 64 // bits
    at = lambda t: F.shiftrightunsigned(F.get("fps", F.lit(t // each)), bits * (t % each)).bitwiseAND(F.lit((1 << bits) - 1))
    rows = F.array(*[at(t).bitwiseOR(F.lit(t << bits).cast("long")) for t in range(tables)])
    return classes.select("first", *more, F.explode(rows).alias("fp"))


def _spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect all rows over distances of at most ``most`` bits."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]).sum(axis=1) <= most
            links += [(y, x) for y in rest[near]]
            todo += rest[near].tolist()
            rest = rest[~near]
    return links


def _linked_in_groups(members: DataFrame, words: int, most: int) -> DataFrame:
    """Links ``a``, ``b`` that connect the documents of each group ``g`` as all its pairs within ``most`` bits do.

    ``members``: a row for each value of a group, with its documents' ``ids`` and, one after the other, their ``fps``.
    """

    def links(g: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sizes = np.diff(np.append(starts, len(g)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1) <= most]
        more = [(at + x, at + y) for at, n in zip(starts[sizes > 2], sizes[sizes > 2]) for x, y in _spanning(fps[at : at + n], most)]
        more = np.array(more, np.int64).reshape(-1, 2)
        a, b = ids[np.concatenate((two, more[:, 0]))], ids[np.concatenate((two + 1, more[:, 1]))]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            each = np.diff(batch.column(1).offsets.to_numpy())
            g, ids = np.repeat(batch.column(0).to_numpy(), each), batch.column(1).flatten().to_numpy()
            fps = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, words)
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut or held and held[0][0][0] != g[0]:
                held.append((g[:cut], ids[:cut], fps[:cut]))
                yield links(*map(np.concatenate, zip(*held)))
                held = []
            held.append((g[cut:], ids[cut:], fps[cut:]))
        if held:
            yield links(*map(np.concatenate, zip(*held)))

    dealt = members.select("g", "ids", "fps").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a bigint, b bigint").filter("a != b").distinct()


def _centres(members: DataFrame, words: int, seen: int = 512) -> DataFrame:
    """``family`` and ``centre``: of ``seen`` rows (``family``, ``id``, ``fps``) of each family, the smallest by hash, the one nearest to the
    majority of their bits. Any row would do; a central one settles more of its family at once."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        bits = np.unpackbits(table.column("fps").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(ids), 8 * words), axis=1)
        apart = (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(ids))).sum(axis=1)
        return pa.table({"family": table.column("family")[:1], "centre": pa.array([ids[np.lexsort((ids, apart))[0]]], pa.int64())})

    some = Window.partitionBy("family").orderBy(F.xxhash64("id"), "id")  # limited within the tasks first
    few = members.select("family", "id", "fps").withColumn("at", F.row_number().over(some)).filter(F.col("at") <= seen).drop("at")
    return few.groupBy("family").applyInArrow(run, "family bigint, centre bigint")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each set of ``x`` and each of ``y``."""
    both, at = np.unique(np.concatenate((*x, *y)), return_inverse=True)
    cut = sum(map(len, x))
    of_x, of_y = (np.repeat(np.arange(len(z)), list(map(len, z))) for z in (x, y))
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(both), 8192):  # some columns of the incidence matrices at a time
        width = min(8192, len(both) - low)
        parts = []
        for rows, cols, n in ((of_x, at[:cut], len(x)), (of_y, at[cut:], len(y))):
            here = (cols >= low) & (cols < low + width)
            part = np.zeros((n, width), np.float32)
            part[rows[here], cols[here] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _similar(members: DataFrame, docs: DataFrame, shingle: int, words: int, similarity: float, block: int = 128) -> DataFrame:
    """Links ``a``, ``b`` that connect the rows (``family``, ``id``, ``fps``) of each family as all its pairs of this Jaccard similarity do.

    First all are compared with their family's centre. What that links is not compared among itself again; all other
    pairs of the family are, by pairs of blocks of at most about ``block`` rows, so that no task holds a family.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["family", "id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(3), batch.column(4)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], ["family", "id", "centre", "near"])

    def across(table: pa.Table) -> pa.Table:
        side, ids, label = (table.column(c).to_numpy() for c in ("side", "id", "label"))
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        p, q = (np.flatnonzero((side == k) | (side == 2)) for k in (0, 1))
        size = np.array([len(x) for x in found])
        common = _common([found[i] for i in p], [found[i] for i in q])
        near = (common >= similarity * (size[p][:, None] + size[q][None, :] - common)) & (label[p][:, None] != label[q][None, :])
        parent = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        links = []
        for i, j in np.argwhere(near):
            a, b = root(int(label[p[i]])), root(int(label[q[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[p[i]], ids[q[j]]))
        links = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    text = docs.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
    whole = members.select("family", "id").join(text, "id").select("family", "id", "text")
    whole = materialise(whole.mapInArrow(sets, "family bigint, id bigint, shingles binary"), "near-shingles")
    centres = materialise(_centres(members, words), "near-centres")
    middle = centres.join(whole.select(F.col("id").alias("centre"), F.col("shingles").alias("y")), "centre")
    first = whole.join(middle, "family").select("family", "id", "centre", F.col("shingles").alias("x"), "y")
    first = materialise(first.mapInArrow(compare, "family bigint, id bigint, centre bigint, near boolean"), "near-first")
    stars = first.filter("near and id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))

    # a family of two is done, and so is one that all of its rows' links to the centre connect
    open_ = first.groupBy("family").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("alone")).filter("n > 2 and alone > 0")
    rows = first.join(open_.select("family"), "family").select("family", "id", F.when(F.col("near"), F.col("centre")).otherwise(F.col("id")).alias("label"))
    rows = materialise(rows, "near-open")
    large = rows.groupBy("family", "label").count().filter(F.col("count") >= block).select("family", "label", F.col("count").alias("n"))
    rows = rows.join(large, ["family", "label"], "left")
    small = rows.filter("n is null").groupBy("family").agg(F.count("*").alias("others"))
    parts = F.ceil(F.coalesce("n", "others") / block)
    part = F.pmod(F.xxhash64("id", F.lit(11)), parts)
    pure = F.when(F.col("n").isNotNull(), F.col("label"))
    placed = rows.join(small, "family", "left").select("family", "id", "label", pure.alias("pure"), F.xxhash64(pure, part).alias("block"))
    placed = materialise(placed, "near-placed")
    blocks = placed.select("family", "block", "pure").distinct()
    left, right = (blocks.select("family", F.col("block").alias(f"block_{k}"), F.col("pure").alias(f"pure_{k}")) for k in "ab")
    pairs = left.join(right, "family").filter("block_a <= block_b and coalesce(pure_a != pure_b, true)")
    sides = F.when(F.col("block_a") == F.col("block_b"), F.array(F.struct(F.col("block_a").alias("block"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side")))
    )
    pairs = pairs.select("family", "block_a", "block_b", F.explode(sides).alias("x")).select("family", "block_a", "block_b", "x.block", "x.side")
    held = materialise(placed.join(whole.select("id", "shingles"), "id"), "near-held")
    tasks = pairs.join(held, ["family", "block"]).select("family", "block_a", "block_b", "side", "id", "label", "shingles")
    more = tasks.groupBy("family", "block_a", "block_b").applyInArrow(across, "a bigint, b bigint")
    return stars.unionAll(more)


def slice_bits(corpus: int, crowd: int) -> int:
    """The least width, 32 bits or more, at which chance brings no more than a third of ``crowd`` of ``corpus`` documents together."""
    return next(bits for bits in range(32, 57) if 3 * (1 + bits) * corpus <= crowd << bits)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.9, corpus: int = 10**10, crowd: int = 256
) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row with a doc_id: near-duplicates by word shingles.

    Texts of this similarity differ in about 15 % of their SimHash bits, too many for a ball around 64 bits. So the
    fingerprint is longer, and the ball hashing (radius 2) is done in slices of it. There are as
    many slices as find a pair at ``similarity`` with probability ``recall`` (19 of 32 bits); nearly every closer one is
    found. Their width follows ``corpus``, the number of different documents that there may be at most (32 bits up to 10^10, 36 for 10^11, with 30
    slices), and not those that there are; more are refused. So no pair that is found in a corpus is lost in a larger one.

    What meets in a slice is first held against each other on the long fingerprints (16 of each 64 bits). Where more than ``crowd``
    documents meet, three times what chance brings about, they are one family without that: each is linked to the first document of its
    value, and the values to each other, so that a crowd gives a row per document and slice. In a crowd, pairs are verified that
    might not meet elsewhere. What all this connects is verified by the Jaccard similarity of
    the sets of shingles, all pairs of a family where need be. Variants shuffled are a fixed number per document (19 x 33).
    Documents of one value come first; a group whose documents that already connects needs no look and is dropped as it is made, so near copies of
    one text are not joined with all the groups they form. The other groups are joined as values, each with the documents that have it, and groups of the same values count once.

    Defined results: null text is the empty text, and texts without words are alike; a row without a doc_id gives none; repeated
    rows are copies; texts of equal sets of shingles are alike unverified; an empty table gives no row; other columns are ignored.
    """
    docs = docs.filter("doc_id is not null")
    bits = slice_bits(corpus, crowd)
    tables = _tables(bits, similarity, recall)
    words = max(4, ceil(tables / (64 // bits)))
    fps = materialise(_set_fingerprints(docs, shingle, words), "near-fps")
    classes = materialise(fps.groupBy("fps", "digest").agg(F.min("doc_id").alias("first")), "near-classes")
    if classes.count() > corpus:
        raise ValueError(f"there are more than {corpus} different documents; give a larger corpus")
    slices = materialise(_keyed_slices(classes, tables, bits), "near-slices")
    long = classes.select(F.col("first").alias("id"), "fps")

    def values(wanted: DataFrame, name: str) -> DataFrame:
        # a value of such groups has at most crowd documents
        have = slices.join(wanted, "fp").select("fp", F.col("first").alias("id")).join(long, "id")
        have = have.groupBy("fp").agg(F.collect_list(F.struct("id", "fps")).alias("docs"))
        return materialise(have.select("fp", F.col("docs.id").alias("ids"), F.flatten("docs.fps").alias("fps")), name)

    shared = slices.groupBy("fp").agg(F.count("*").alias("n"), F.min("first").alias("lead")).filter("n > 1")
    shared = materialise(shared, "near-shared")
    same = _linked_in_groups(values(shared.filter(F.col("n") <= crowd).select("fp"), "near-same").withColumn("g", F.col("fp")), words, _FAMILY_BITS * words)
    stars = slices.join(shared.filter(F.col("n") > crowd).select("fp", "lead"), "fp").select(F.col("first").alias("a"), F.col("lead").alias("b"))
    same = materialise(same.unionAll(stars.filter("a != b").distinct()), "near-same-links")
    labels = connected_components(same)
    # a document that nothing connects yet settles no group; its ends are constants, which cost a shuffle next to nothing
    ends = [F.coalesce("component", F.lit(x)).alias(name) for name, x in (("low", -(1 << 63)), ("high", (1 << 63) - 1))]
    labelled = materialise(classes.join(labels, classes["first"] == labels["node"], "left").select("fps", "first", *ends), "near-labelled")
    held = {"n": F.sum, "low": F.min, "high": F.max}
    counted = _keyed_slices(labelled, tables, bits, "low", "high").groupBy("fp")
    counted = counted.agg(F.count("*").alias("n"), F.min("first").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high"))
    counted = materialise(counted, "near-counted")
    balls = _ball_groups(counted.select("fp", *held), bits, held=held).filter("low < high").select(F.array_sort("members").alias("members"), "n")
    groups = materialise(balls.groupBy("members").agg(F.first("n").alias("n")), "near-groups")
    met = groups.filter(F.col("n") <= crowd).select(F.xxhash64("members").alias("g"), F.explode("members").alias("fp"))
    met = materialise(met, "near-met")
    close = _linked_in_groups(met.join(values(met.select("fp").distinct(), "near-values"), "fp"), words, _FAMILY_BITS * words).unionAll(same)

    crowded = groups.filter(F.col("n") > crowd).select(F.explode("members").alias("fp"), F.array_min("members").alias("least")).distinct()
    crowded, leads = materialise(crowded, "near-crowded"), counted.select("fp", "lead")
    across = crowded.join(leads, "fp").join(leads.select(F.col("fp").alias("least"), F.col("lead").alias("b")), "least")
    inside = slices.join(crowded.select("fp").distinct(), "fp", "left_semi").join(leads, "fp")
    together = across.select(F.col("lead").alias("a"), "b").unionAll(inside.select(F.col("first").alias("a"), F.col("lead").alias("b")))
    close = materialise(close.unionAll(together.filter("a != b").distinct()), "near-close")
    families = connected_components(close).select(F.col("node").alias("id"), F.col("component").alias("family"))
    families = materialise(families.join(long, "id"), "near-families")
    links = materialise(_similar(families, docs, shingle, words, similarity), "near-links")
    labels = connected_components(links)
    members = classes.join(labels, classes["first"] == labels["node"], "left")
    members = materialise(members.select("fps", "digest", F.coalesce("component", "first").alias("component_id")), "near-members")
    return fps.join(members, ["fps", "digest"]).select("doc_id", "component_id")
