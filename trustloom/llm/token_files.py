"""Binary files of token ids: Simple-8b words, block offsets and a document table.

Layout of a file (little-endian): magic; words of all blocks; word offset of each
block (uint64); per document a flag for a null id (uint8), the id (int64) and the
number of ids (uint64); footer of ids, documents, blocks, block size, magic. Documents follow each other in
ascending ``doc_id`` (null first), in files of consecutive ranges, so that
training reads a slice of the corpus by offset alone. There are as many files as the texts' size asks for, so a task holds
no more than the document table of one file.

Files are written by tasks to the given folder, each under a name of the attempt
and then renamed, so a lost executor or a second attempt leaves no half file. The
manifest (one row per file) is a table; the number of ids before a file is a running
sum over it.

Defined results: null text is the empty text (its only id is the end id); rows of equal
``doc_id`` follow each other in any order; an empty table gives no documents.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm import simple8b
from trustloom.llm.common import materialise
from trustloom.llm.files import committed, reader
from trustloom.llm.tokenize import encoder

MAGIC = b"TLOOMS8B"
#: Blocks that are coded or decoded at once.
_GROUP = 256
_MANIFEST = "file_no bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def _files(docs: DataFrame, file_bytes: int) -> int:
    """One file per ``file_bytes`` of text; small inputs give every core two, of some megabytes at least."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).alias("bytes")).first()["bytes"] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // file_bytes), min(2 * cores, -(-size // (4 << 20))))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = 128 << 20) -> DataFrame:
    """Encode every text and write the files to ``folder`` (a URI with its store); returns the manifest with ``start``,
    the number of ids in all files before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId()
        path = f"{folder}/ids-{number:06d}.s8b"
        flags, names, sizes, offsets = bytearray(), array("q"), array("Q"), []
        n_ids = n_words = 0
        waiting: list[np.ndarray] = []
        held = 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with committed(path, context.taskAttemptId()) as out:
            out.write(MAGIC)

            def flush(keep: int) -> None:
                nonlocal waiting, held, n_words
                ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
                take = len(ids) if not keep else len(ids) // simple8b.BLOCK * simple8b.BLOCK
                for at in range(0, take, _GROUP * simple8b.BLOCK):
                    words, starts = simple8b.encode(ids[at : min(take, at + _GROUP * simple8b.BLOCK)])
                    offsets.append(starts + n_words)
                    n_words += len(words)
                    out.write(words.astype("<u8").tobytes())
                waiting, held = [ids[take:]], len(ids) - take

            def all_batches():
                yield first
                yield from batches

            for batch in all_batches():
                for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(ids.as_buffer(), "<u4")
                    flags.append(name is None)
                    names.append(name or 0)
                    sizes.append(len(part))
                    n_ids += len(part)
                    waiting.append(part)
                    held += len(part)
                    if held >= _GROUP * simple8b.BLOCK:
                        flush(1)
            flush(0)
            table = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
            tail = [table.astype("<u8"), np.frombuffer(flags, np.uint8), np.array(names, "<i8"), np.array(sizes, "<u8")]
            tail.append(np.array([n_ids, len(names), len(table), simple8b.BLOCK], "<u8"))
            rest = b"".join(x.tobytes() for x in tail) + MAGIC
            out.write(rest)
        row = [number, path, len(names), n_ids, len(MAGIC) + 8 * n_words + len(rest)]
        yield pa.RecordBatch.from_pylist([dict(zip(("file_no", "path", "n_docs", "n_ids", "n_bytes"), row))])

    narrow = docs.select("doc_id", "text")
    ordered = narrow.repartitionByRange(_files(narrow, file_bytes), F.col("doc_id")).sortWithinPartitions("doc_id")
    encode = encoder(tokenizer, end_id)
    manifest = materialise(ordered.mapInArrow(lambda batches: run(encode(batches)), _MANIFEST), "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian unsigned
    32-bit integers) of every document, from the files."""

    def documents(path: str, start: int) -> Iterator[pa.RecordBatch]:
        with reader(path) as f:
            size = f.size()
            f.seek(size - 40)
            foot = f.read(40)
            if foot[32:] != MAGIC:
                raise ValueError(f"{path} is not a whole file of token ids")
            n_ids, n_docs, n_blocks, block = (int(x) for x in np.frombuffer(foot[:32], "<u8"))
            at = size - 40 - 8 * n_blocks - 17 * n_docs
            f.seek(at)
            tail = f.read(8 * n_blocks + 17 * n_docs)
            table = np.frombuffer(tail[: 8 * n_blocks], "<u8").astype(np.int64)
            table = np.append(table, (at - len(MAGIC)) // 8)
            flags = np.frombuffer(tail, np.uint8, n_docs, 8 * n_blocks).astype(bool)
            names = np.frombuffer(tail, "<i8", n_docs, 8 * n_blocks + n_docs)
            sizes = np.frombuffer(tail, "<u8", n_docs, 8 * n_blocks + 9 * n_docs).astype(np.int64)
            left, done, doc = np.zeros(0, np.uint32), 0, 0
            for k in range(0, n_blocks, _GROUP):
                last = min(n_blocks, k + _GROUP)
                f.seek(len(MAGIC) + 8 * int(table[k]))
                words = np.frombuffer(f.read(8 * int(table[last] - table[k])), "<u8")
                count = min(n_ids, last * block) - k * block
                ids = simple8b.decode(words, table[k:last] - table[k], count).astype("<u4")
                left = np.concatenate((left, ids))
                ends = np.cumsum(sizes[doc:])
                whole = int(np.searchsorted(ends, len(left), side="right"))
                if not whole:
                    continue
                ends = ends[:whole]
                starts = ends - sizes[doc : doc + whole]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[doc : doc + whole], pa.int64(), mask=flags[doc : doc + whole]),
                        pa.array(starts + done + start, pa.int64()),
                        pa.array(sizes[doc : doc + whole], pa.int64()),
                        pa.array([left[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                doc += whole
                done += int(ends[-1])
                left = left[ends[-1] :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from documents(path, start)

    spread = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
