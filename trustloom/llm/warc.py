"""WARC archives: writing, reading and transaction assembly.

Each capture is written as a request, a response (or a revisit of an earlier capture
with an equal payload) and a metadata record; request and metadata name
the response in WARC-Concurrent-To. Each record is a gzip member of its own, so that a reader can start at any record. The members
are written by Spark's own text writer, one per line with an empty gzip member as line end, so that a lost executor or a
second attempt leaves no half file; bytes go through as they are. Reading inflates the members, parses records by
Content-Length, joins the records of a capture through the concurrent-to identifiers, resolves
revisits, and gives one nested row per capture.

Groups of equal payloads: the first page of a digest is a map-side minimum, so a group of any size is
one row per task; the pages of a group meet it in a shuffled join, of which Spark splits hot digests.

Defined results: a null payload is empty; a null url is the empty target; payloads below
``min_bytes`` are never revisits; of repeated rows of one ``page_id`` all are captures of their own, all
``response`` if they are the first of their payload; a null ``page_id`` comes after every other; an
empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import materialise

#: Ends every record.
END = "\r\n\r\n"
#: The line end of the text writer, as Latin-1 text.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
VERSION = "WARC/1.1"
#: Records of a file at most; a reading task holds one file.
_FILE_RECORDS = 30_000
_BATCH_BYTES = 8 << 20
_RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, computed_digest string, payload_bytes bigint, fields map<string,string>, payload binary"
)


def _record_id(kind: str, key: str = "_key") -> Column:
    """A name-based identifier (urn:uuid) of the capture and the record's kind."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), F.col(key)), 256)
    cuts = ((1, 8, "-"), (9, 4, "-5"), (14, 3, "-a"), (18, 3, "-"), (21, 12, ">"))
    return F.concat(F.lit("<urn:uuid:"), *[x for at, n, sep in cuts for x in (F.substring(h, at, n), F.lit(sep))])


def _record(kind: Column | str, record_id: Column, block: Column, **headers: Column) -> Column:
    """Bytes of a record without its end; a header whose value is null is left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit("WARC-Date: 1970-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(name.replace("_", "-") + ": "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit(END).cast("binary"), block)


def decide_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``_key``, ``first_key`` and ``first_id`` of the rows that revisit another's payload."""
    narrow = pages.select("_key", "page_id", "_bytes", "_digest").filter(F.col("_bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_key")
    firsts = (
        narrow.groupBy(F.col("_digest").alias("_first_digest"))
        .agg(F.min(rank).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("_first_digest", F.col("first._key").alias("first_key"), F.col("first.page_id").alias("first_id"))
    )
    firsts = materialise(firsts, "warc-firsts")
    same = narrow["page_id"].eqNullSafe(firsts["first_id"])
    return narrow.join(firsts, narrow["_digest"] == firsts["_first_digest"]).filter(~same).select("_key", "first_key", "first_id")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 100) -> None:
    """Write archives of ``pages`` (page_id, url, payload: string or binary) to ``folder``.

    A file holds what one shuffle partition holds, so its size is bounded by
    the partition size that adaptive execution aims at (and by a single capture).
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    keyed = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("_url"), payload.alias("_payload"), F.sha2(payload, 256).alias("_digest")
    ).select(
        "*",
        F.octet_length("_payload").cast("long").alias("_bytes"),
        F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "_url", "_digest").alias("_key"),
    )
    revisits = materialise(decide_revisits(keyed, min_bytes), "warc-revisits").distinct()
    joined = keyed.join(revisits, "_key", "left")
    again = F.col("first_key").isNotNull()
    response = _record_id("response")
    target = F.regexp_replace(F.col("_url"), r"[\r\n]", " ")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n").cast("binary")
    refers = F.when(again, _record_id("response", "first_key"))
    records = F.array(
        _record("request", _record_id("request"), F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")).cast("binary"),
                WARC_Concurrent_To=response, WARC_Target_URI=target, Content_Type=F.lit("application/http; msgtype=request")),
        _record(F.when(again, "revisit").otherwise("response"), response, F.when(again, http).otherwise(F.concat(http, F.col("_payload"))),
                WARC_Target_URI=target, WARC_Payload_Digest=F.concat(F.lit("sha256:"), F.col("_digest")),
                WARC_Profile=F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                WARC_Refers_To=refers, Content_Type=F.lit("application/http; msgtype=response")),
        _record("metadata", _record_id("metadata"),
                F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
                            F.concat(F.lit("refers-to-page-id: "), F.col("first_id").cast("string")), F.lit("")).cast("binary"),
                WARC_Concurrent_To=response, WARC_Target_URI=target, Content_Type=F.lit("application/warc-fields")),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                packed = [gzip.compress(r.as_py() + END.encode(), 6, mtime=0) for r in batch.column(0).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["record"])

    lines = joined.select(F.explode(records).alias("record")).mapInArrow(members, "record binary")
    writer = lines.select(F.col("record").cast("string").alias("value")).write.option("compression", "none")
    writer.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER).option("maxRecordsPerFile", _FILE_RECORDS).text(folder)


def _inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members, or of a plain one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            piece = view[at : at + (1 << 14)]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


def _parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    held, at, pieces, end = bytearray(), 0, _inflated(content), END.encode()

    def more(inside: bool) -> bool:
        piece = next(pieces, None)
        if piece is None and inside:
            raise ValueError("the archive ends within a record")
        held.extend(piece or b"")
        return piece is not None

    while True:
        if at > 1 << 22:
            del held[:at]
            at = 0
        while (stop := held.find(end, at)) < 0:
            if not more(inside=bool(held[at:].strip())):
                return
        version, *lines = held[at:stop].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, start = int(headers["content-length"]), stop + len(end)
        while len(held) < start + size + len(end):
            more(inside=True)
        at = start + size + len(end)
        yield headers, bytes(held[start : start + size])


def read_records(spark, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``folder``. ``payload`` is null unless ``payloads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ", 1)[0] for x in _RECORDS.split(", ")]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for content in batch.column(0):
                for h, block in _parsed(content.as_py()):
                    kind, fields, payload = h.get("warc-type"), [], None
                    if kind == "metadata":
                        pairs = (x.partition(": ") for x in block.decode("utf-8", "replace").split("\r\n") if x)
                        fields = [(k, v) for k, _, v in pairs]
                    elif kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    whole = kind == "response"
                    row = (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"))
                    row += (h.get("warc-payload-digest"), sha256(payload).hexdigest() if whole else None, len(payload) if whole else None)
                    rows.append((*row, fields, payload if whole and payloads else None))
                    held += len(block) if payloads else 500
                    if held >= _BATCH_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` (a response or a revisit), ``request``, ``metadata`` and, for
    revisits, ``original``, the response that they refer to.

    ``records`` is read several times, so it should be a written table.
    """
    mains = records.filter(F.col("type").isin("response", "revisit"))
    own = F.struct("record_id", "type", "target_uri", "payload_digest", "computed_digest", "payload_bytes", "payload")
    captures = mains.select(F.col("record_id").alias("_id"), F.col("refers_to").alias("_refers_to"), own.alias("response"))
    for kind in ("request", "metadata"):
        side = records.filter(F.col("type") == kind).select(
            F.col("concurrent_to").alias("_id"), F.struct("record_id", "target_uri", "fields").alias(kind)
        )
        captures = captures.join(side.dropDuplicates(["_id"]), "_id", "left")
    originals = records.filter(F.col("type") == "response").select(
        F.col("record_id").alias("_refers_to"), F.struct("record_id", "payload_bytes", "computed_digest").alias("original")
    )
    originals = materialise(originals.dropDuplicates(["_refers_to"]), "warc-originals")
    return captures.join(originals, "_refers_to", "left").select(
        F.col("_id").alias("capture_id"), "request", "response", "metadata", "original"
    )
