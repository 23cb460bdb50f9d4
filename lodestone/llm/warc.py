"""Operator 7: WARC archives written from a page table and read back.

Writing is one row a segment: a payload of more than ``SEGMENT_BYTES`` bytes is
cut, and each segment is a WARC record of its own (``WARC-Segment-Number``,
``WARC-Segment-Origin-ID``; the last one has ``WARC-Segment-Total-Length``), so
no record holds a large payload.  Records go through Spark's text writer
with the WARC record end as line separator, gzipped, ``FILE_RECORDS`` records a
file, which bounds the size of a file.

Reading takes one file a row, inflates it piecemeal and yields the chunk table
(record id, chunk number, bytes of the chunk), from which a payload that is in
one piece is digested at once.  The chunks of larger payloads are brought
together by record id in order of their numbers and run through one incremental
digest a record; no payload is put together in memory.  Archives from elsewhere
are read as well: header names in any case, one or many gzip members a file,
blocks with or without an HTTP head (one that ends within ``HEAD_BYTES``, at an empty
line of either kind), large records in one segment; a revisit of a record that is
not there stays, with the reason; records that
are no response, resource or revisit are passed over, and pages without an
``X-Page-ID`` header have a null id.

Of records with equal payloads of ``REVISIT_BYTES`` bytes or more the one with
the smallest page id is a response and the others revisit it; a revisit has no
payload, and what it stands for is resolved from the response that was read.

Defined results: null html is an empty payload; smaller payloads are all
responses; rows that repeat a page id and a payload are alike, responses or
revisits all; a page id may be null (it orders first); a null url has no target
header; an empty table makes an archive without records and an empty result.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, scratch_path

SEGMENT_BYTES = 1 << 16
FILE_RECORDS = 1000
REVISIT_BYTES = 100
RECORD_END = "\r\n\r\n"
#: Compressed bytes that are inflated at once.
INFLATE_BYTES = 1 << 18
#: Bytes of a block that are read at once: a segment and its HTTP head.
PIECE_BYTES = 2 * SEGMENT_BYTES
#: Bytes in which the head of an HTTP message has to end.
HEAD_BYTES = 1 << 16
#: Bits of a chunk number for the piece within its segment.
PIECE_BITS = 32
#: Rows of a batch of whole files, and of a batch of chunks.
FILE_BATCH, CHUNK_BATCH = 1, 128
#: The archives carry no clock, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"

_BLANK_LINE = re.compile(rb"\r?\n\r?\n")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(digest, first_id, true) of payloads of REVISIT_BYTES or more that occur more than once."""
    seen = pages.select("page_id", _payload().alias("p")).where(F.octet_length("p") >= REVISIT_BYTES).select("page_id", F.sha2("p", 256).alias("digest"))
    counted = seen.groupBy("digest").agg(F.min(F.struct("page_id")).alias("first"), F.count("*").alias("n"))
    return counted.where("n > 1").select("digest", F.col("first.page_id").cast("long").alias("first_id"), F.lit(True).alias("repeated"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def warc_records(pages: DataFrame) -> DataFrame:
    """(record): the bytes of each WARC record, as a string column that the text writer takes."""
    # Written, so that its size decides how it is joined.
    repeated = materialize(repeated_payloads(pages), "warc-repeated")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\\r\\n]", "").alias("url"), _payload().alias("p"))
    rows = rows.withColumn("digest", F.sha2("p", 256)).join(repeated, "digest", "left")
    revisit = F.coalesce("repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    size = F.octet_length("p").cast("long")
    n_segments = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / SEGMENT_BYTES).cast("int")))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("p")).cast("binary")
    judged = rows.withColumn("revisit", revisit).withColumn("size", size).select("page_id", "url", "digest", "first_id", "revisit", "size", body.alias("body"))
    # The numbers first, then one segment a row: a payload's segments are never there together.
    numbered = judged.select("*", F.explode(F.sequence(F.lit(0), n_segments - 1)).alias("i"))
    cut = numbered.select("page_id", "url", "digest", "first_id", "revisit", "size", "i", F.substring("body", F.col("i") * SEGMENT_BYTES + 1, F.lit(SEGMENT_BYTES)).alias("segment"))

    own, number, of_many = _record_id(F.col("page_id"), F.col("digest")), F.col("i") + 1, F.col("size") > SEGMENT_BYTES
    many = of_many & ~F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.when(F.col("i") == 0, http).otherwise(F.lit("")).cast("binary"), F.col("segment"))
    kind = F.when(F.col("i") > 0, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    piece_id = F.when(F.col("i") == 0, own).otherwise(_record_id(F.col("page_id"), F.concat_ws("/", "digest", F.col("i").cast("string"))))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", piece_id),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("first_id"), F.col("digest")))),
        _header("WARC-Profile", F.when(F.col("revisit"), F.lit(_REVISIT_PROFILE))),
        _header("WARC-Segment-Number", F.when(many, number)),
        _header("WARC-Segment-Origin-ID", F.when(F.col("i") > 0, own)),
        _header("WARC-Segment-Total-Length", F.when(many & (number * SEGMENT_BYTES >= F.col("size")), F.octet_length(http) + F.col("size"))),
        _header("X-Page-ID", F.col("page_id")),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length(F.col("block"))),
    )
    blocks = cut.withColumn("block", block)
    return blocks.select(F.concat(F.concat(head, F.lit("\r\n\r\n")).cast("binary"), "block").cast("string").alias("value"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a WARC archive of the pages, as gzipped files below ``path``."""
    warc_records(pages).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(path, compression="gzip")


def _inflated(data: bytes) -> Iterator[bytes]:
    inflate, rest = zlib.decompressobj(31), memoryview(data)
    while len(rest):
        yield inflate.decompress(rest[:INFLATE_BYTES])
        rest = rest[INFLATE_BYTES:]
        if inflate.eof and (unused := inflate.unused_data + bytes(rest)):
            inflate, rest = zlib.decompressobj(31), memoryview(unused)
    yield inflate.flush()


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers by lower-case name, pieces of the block) of the records of a gzipped archive file.

    A piece has at most PIECE_BYTES bytes; what is left of a block is passed
    over when the next record is asked for.
    """
    parts, buffer, at = _inflated(data), bytearray(), 0

    def need(end: int) -> bool:
        while len(buffer) < end:
            part = next(parts, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    def pieces(size: int) -> Iterator[bytes]:
        nonlocal at
        while size:
            n = min(size, PIECE_BYTES)
            if not need(at + n):
                raise ValueError("the archive ends within a record")
            piece = bytes(buffer[at : at + n])
            at, size = at + n, size - n
            if at > INFLATE_BYTES:
                del buffer[:at]
                at = 0
            yield piece

    while True:
        while need(at + 2) and buffer.startswith(b"\r\n", at):
            at += 2
        while (stop := buffer.find(b"\r\n\r\n", at)) < 0:
            if not need(len(buffer) + 1):
                return
        # A line that begins with a space goes on with the one before it.
        lines = bytes(buffer[at:stop]).decode(errors="replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
        headers = {name.strip().lower(): value.strip() for name, found, value in (line.partition(":") for line in lines[1:]) if found}
        at = stop + 4
        block = pieces(int(headers["content-length"]))
        yield headers, block
        for _ in block:
            pass


@contextlib.contextmanager
def _batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch, for plans that are run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_CHUNKS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("chunk_no", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("chunk", pa.binary())]
)
_CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_to_record string, chunk_no long, n_bytes long, digest string, chunk binary"


def _payload_pieces(headers: dict[str, str], block: Iterator[bytes]) -> Iterator[bytes]:
    """A block without the head of an HTTP message, if it is one."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        yield from block
        return
    head = b""
    for piece in block:
        head += piece
        if found := _BLANK_LINE.search(head):
            if rest := head[found.end() :]:
                yield rest
            yield from block
            return
        if len(head) > HEAD_BYTES:
            break
    # No head ends within the bound: all of it is payload.
    for at in range(0, len(head), PIECE_BYTES):
        yield head[at : at + PIECE_BYTES]
    yield from block


def _chunk_rows(data: bytes) -> Iterator[tuple]:
    """Rows of the chunk table; records that are no payload of a page are passed over."""
    for headers, block in parse_records(data):
        kind, number = headers.get("warc-type", ""), int(headers.get("warc-segment-number", 0))
        if kind not in ("response", "resource", "revisit", "continuation"):
            continue
        page_id = headers.get("x-page-id")
        record = (headers.get("warc-segment-origin-id") or headers["warc-record-id"], page_id and int(page_id), "response" if kind == "resource" else kind, headers.get("warc-refers-to"))
        pieces = _payload_pieces(headers, block) if number < 2 else block
        first = next(pieces, b"")
        second = next(pieces, None)
        if not number and second is None:
            yield *record, 0, len(first), hashlib.sha256(first).hexdigest(), None
            continue
        # Pieces of a segment are numbered below it, so a large record that was not segmented is in chunks too.
        base = max(1, number) << PIECE_BITS
        yield *record, base, len(first), None, first
        for i, piece in enumerate(pieces if second is None else chain([second], pieces), 1):
            yield *record, base + i, len(piece), None, piece


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive; chunk_no 0: the record is whole, digested and has no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in _chunk_rows(content.as_py()):
                    rows.append(row)
                    if len(rows) == CHUNK_BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(_CHUNKS.names, r, strict=True)) for r in rows], schema=_CHUNKS)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(_CHUNKS.names, r, strict=True)) for r in rows], schema=_CHUNKS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    with _batch_rows(spark, FILE_BATCH):
        return materialize(files.mapInArrow(run, _CHUNK_SCHEMA), "warc-chunks")


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """(record_id, page_id, n_bytes, digest) of records in several chunks."""
    out = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, page, size, seen, first, copies, digest = None, None, 0, 0, 0, 0, hashlib.sha256()

        def done() -> pa.RecordBatch:
            row = {"record_id": current, "page_id": page, "n_bytes": size, "digest": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([row] * copies, schema=out)

        for batch in batches:
            for record_id, page_id, number, chunk in zip(*(batch.column(i) for i in range(4)), strict=True):
                if record_id.as_py() != current:
                    if current is not None:
                        yield done()
                    current, page, size, seen, copies, digest = record_id.as_py(), page_id.as_py(), 0, 0, 0, hashlib.sha256()
                first = number.as_py() if seen == 0 else first
                copies += number.as_py() == first
                # A repeated row has each of its chunks again.
                if number.as_py() > seen:
                    data = chunk.as_buffer()
                    digest.update(data)
                    size, seen = size + len(data), number.as_py()
        if current is not None:
            yield done()

    ordered = chunks.where("chunk_no > 0").select("record_id", "page_id", "chunk_no", "chunk").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    with _batch_rows(chunks.sparkSession, CHUNK_BATCH):
        return materialize(ordered.mapInArrow(run, "record_id string, page_id long, n_bytes long, digest string"), "warc-digests")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, problem.

    A revisit whose response was not read has no digest and says so in ``problem``.
    """
    chunks = read_chunks(spark, path)
    whole = chunks.where("chunk_no = 0 and record_type = 'response'").select("record_id", "page_id", "n_bytes", "digest")
    responses = whole.union(digest_chunks(chunks))
    targets = responses.groupBy("record_id").agg(F.first("page_id").alias("target_page"), F.first("n_bytes").alias("n_bytes"), F.first("digest").alias("digest"))
    revisits = chunks.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id"), "page_id").join(targets, "record_id", "left")
    none = F.lit(None).cast("long")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    problem = F.when(F.col("record_id").isNull(), F.lit("It names no record that it refers to.")).when(F.col("digest").isNull(), F.lit("The record it refers to is not in this archive."))
    own = responses.select("page_id", "n_bytes", "digest", F.lit("response"), none, F.lit(None).cast("string")).toDF(*out)
    return own.union(revisits.select("page_id", "n_bytes", "digest", F.lit("revisit"), "target_page", problem).toDF(*out))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as an archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_pages(spark, path).drop("problem")
