from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import functions as F

from lodestone.llm import warc

PAGES = "page_id long, url string, html string"


def rows_with_copies() -> list[tuple]:
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 30_000
    return [
        (5, "http://a/", big),
        (3, "http://b/", big),
        (9, None, None),
        (10, "http://c/", ""),
        (11, "http://d/\r\nX: y", "short"),
        (12, "http://e/", "short"),
        (13, "http://f/", "x" * 100),
        (14, "http://g/", "x" * 100),
        (15, "http://h/", "y" * 99),
        (16, "http://i/", "y" * 99),
        (17, "http://j/", "z" * warc.SEGMENT_BYTES),
        (18, "http://k/", "z" * (warc.SEGMENT_BYTES + 1)),
        (3, "http://b/", big),
        (None, "http://l/", "q" * 500),
        (20, "http://m/", "q" * 500),
    ]


def brute(rows: list[tuple]) -> list[tuple]:
    order = lambda x: (x is not None, x or 0)
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, data in payloads:
        first[data] = min(first.get(data, p), p, key=order)
    out = []
    for p, data in payloads:
        revisit = len(data) >= 100 and p != first[data]
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=lambda r: (order(r[0]), *map(str, r[1:])))


def test_round_trip(spark):
    rows = rows_with_copies()
    got = sorted((tuple(r) for r in warc.warc_round_trip(spark.createDataFrame(rows, PAGES)).collect()), key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))
    assert got == brute(rows)


def test_large_payloads_are_chunk_rows(spark, tmp_path):
    rows = rows_with_copies()
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(rows, PAGES), path)
    chunks = warc.read_chunks(spark, path)
    assert chunks.select(F.max("n_bytes")).first()[0] <= warc.SEGMENT_BYTES
    numbers = [r.chunk_no >> warc.PIECE_BITS for r in chunks.where("chunk_no > 0").collect()]
    assert numbers.count(2) >= 2
    # The chunks of a record, put together, are its payload.
    own = chunks.where("chunk_no > 0").orderBy("record_id", "chunk_no").dropDuplicates(["record_id", "chunk_no"])
    joined = {}
    for r in own.orderBy("record_id", "chunk_no").collect():
        joined.setdefault(r.record_id, bytearray()).extend(r.chunk)
    assert {bytes(b) for b in joined.values()} == {rows[0][2].encode(), rows[11][2].encode()}


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "archive"
    warc.write_warc(spark.createDataFrame([(1, "http://a/", "<p>hi")], PAGES), str(path))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in path.glob("*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>hi\r\n\r\n")
    headers, block = next(warc.parse_records(gzip.compress(data)))
    assert headers["warc-target-uri"] == "http://a/" and int(headers["content-length"]) == len(b"".join(block))


def test_archives_from_elsewhere(spark, tmp_path):
    """One gzip member a record, other cases of names, records of other types, a large one in one segment, no HTTP head."""
    big = bytes(range(256)) * 2000

    def record(kind: str, name: str, block: bytes, *more: str) -> bytes:
        head = ["WARC/1.0", f"warc-type: {kind}", f"WARC-RECORD-ID: <urn:x:{name}>", *more, f"content-LENGTH:{len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    found = [
        record("warcinfo", "i", b"software: none\r\n"), record("request", "q", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", "r", http + b"small", "Content-Type: application/http; msgtype=response", "X-Page-ID: 4"), record("resource", "s", b"plain\r\n\r\ntext"),
        record("response", "b", http + big, "content-type:Application/HTTP", "x-page-id: 5"), record("metadata", "m", b""), record("response", "e", http, "Content-Type: application/http"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(found))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_pages(spark, str(tmp_path)).collect()), key=str)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    assert got == sorted([(4, 5, digest(b"small")), (None, 13, digest(b"plain\r\n\r\ntext")), (5, len(big), digest(big)), (None, 0, digest(b""))], key=str)
    chunks = warc.read_chunks(spark, str(tmp_path))
    assert chunks.where("chunk_no > 0").count() == 1 + len(big) // warc.PIECE_BYTES and chunks.agg(F.max("n_bytes")).first()[0] <= warc.PIECE_BYTES


def test_nothing_of_an_archive_is_lost(spark, tmp_path):
    """Revisits of records that are elsewhere, heads with bare newlines, and blocks whose head never ends."""

    def record(kind: str, name: str, block: bytes, *more: str) -> bytes:
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{name}>", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http, endless = "Content-Type: application/http; msgtype=response", b"no head " * 40_000
    found = [
        record("response", "a", b"HTTP/1.1 200 OK\nA: b\n\nbody\r\n\r\nmore", http, "X-Page-ID: 1"), record("response", "b", endless, http, "X-Page-ID: 2"), record("response", "c", b"short", http, "X-Page-ID: 3"),
        record("revisit", "d", b"", "X-Page-ID: 4", "WARC-Refers-To: <urn:x:a>"), record("revisit", "e", b"", "X-Page-ID: 5"), record("revisit", "f", b"", "X-Page-ID: 6", "WARC-Refers-To: <urn:x:zz>"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(found))
    got = {r.page_id: (r.payload_digest, r.record_type, r.refers_to, r.problem) for r in warc.read_pages(spark, str(tmp_path)).collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    assert got == {
        1: (digest(b"body\r\n\r\nmore"), "response", None, None), 2: (digest(endless), "response", None, None), 3: (digest(b"short"), "response", None, None),
        4: (digest(b"body\r\n\r\nmore"), "revisit", 1, None), 5: (None, "revisit", None, "It names no record that it refers to."), 6: (None, "revisit", None, "The record it refers to is not in this archive."),
    }


def test_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://a/", "x" * 200)], PAGES)
    clashing = df.select("*", *[F.lit(1).alias(c) for c in ("digest", "p", "i", "size", "body", "revisit", "record_id", "first_id")])
    assert [(r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(clashing).orderBy("page_id").collect()] == [(1, "response", None), (2, "revisit", 1)]
    assert warc.warc_round_trip(df.limit(0)).count() == 0
