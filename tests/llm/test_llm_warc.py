"""Archives: round trips, revisits, chunks and broken input."""

import gzip
import hashlib
import io
import random

import pytest
from marketloom.llm import warc as W
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, kept string, chunk string, record string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", "z", "z") for r in rows], SCHEMA)


def plain(rows, least=W.REVISITS_FROM):
    bodies = [(k, (h or "").encode()) for k, _, h in rows]
    out = []
    for key, body in bodies:
        same = [k for k, b in bodies if b == body and k is not None]
        top = max(same, default=None)
        again = len(body) >= least and top is not None and key != top
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_of_odd_pages(spark, tmp_path):
    draw = random.Random(1)
    long = "".join(draw.choice("abc <>\r\né") for _ in range(900_000))
    body = "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 60
    rows = [(1, "http://a/ b\r\nX: y", body), (2, "http://a/2", body), (3, None, body), (None, "http://n", body), (4, "http://e", None), (5, "http://e", ""), (6, "é", "x" * 999), (7, "é", "x" * 999),
            (8, "l", long), (9, "l", long), (9, "l", long), (10, "y", "y" * 1000), (10, "y", "y" * 1000), (None, "q", "q" * 2000), (None, "q", "q" * 2000)]
    df = W.archived(pages(spark, rows), folder=str(tmp_path / "w"))
    assert got(df) == plain(rows)
    assert all(r.digest_agrees and r.problem is None for r in df.collect())


def test_empty_table(spark, tmp_path):
    assert W.archived(pages(spark, []), folder=str(tmp_path / "w")).count() == 0


def test_chunks_are_bounded_and_carry_running_digests(spark, tmp_path, monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(3 * W.CHUNK_BYTES + 17))
    index = W.write_archives(pages(spark, [(1, "u", text), (2, "u", "small")]), str(tmp_path / "w"))
    rows = W.chunk_table(index).filter("key = '1'").orderBy("chunk").collect()
    assert [r.chunk for r in rows] == [0, 1, 2, 3] and max(len(r["bytes"]) for r in rows) == W.CHUNK_BYTES and [r.last for r in rows] == [False] * 3 + [True]
    seen = b""
    for r in rows:
        seen += bytes(r["bytes"])
        assert r.payload_bytes == len(seen) and r.payload_digest == hashlib.sha1(seen).hexdigest()
    assert seen == text.encode()


def test_blocks_cut_archives_between_records(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(draw.choice("abcdefghijklmnop") for _ in range(3000))) for i in range(300)]
    index = W.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    one = index.collect()
    raw = open(one[0].file.removeprefix("file:"), "rb").read()
    assert gzip.decompress(raw).count(b"WARC-Type: response") == 300
    # Blocks of any size hold whole members.
    starts = [i for i in range(len(raw)) if raw[i:i + 3] == b"\x1f\x8b\x08"]
    members = [i for i in starts if _unpacks(raw[i:])]
    for at, stop in zip(members[1:5], [*members[2:5], members[5]], strict=True):
        found = list(W.read_block(io.BytesIO(raw[at:stop]), stop - at))
        assert len(found) == 1 and found[0][10] and found[0][11] is None


def _unpacks(raw):
    try:
        import zlib

        return zlib.decompressobj(31).decompress(raw, 8).startswith(b"WARC/")
    except zlib.error:
        return False


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_foreign_archives_without_gzip_and_broken_ones(spark, tmp_path, size):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 26\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n\r\n"
    body = record.replace(b"Content-Length: 26", b"Content-Length: %d" % len(b"HTTP/1.1 200 OK\r\n\r\nhello\r\n"))
    rows = list(W.read_block(io.BytesIO(body * 2), len(body) * 2, size))
    assert b"".join(r[6] for r in rows) == b"hello\r\n" * 2 and sum(r[10] for r in rows) == 2 and all(len(r[6]) <= size for r in rows)
    cut = list(W.read_block(io.BytesIO(body[:-8]), len(body) - 8, size))
    assert cut[-1][11].startswith("ValueError")
    (tmp_path / "x.warc").write_bytes(body)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(body) + b"\x1f\x8bnonsense")
    found = W.records(W.chunk_table(W.archives(spark, str(tmp_path)))).collect()
    assert sorted((r.record or "", r.payload_bytes or 0, r.problem is None) for r in found) == [("", 0, False), ("<a>", 7, True), ("<a>", 7, True)]


def test_lost_attempts_are_in_no_index(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "part-00000-999999-0000.warc.gz").write_bytes(b"left by a lost attempt")
    df = W.archived(pages(spark, [(1, "u", "a")]), folder=str(folder))
    assert got(df) == plain([(1, "u", "a")])


def test_least_size_is_a_parameter(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, "u", "b")]
    kinds = {r.key: (r.record_type, r.refers_to) for r in W.typed(pages(spark, rows), least=1).select("key", "record_type", "refers_to", F.lit(1)).collect()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}
