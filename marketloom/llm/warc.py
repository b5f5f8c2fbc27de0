"""WARC archives written from pages and read back as a table of chunks.

A payload never has to stand in a task's Python memory as a whole. Writing, the JVM deals every body out in chunks
(``_chunks``), and the writer feeds them to a gzip member of their own as they come. Reading, a record is a run of rows
(record id, chunk number) of at most ``CHUNK_BYTES``; each row carries how many bytes of the payload have been read and
the digest of all of them so far, so the row marked ``last`` holds the length and the digest of the whole payload.

1. The digest and length of each body come from one scan of the pages. Bodies of ``least`` bytes or more that stand
   in several rows are counted by digest; of those the row with the largest key is the response, and the others become
   ``revisit`` records (identical payload digest) which keep only their HTTP header and refer to it.
2. A task writes archives of its own, named after its attempt, of about ``ARCHIVE_BYTES``. What it has written becomes
   one row per ``BLOCK_BYTES`` (file, offset, length) in an index, which Spark commits; files of attempts that were
   lost are in no index and are never read.
3. Blocks, which hold whole gzip members, are dealt to tasks and streamed; a record larger than a block is a block.

Python opens archives through ``pyarrow.fs`` (local and shared folders, and the object stores it knows); pages are only
read by Spark.

Defined results: a null body is empty; a null address is ``urn:none``; control characters and blanks in addresses and
keys are percent-encoded; of equal bodies all rows that share the largest key are responses, a null key is the largest only if all
are null, and then all of them are responses; an empty table gives an index without rows. A record that cannot be read
gives one row with ``problem`` and ends its block.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import free, parts, shared_folder, stored

REVISITS_FROM = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 18
#: An Arrow batch of the chunks that the JVM hands to a writer holds about so much.
BATCH_BYTES = 64 << 20
BROADCAST_BYTES = 8 << 20
READ_BYTES = 1 << 18
HEADER_BYTES = 1 << 20
LEVEL = 6
INDEX = "file string, offset long, length long, records long"
RECORDS = pa.schema([
    ("record", pa.string()), ("key", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int64()), ("bytes", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("last", pa.bool_()), ("problem", pa.string())])
CHUNKS = "record string, key string, record_type string, target string, refers_to string, chunk long, bytes binary, payload_bytes long, payload_digest string, stated_digest string, last boolean, problem string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, as Hadoop writes them, and the path in it."""
    if "://" not in path:
        path = re.sub(r"^file:/*", "/", path)
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def chunk_bytes(spark: SparkSession) -> int:
    """How many bytes a chunk for the writer holds, so that a full Arrow batch of them stays near ``BATCH_BYTES``."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return max(4096, min(CHUNK_BYTES, BATCH_BYTES // rows)) if rows > 0 else CHUNK_BYTES


def typed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISITS_FROM) -> DataFrame:
    """(key, target, body, digest, n, record_type, refers_to) of every page; ``refers_to`` is the response's key."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("target"), body.alias("body")).withColumn("digest", F.sha1("body")).withColumn("n", F.octet_length("body").cast("long"))
    # One small row for each body that stands in several rows; stored, so that its size is known and not guessed.
    several = stored(rows.filter(F.col("n") >= least).groupBy(F.col("digest").alias("d"), F.col("n").alias("b")).agg(F.max("key").alias("top"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    met = rows.join(broadcast_if_small(several, BROADCAST_BYTES), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("b")), "left")
    again = F.col("top").isNotNull() & ~F.col("key").eqNullSafe(F.col("top"))
    return met.select("key", "target", "body", "digest", "n", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of ``typed`` as chunks, in their order. A revisit has one, without bytes."""
    n = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.ceil(F.col("n") / size), F.lit(1)))
    some = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk"))
    piece = F.when(F.col("record_type") == "response", F.substring("body", (F.col("chunk") * size + 1).cast("int"), F.lit(size)))
    return some.select(F.col("key").cast("string").alias("key"), "target", "digest", "n", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "chunk", piece.alias("piece"))


def _quoted(text: str | None) -> str:
    return urllib.parse.quote(text, safe="!#$%&'()*+,/:;=?@[]~-._", encoding="utf-8") if text else "urn:none"


def record_id(key: str | None) -> str:
    """The id of the response of ``key``; rows with one key share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'urn:none' if key is None else f'key:{key}')}>"


def _head(row: dict, length: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['key'])}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_quoted(row['target'])}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + length}"]
    if row["key"] is not None:
        lines.append(f"X-Source-Key: {urllib.parse.quote(row['key'], safe='-._~')}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Key: {urllib.parse.quote(row['refers_to'], safe='-._~')}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archives:
    """The archives of one task: gzip members one after another, and the index of their blocks."""

    def __init__(self, folder: str, name: str):
        self.files, self.root = _opened(folder)
        self.folder, self.name, self.count, self.out = folder.rstrip("/"), name, 0, None
        self.files.create_dir(self.root, recursive=True)

    def open(self) -> None:
        self.file, self.at, self.start, self.records = f"{self.name}-{self.count:04d}.warc.gz", 0, 0, 0
        self.out, self.count = self.files.open_output_stream(f"{self.root.rstrip('/')}/{self.file}", compression=None), self.count + 1
        body = b"software: marketloom\r\nformat: WARC File Format 1.1\r\n"
        self.begin()
        self.feed(b"\r\n".join([b"WARC/1.1", b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.file)}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Type: application/warc-fields", f"Content-Length: {len(body)}".encode(), b"", body]))
        self.end()

    def begin(self) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def feed(self, data: bytes, last: bool = False) -> None:
        done = self.member.compress(data) + (self.member.flush() if last else b"")
        if done:
            self.out.write(done)
            self.at += len(done)

    def end(self) -> None:
        self.feed(b"\r\n\r\n", last=True)
        self.records += 1

    def block(self) -> tuple[str, int, int, int]:
        row = (f"{self.folder}/{self.file}", self.start, self.at - self.start, self.records)
        self.start, self.records = self.at, 0
        return row


def _written(folder: str):
    def run(batches):
        task = TaskContext.get()
        own = _Archives(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}")
        index = []
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {c: v[i].as_py() for c, v in columns.items()}
                if row["chunk"] == 0:
                    if own.out is None:
                        own.open()
                    own.begin()
                    left = row["n"] if row["record_type"] == "response" else 0
                    own.feed(_head(row, left))
                piece = row["piece"] or b""
                own.feed(piece)
                left -= len(piece)
                if left == 0:
                    own.end()
                    if own.at - own.start >= BLOCK_BYTES:
                        index.append(own.block())
                    if own.at >= ARCHIVE_BYTES:
                        if own.at > own.start:
                            index.append(own.block())
                        own.out.close()
                        own.out = None
        if own.out is not None:
            if own.at > own.start:
                index.append(own.block())
            own.out.close()
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISITS_FROM) -> DataFrame:
    """(file, offset, length, records): the index of what has been written to ``folder``, itself stored."""
    rows = typed(pages, key, url, html, least)
    return stored(_chunks(rows, chunk_bytes(pages.sparkSession)).mapInArrow(_written(folder), INDEX))


def archives(spark: SparkSession, folder: str, pattern: str = "*.warc*") -> DataFrame:
    """The same index for archives from elsewhere, gzipped or not: a block for every file. Only their names and lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("offset"), F.col("length"), F.lit(None).cast("long").alias("records"))


class _Bytes:
    """A stream of what a block holds, taken out of its gzip members where it has any."""

    def __init__(self, handle, length: int):
        self.handle, self.left, self.held, self.packed, self.inner = handle, length, bytearray(), None, None

    def more(self) -> bool:
        """Take in one read, however long what it unpacks to is; False at the end."""
        raw = b"" if self.inner is None else self.inner.unused_data if self.inner.eof else self.inner.unconsumed_tail
        if not raw and self.left > 0:
            raw = self.handle.read(min(READ_BYTES, self.left))
            self.left = self.left - len(raw) if raw else 0
        if not raw and (self.inner is None or self.inner.eof):
            return False
        if self.packed is None:
            self.packed = raw[:2] == b"\x1f\x8b"
        if not self.packed:
            self.held += raw
            return True
        if self.inner is None or self.inner.eof:
            self.inner = zlib.decompressobj(31)
        # What the member still holds comes out without new input; a member that gives nothing more has been cut off.
        out = self.inner.decompress(raw, READ_BYTES)
        self.held += out
        return bool(raw or out)

    def until(self, mark: bytes, most: int) -> bytes:
        """All up to and with ``mark``."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most or not self.more():
                raise ValueError("no end of a header")
        return self.take(at + len(mark))

    def take(self, most: int) -> bytes:
        """At least one byte and at most ``most``, unless the stream has ended."""
        while not self.held and self.more():
            pass
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def ended(self) -> bool:
        while not self.held.lstrip(b"\r\n"):
            self.held.clear()
            if not self.more():
                return True
        while self.held[:1] in (b"\r", b"\n"):
            del self.held[:1]
        return False


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _hex(stated: str | None) -> str | None:
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()


def read_block(handle, length: int, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The chunks of every response, revisit and resource in a block, in the order of ``RECORDS``."""
    stream, name = _Bytes(handle, length), None
    try:
        while not stream.ended():
            start = stream.until(b"\r\n\r\n", HEADER_BYTES)
            if not start.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            head = _fields(start)
            name, kind, left = head.get("warc-record-id"), head.get("warc-type"), int(head["content-length"])
            key, refers = (urllib.parse.unquote(head[c]) if c in head else None for c in ("x-source-key", "x-refers-to-key"))
            about = (name, key, kind, head.get("warc-target-uri"), refers or head.get("warc-refers-to"))
            stated = _hex(head.get("warc-payload-digest"))
            shown = kind in ("response", "revisit", "resource")
            size_of_http = None
            if shown and left and head.get("content-type", "").startswith("application/http"):
                http = stream.until(b"\r\n\r\n", HEADER_BYTES)
                left -= len(http)
                size_of_http = _fields(http).get("content-length")
            if kind == "revisit":
                while left > 0 and (piece := stream.take(min(size, left))):
                    left -= len(piece)
                yield (*about, 0, None, int(size_of_http) if size_of_http else None, stated, stated, True, None)
                name = None
                continue
            digest, done, chunk = hashlib.sha1(), 0, 0
            while left > 0 or chunk == 0:
                piece = b""
                while len(piece) < min(size, left):
                    got = stream.take(min(size, left) - len(piece))
                    if not got:
                        raise ValueError("a record ends early")
                    piece += got
                left -= len(piece)
                digest.update(piece)
                done += len(piece)
                if shown:
                    yield (*about, chunk, piece, done, digest.hexdigest(), stated, left == 0, None)
                chunk += 1
            name = None
    except (ValueError, KeyError, zlib.error) as problem:
        yield (name, None, None, None, None, 0, None, None, None, None, True, f"{type(problem).__name__}: {problem}"[:500])


def _read(batches):
    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), RECORDS, strict=True)], schema=RECORDS)

    for blocks in batches:
        for file, offset, length in zip(*(blocks.column(i).to_pylist() for i in range(3)), strict=True):
            files, path = _opened(file)
            held, size = [], 0
            with files.open_input_file(path) as handle:
                handle.seek(offset)
                for row in read_block(handle, length):
                    held.append(row)
                    size += len(row[6] or b"") + 300
                    if size >= BATCH_BYTES // 8:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)


def chunk_table(index: DataFrame) -> DataFrame:
    """The chunk rows of every record of the blocks in ``index`` (file, offset, length, ...)."""
    total = index.agg(F.sum(F.greatest("length", F.lit(1))).alias("n"), F.count("*").alias("blocks")).first()
    tasks = max(1, min(total.blocks, parts(total.n or 0, BLOCK_BYTES)))
    dealt = index.select("file", "offset", "length").repartition(tasks, F.xxhash64("file", "offset"))
    return dealt.mapInArrow(_read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row for every record, without a shuffle: its last chunk knows the length and the digest of them all."""
    return chunks.filter("last").select("record", "key", "record_type", "target", "refers_to", "payload_bytes", "payload_digest", F.coalesce(F.col("stated_digest") == F.col("payload_digest"), F.lit(True)).alias("digest_agrees"), "problem")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """``pages`` written to ``folder`` (a new one under the shared folder) and read back: a row for every record. ``key`` keeps its type."""
    index = write_archives(pages, folder or f"{shared_folder(pages.sparkSession)}/warc", key, url, html)
    (name,) = free(pages.select(), key)
    kind = pages.schema[key].dataType
    rows = records(chunk_table(index))
    return rows.select(F.col("key").cast(kind).alias(name), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "target", "digest_agrees", "problem")
