"""Removes every byte inside a string of ``LENGTH`` bytes that also starts anywhere else, by sorting suffixes.

Not every suffix is sorted. In each string of ``LENGTH`` bytes the place with the least hash among its first
``SPAN`` + 1 is its anchor; equal strings have equal anchors, so it is enough to compare the suffixes at the
anchors, one in about ``SPAN`` / 2, together with the bytes before them that belong to the same strings.

1. Tasks read whole texts and give each anchor two fingerprints: of the ``LENGTH - SPAN`` bytes that every string
   of the anchor shares, and of all bytes its strings cover. Anchors whose first fingerprint stands alone go.
   Anchors with equal second fingerprints are copies through and through; one stands for them.
2. The anchors that are left fetch their bytes. Sampled splitters range-partition these suffixes by their leading
   bytes; a run of equal leading bytes may go on in the next bucket.
3. A bucket sorts its suffixes, and the bytes before its anchors read backwards, by multikey quicksort: all ties are
   sorted by the next eight bytes, level by level, which also gives the common prefixes. Two strings at the same
   distance from their anchors are equal if and only if they share enough of both, so what starts twice is read off
   the two orders exactly.
4. Runs that touch a bucket's boundary are compared across boundaries by fingerprints, so a run with a third of all
   rows is spread over many buckets: first what each ``GROUP`` neighbouring strings have in common, and only where
   that stands in two rows the strings themselves.
5. The strings found give spans of bytes for each text, and the rest is hashed.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all; matches neither cross texts nor
depend on ids, and a row that is repeated counts as two texts; very long texts are read in overlapping pieces;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, parts, stored, texts

LENGTH = 400
SPAN = 200
SHARED = LENGTH - SPAN
PIECE_BYTES = 1 << 18
BUCKET_ROWS = 20_000
GROUP = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _doubled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 32, 128 and 256 bytes that begin at every byte, each from two of half the length."""
    own, out = data.astype(np.uint64) * _FACTOR + np.uint64(0x632BE59BD9B4E019), {}
    for k in (1, 2, 4, 8, 16, 32, 64, 128):
        longer = own[:-k] * _FACTOR
        longer += own[k:]
        longer ^= longer >> np.uint64(29)
        own = longer
        if 2 * k in (32, 128, 256):
            out[2 * k] = mixed(own) if k == 16 else own
    return out


def _anchors(data: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, ...]:
    """(anchor, first string, last string, shared fingerprint, full fingerprint) of every anchor of the pieces in ``data``."""
    if len(data) < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 5
    hashes = _doubled(data)
    bits = max(18, int(len(data)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (hashes[32] & ~low) | np.arange(len(hashes[32]), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32, 64):
        least = np.minimum(least[:-k], least[k:])
    strings = len(data) - LENGTH + 1
    shift = SPAN + 1 - 128
    place = (np.minimum(least[:strings], least[shift:shift + strings]) & low).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)[:strings]
    whole = np.flatnonzero(np.arange(strings) + LENGTH <= ends)
    own = place[whole]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), dtype=bool), own[1:] != own[:-1])))
    first, anchor = whole[new], own[new]
    last = whole[np.append(new[1:], len(own)) - 1] if len(own) else first
    shared = mixed(hashes[128][anchor] * _FACTOR + hashes[128][anchor + SHARED - 128])
    size = last - first + LENGTH
    full = mixed(hashes[256][first] * _FACTOR + hashes[256][first + (size - 256) // 2])
    full = mixed(full * _FACTOR + hashes[256][first + size - 256])
    full = mixed(full + ((anchor - first) * 1024 + size).astype(np.uint64))
    return anchor, first, last, shared.view(np.int64), full.view(np.int64)


def _pieces(rows: list[int], bodies: list[bytes | None]):
    """(row, offset, bytes): texts in pieces that overlap by one byte less than a string."""
    for row, body in zip(rows, bodies, strict=True):
        body = body or b""
        for at in range(0, max(1, len(body) - LENGTH + 1), PIECE_BYTES):
            piece = body[at:at + PIECE_BYTES + LENGTH - 1]
            if len(piece) >= LENGTH:
                yield row, at, piece


def _found_anchors(batches):
    """(row, at, g, f): ``at`` packs the first string, the anchor's distance from it and the number of further strings."""
    def flushed(held):
        data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
        lengths = [len(p) for _, _, p in held]
        anchor, first, last, g, f = _anchors(data, lengths)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        piece = np.searchsorted(starts, first, side="right") - 1
        row = np.array([r for r, _, _ in held], dtype=np.int64)[piece]
        base = np.array([o for _, o, _ in held], dtype=np.int64)[piece] - starts[piece]
        at = (first + base) << 16 | (anchor - first) << 8 | (last - first)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at), pa.array(g), pa.array(f)], names=["row", "at", "g", "f"])

    for batch in batches:
        held, size = [], 0
        for piece in _pieces(batch.column(0).to_pylist(), texts(batch.column(1))):
            held.append(piece)
            size += len(piece[2])
            if size >= PIECE_BYTES:
                yield flushed(held)
                held, size = [], 0
        if held:
            yield flushed(held)


def _fetched(batches):
    """(g, f, right, left, low, high): the bytes of the anchors asked for; ``left`` runs backwards from the anchor."""
    kind = pa.schema([("g", pa.int64()), ("f", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
    for batch in batches:
        held = []
        for body, asked in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for one in asked:
                first, before, more = one["at"] >> 16, (one["at"] >> 8) & 255, one["at"] & 255
                anchor = first + before
                held.append((one["g"], one["f"], body[anchor:first + more + LENGTH], body[first:anchor][::-1], before - more, before))
                if len(held) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


def _keys(strings: list[bytes], size: int) -> np.ndarray:
    """The strings as rows of eight-byte numbers that compare like the bytes; short strings end in zeros."""
    room = -(-size // 8) * 8
    return np.frombuffer(b"".join(s.ljust(room, b"\0") for s in strings), dtype=">u8").reshape(len(strings), room // 8).astype(np.uint64)


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and for each the bytes it shares with the one before it (the first: none).

    Level by level, all rows that are still tied are sorted by their next key within their tie.
    """
    n, width = keys.shape
    order, cut = np.arange(n), np.zeros(n, dtype=bool)
    common = np.full(n, 8 * width, dtype=np.int64)
    if n:
        cut[0], common[0] = True, 0
    for level in range(width):
        tie = np.cumsum(cut)
        tied = np.flatnonzero(~cut | np.append(~cut[1:], False))
        if not len(tied):
            break
        key, own = keys[order[tied], level], tie[tied]
        by = np.lexsort((key, own))
        order[tied], key = order[tied][by], key[by]
        apart = np.flatnonzero((own[1:] == own[:-1]) & (key[1:] != key[:-1])) + 1
        differ = key[apart] ^ key[apart - 1]
        same = sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        cut[tied[apart]] = True
        common[tied[apart]] = 8 * level + same
    return order, common


def _prefix_hashes(strings: list[bytes], size: int) -> np.ndarray:
    """A fingerprint of every prefix of every string, a row for each length."""
    room = np.frombuffer(b"".join(s.ljust(size, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), size)
    out = np.empty((size + 1, len(strings)), dtype=np.uint64)
    out[0] = np.uint64(0xCBF29CE484222325)
    for k in range(size):
        out[k + 1] = ((out[k] ^ room[:, k]) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x100000001B3)
    return out


def compare(g: np.ndarray, f: np.ndarray, right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray):
    """What starts twice in one bucket, and what has to be compared with other buckets.

    Returns (f, low, high): the strings at distances ``low`` to ``high`` before the anchor, of which the ends start twice
    and what lies between them is covered; and (f, core, base, strings) of the runs at the boundary: the fingerprint of
    what ``GROUP`` strings from the distance ``base`` on have in common, and theirs, 0 for those not to be compared.
    """
    n = len(f)
    keys = _keys(right, LENGTH)
    by_right, after = multikey_sort(keys)
    by_left, before = multikey_sort(_keys(left, SPAN))
    # All in the order of the suffixes; ``turn`` is the place of each in the order of what stands before.
    place = np.empty(n, dtype=np.int64)
    place[by_left] = np.arange(n)
    turn, f, g, low, high = place[by_right], f[by_right], g[by_right], low[by_right], high[by_right]
    # Buckets are ranged by 16 leading bytes first, so a boundary may cut any run that has the least or greatest of these.
    lead = keys[by_right, :2]
    edge = (lead == lead[0]).all(axis=1) | (lead == lead[-1]).all(axis=1)
    least, most = np.full(n, LENGTH, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    at_edge = np.flatnonzero(edge)
    rows = by_right[at_edge]
    tail, head = (_prefix_hashes([x[i] for i in rows], s) for x, s in ((right, LENGTH), (left, SPAN)))
    groups = -(-(SPAN + 1) // GROUP)
    strings = np.zeros((len(at_edge), groups * GROUP), dtype=np.int64)
    for distance in range(SPAN + 1):
        use = np.flatnonzero((low <= distance) & (distance <= high))
        if not len(use):
            continue
        tie = np.cumsum(after < LENGTH - distance)
        alone = np.bincount(tie[use], minlength=tie[-1] + 1)[tie[use]] < 2
        some = use[~alone | edge[use]]
        if not len(some):
            continue
        name = tie[some] * (n + 1) + np.cumsum(before < distance)[turn[some]]
        _, first, which, often = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        twice = some[often[which] > 1]
        least[twice] = np.minimum(least[twice], distance)
        most[twice] = np.maximum(most[twice], distance)
        # Of equal strings one is compared with other buckets.
        stands = np.searchsorted(at_edge, some[first[edge[some[first]]]])
        h = mixed(tail[LENGTH - distance][stands] * _FACTOR + mixed(head[distance][stands] + np.uint64(distance)))
        strings[stands, distance] = h.view(np.int64)
    hit = np.flatnonzero(most >= 0)
    cores = []
    for base in range(0, groups * GROUP, GROUP):
        own = strings[:, base:base + GROUP]
        some = np.flatnonzero(own.any(axis=1))
        if len(some):
            core = mixed(tail[max(0, LENGTH - base - GROUP + 1)][some] * _FACTOR + mixed(head[min(base, SPAN)][some] + np.uint64(base)))
            cores.append((f[at_edge[some]], core.view(np.int64), np.full(len(some), base), own[some]))
    return (f[hit], least[hit], most[hit]), cores


FOUND = "f long, low int, high int, core long, strings array<long>"


def _compared(batches):
    kind = pa.schema([("f", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("core", pa.int64()), ("strings", pa.list_(pa.int64()))])
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    numbers = {c: rows[c].to_numpy() for c in ("g", "f", "low", "high")}
    (f, low, high), cores = compare(numbers["g"], numbers["f"], rows["right"].to_pylist(), rows["left"].to_pylist(), numbers["low"], numbers["high"])
    ints = lambda x: pa.array(x.astype(np.int32))
    if len(f):
        yield pa.RecordBatch.from_arrays([pa.array(f), ints(low), ints(high), pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.list_(pa.int64()))], schema=kind)
    for f, core, base, strings in cores:
        lists = pa.ListArray.from_arrays(np.arange(0, strings.size + 1, GROUP, dtype=np.int32), strings.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(f), ints(base), pa.nulls(len(f), pa.int32()), pa.array(core), lists], schema=kind)


def spans(docs: DataFrame) -> DataFrame:
    """(row, spans) of the texts of ``docs`` (row, text) that lose bytes; spans (start, end) may overlap."""
    anchors = docs.mapInArrow(_found_anchors, "row long, at long, g long, f long")
    # Written first: only a join of two plain shuffles can be split where one fingerprint is hot.
    shared = stored(anchors.groupBy("g").count().filter("count > 1").select("g"))
    met = stored(anchors.join(shared, "g"))
    kinds = stored(met.groupBy("g", "f").agg(F.min(F.struct("row", "at")).alias("one"), F.count("*").alias("copies")).select("g", "f", "one.row", "one.at", "copies"))
    several = stored(kinds.groupBy("g").count().filter("count > 1").select("g"))
    sought = stored(kinds.join(several, "g").select("g", "f", "row", "at"))
    buckets = parts(sought.count(), BUCKET_ROWS)
    asked = sought.groupBy("row").agg(F.collect_list(F.struct("at", "g", "f")).alias("asked"))
    fetched = docs.join(asked, "row").select("text", "asked").mapInArrow(_fetched, "g long, f long, right binary, left binary, low int, high int")
    ranged = fetched.repartitionByRange(buckets, F.substring("right", 1, 16), "g", F.substring("right", SHARED + 1, 8), "f")
    found = stored(ranged.mapInArrow(_compared, FOUND))
    cores = found.filter("core is not null")
    met_cores = cores.join(cores.groupBy("core").count().filter("count > 1").select("core"), "core")
    strings = met_cores.select("f", "low", F.posexplode("strings").alias("k", "h")).filter("h <> 0").select("f", "h", (F.col("low") + F.col("k")).alias("low"))
    crossed = strings.join(strings.groupBy("h").count().filter("count > 1").select("h"), "h").select("f", "low", F.col("low").alias("high"))
    # Copies through and through start twice at all their distances.
    before, more = F.shiftright("at", 8).bitwiseAND(255).cast("int"), F.col("at").bitwiseAND(255).cast("int")
    copies = kinds.filter("copies > 1").select("f", (before - more).alias("low"), before.alias("high"))
    twice = stored(found.filter("core is null").select("f", "low", "high").unionByName(crossed).unionByName(copies).groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    anchor = F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(255)
    covered = met.join(twice, "f").select("row", F.struct((anchor - F.col("high")).alias("start"), (anchor - F.col("low") + LENGTH).alias("end")).alias("span"))
    return covered.groupBy("row").agg(F.collect_set("span").alias("spans"))


def without(text: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs were taken."""
    out, at, runs, end = [], 0, 0, -1
    for start, stop in sorted(cuts):
        if start > end:
            runs += 1
            out.append(text[at:start])
        end = max(end, stop)
        at = end
    out.append(text[at:])
    return b"".join(out), runs


def _cut(array: pa.Array, cuts: pa.Array) -> pa.Array:
    rows = []
    for text, own in zip(texts(array), cuts.to_pylist(), strict=True):
        left, runs = without(text or b"", [(c["start"], c["end"]) for c in own or ()])
        rows.append((len(text or b"") - len(left), runs, hashlib.sha256(left).hexdigest(), left))
    a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary())], names=["n_removed", "n_spans", "kept_sha256", "kept"])


CUT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, text): rows equal in id and text share a name, and lose the same bytes."""
    return docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))


def repeats_removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_removed, n_spans): the remaining bytes of every text."""
    rows = keyed(docs, key, text)
    met = docs.select(F.col(f"`{key}`").alias(key), *(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))).join(spans(rows), "row", "left")
    cut = F.arrow_udf(_cut, CUT).asNondeterministic()
    return met.select(key, cut("text", "spans").alias("c")).select(key, "c.kept", "c.n_removed", "c.n_spans")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every text. Only texts that lose bytes are cut; of the others the digest is taken where they are read."""
    rows = keyed(docs, key, text)
    cut = F.arrow_udf(_cut, CUT).asNondeterministic()
    changed = rows.join(spans(rows), "row").select("row", cut("text", "spans").alias("c")).select("row", "c.n_removed", "c.n_spans", "c.kept_sha256").dropDuplicates(["row"])
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    whole = docs.select(F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"))
    out = whole.join(changed, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
