"""Benchmark decontamination by q-gram lemma filtering.

A passage of m bytes with at most e edits still shares ``m + 1 - q (e + 1)`` of its q-grams with the
benchmark item, and all of them lie on diagonals (place in the text less place in the item) that differ
by at most e. So q-grams shared by a text and an item are counted per item in bands of 2 (e + 1) diagonals
that overlap by half, and only bands that reach the bound are kept; a banded alignment of the item with the
region then gives the least number of edits or refutes it. The filter loses nothing within the edit budget,
and the alignment confirms every hit.

Which texts and items are counted at all is a join. An item is cut into pieces, each of which gives one seed: its q-gram
that the benchmark holds least often. At least ``pieces - e`` pieces stay whole, so a text that holds the item
has as many of its seeds. Texts are read once, whole, whatever the size of the benchmark: a Bloom filter of at most
``FILTER_BITS`` tells which q-grams may be seeds, and those alone are joined with the table of seeds. Only texts with
enough seeds of an item move, once each, however many rows hold them; the items that one text meets are
worked on in parts of ``BLOCK_BYTES``. A benchmark too large for the filter lets more q-grams through to the join and
changes no result. Case of A-Z and the kind of white space do not count as edits.

An item of over twice ``WINDOW_BYTES`` is also sought by windows of that length that overlap by half, each with a budget
of its own, so that a text that quotes a part of it is found.

Defined results: null and empty items are not sought; an item of fewer than Q bytes is found in texts that are
nothing else; an item of fewer than 2 Q bytes is found without edits only; an item
occurring several times in the table is sought once under its smallest id; a null item id is
reported as null; a null or empty text has no hits; equal distances are reported at the first place; an item
found whole is not reported by its windows, and of several windows the one with the fewest edits is, then the first.
Rows that are repeated have their hits each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small
from .common import batches_of, free, mixed, slices, stored, texts

Q = 12
EDIT_RATE = 0.05
PIECE_BYTES = 16
WINDOW_BYTES = 512
BLOCK_BYTES = 2 << 20
SLICE_BYTES = 1 << 18
FILTER_BITS = 1 << 29
CHUNK_BITS = 1 << 16
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
PASSAGE = T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("passage", T.BinaryType()), T.StructField("need", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.ArrayType(T.LongType())))])
_HIT = pa.struct([("item_id", pa.int64()), ("item", pa.string()), ("part", pa.bool_()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
HITS = "array<struct<item_id:bigint,item:string,part:boolean,edits:int,start:bigint,end:bigint>>"


def folded(text: bytes | None) -> bytes:
    return (text or b"").translate(_FOLD)


def grams(data: bytes) -> np.ndarray:
    """A hash of the Q bytes that begin at every byte."""
    if len(data) < Q:
        return np.zeros(0, dtype=np.uint64)
    byte = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    two = byte[:-1] << np.uint64(8) | byte[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    return mixed(eight[:-4] * np.uint64(0x9E3779B97F4A7C15) + four[8:])


def budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item: the rate, or fewer where the lemma would ask for no shared q-gram at all."""
    return max(0, min(int(rate * length), length // Q - 1))


def aligned(item: bytes, region: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``region`` that starts between ``low`` and ``high``, or None above ``most``.

    Rows are the item's bytes, columns diagonals; the band is the range of starts with ``most`` on each side.
    """
    at = region.find(item, max(0, low))
    if 0 <= at <= high:
        return 0, at, at + len(item)
    first, width = low - most, high - low + 2 * most + 1
    text = np.frombuffer(region, dtype=np.uint8)
    diagonals = np.arange(width)
    place = first + diagonals
    far = np.int32(1 << 20)
    cost = np.where((place >= low) & (place <= high) & (place >= 0) & (place <= len(text)), 0, far).astype(np.int32)
    begun = place.copy()
    for i, byte in enumerate(item):
        column = place + i  # the byte of the text that stands on each diagonal in this row
        inside = (column >= 0) & (column < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[column[inside]] == byte
        step = np.where(inside, cost + ~same, far).astype(np.int32)
        drop = np.append(cost[1:] + 1, far).astype(np.int32)
        source = np.where(step <= drop, begun, np.append(begun[1:], 0))
        best = np.minimum(step, drop)
        # A byte too many in the text moves one diagonal up at a cost of one.
        reach = best - diagonals
        running = np.minimum.accumulate(reach)
        origin = np.maximum.accumulate(np.where(reach == running, diagonals, 0))
        cost, begun = np.minimum(running + diagonals, far).astype(np.int32), source[origin]
        if cost.min() > most:
            return None
    end = place + len(item)
    cost = np.where(end <= len(text), cost, far)
    k = int(cost.argmin())
    return (int(cost[k]), int(begun[k]), int(end[k])) if cost[k] <= most else None


class Items:
    """Some items, each with an id of any kind, and their q-grams."""

    def __init__(self, ids: list, passages: list[bytes], rate: float):
        self.ids, self.passages = ids, passages
        self.budget = np.array([budget(len(p), rate) for p in passages], dtype=np.int64)
        self.bound = np.array([max(1, len(p) + 1 - Q * (e + 1)) for p, e in zip(passages, self.budget, strict=True)], dtype=np.int64)

    def opened(self) -> Items:
        """With the table of q-grams, built where it is used."""
        if not hasattr(self, "_gram"):
            per = [grams(p) for p in self.passages]
            gram = np.concatenate(per) if per else np.zeros(0, dtype=np.uint64)
            item = np.repeat(np.arange(len(per)), [len(g) for g in per])
            place = np.concatenate([np.arange(len(g)) for g in per]) if per else np.zeros(0, dtype=np.int64)
            order = np.argsort(gram, kind="stable")
            self._item, self._place = item[order], place[order]
            self._gram, self._first, self._often = np.unique(gram[order], return_index=True, return_counts=True)
            self._bits = max(16, int(np.ceil(np.log2(max(1, len(self._gram)) * 32))))
            self._there = np.zeros(1 << self._bits, dtype=bool)
            self._there[(self._gram >> np.uint64(64 - self._bits)).astype(np.int64)] = True
        return self

    def regions(self, run: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text, item) -> ranges of starts within the text where the shared q-grams reach the bound."""
        lengths = np.array([len(t) for t in run])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        own = grams(b"".join(run))
        maybe = np.flatnonzero(self._there[(own >> np.uint64(64 - self._bits)).astype(np.int64)])
        at = np.searchsorted(self._gram, own[maybe])
        found = (at < len(self._gram)) & (self._gram[np.minimum(at, len(self._gram) - 1)] == own[maybe])
        place, at = maybe[found], at[found]
        text = np.searchsorted(starts, place, side="right") - 1
        whole = place + Q <= starts[text + 1]  # q-grams over the end of a text are none
        place, at, text = place[whole], at[whole], text[whole]
        often = self._often[at]
        each = np.repeat(np.arange(len(place)), often)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(often) - often, often)
        row = self._first[at][each] + nth
        item, diagonal = self._item[row], place[each] - starts[text[each]] - self._place[row]
        step = self.budget[item] + 1
        cell = diagonal // step
        order = np.lexsort((cell, item, text[each]))
        key = np.stack((text[each][order], item[order], cell[order]), axis=1)
        if not len(key):
            return {}
        fresh = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        key, count = key[fresh], np.diff(np.append(fresh, len(key)))
        # A band is a cell and the one after it; every cell is also the second half of the band before.
        follows = np.zeros(len(key), dtype=bool)
        follows[:-1] = (key[1:, 0] == key[:-1, 0]) & (key[1:, 1] == key[:-1, 1]) & (key[1:, 2] == key[:-1, 2] + 1)
        together = count + np.where(follows, np.append(count[1:], 0), 0)
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k in np.flatnonzero(together >= self.bound[key[:, 1]]):
            doc, i, c = (int(x) for x in key[k])
            width = int(self.budget[i]) + 1
            out.setdefault((doc, i), []).append((c * width, (c + 2) * width - 1))
        return out

    def hits(self, run: list[bytes]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in run]
        for i, passage in enumerate(self.passages):
            if 0 < len(passage) < Q:
                for doc in (d for d, text in enumerate(run) if text == passage):
                    out[doc].append({"item_id": self.ids[i], "edits": 0, "start": 0, "end": len(passage)})
        for (doc, i), ranges in (self.regions(run) if len(self._gram) else {}).items():
            most, best = int(self.budget[i]), None
            for low, high in ranges:
                # Starts may lie off the counted diagonals by as many bytes as the budget inserts before the first shared q-gram.
                low, high = max(0, low - most), high + most
                begin, end = low, min(len(run[doc]), high + len(self.passages[i]) + most + 1)
                got = aligned(self.passages[i], run[doc][begin:end], 0, high - begin, most) if high >= begin else None
                if got and (best is None or (got[0], got[1] + begin) < best[:2]):
                    best = (got[0], got[1] + begin, got[2] + begin)
            if best:
                out[doc].append({"item_id": self.ids[i], "edits": best[0], "start": best[1], "end": best[2]})
        return [sorted(h, key=lambda x: (x["start"], x["end"])) for h in out]


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def whole(data: bytes) -> np.ndarray:
    """The one seed of data with fewer than Q bytes."""
    return mixed(np.array([int.from_bytes(data, "little") % (1 << 64) ^ len(data) << 56], dtype=np.uint64))


def passages_of(item: bytes, window: int = WINDOW_BYTES) -> list[bytes]:
    """The item, then its windows if it is longer than two of them."""
    if len(item) <= 2 * window:
        return [item]
    last = len(item) - window
    return [item] + [item[i:i + window] for i in (*range(0, last, max(1, window // 2)), last)]


def pieces_of(passage: bytes, rate: float = EDIT_RATE) -> tuple[int, list[np.ndarray]]:
    """(seeds that a text must have, the q-grams of every piece): at most one piece is lost to an edit."""
    if len(passage) < Q:
        return 1, [whole(passage)]
    edits = budget(len(passage), rate)
    size = min(PIECE_BYTES, len(passage) // (edits + 1))
    count, own = len(passage) // size, grams(passage)
    return count - edits, [np.unique(own[i * size:i * size + size - Q + 1]) for i in range(count)]


def passages(items: DataFrame, key: str = "item_id", text: str = "text", rate: float = EDIT_RATE, window: int = WINDOW_BYTES) -> DataFrame:
    """(item_id, item, nth, passage, need, pieces): the items and their windows as a table; ``item`` stands for the text."""
    def cut(array: pa.Array) -> pa.Array:
        out = []
        for data in texts(array):
            rows = []
            for nth, passage in enumerate(passages_of(folded(data), window)):
                need, own = pieces_of(passage, rate)
                rows.append({"nth": nth, "passage": passage, "need": need, "pieces": [signed(g).tolist() for g in own]})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("nth", pa.int32()), ("passage", pa.binary()), ("need", pa.int32()), ("pieces", pa.list_(pa.list_(pa.int64())))])))

    kept = items.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("t")).filter("t <> ''").groupBy("t").agg(F.min("item_id").alias("item_id"))
    cuts = F.arrow_udf(cut, T.ArrayType(PASSAGE)).asNondeterministic()("t")
    return kept.select("item_id", F.sha2("t", 256).alias("item"), F.inline(cuts)).withColumn("pid", F.concat_ws("-", "item", "nth"))


def seeds(cuts: DataFrame) -> DataFrame:
    """(seed, pid, need): for every piece of a passage its q-gram that is rarest in the benchmark."""
    each = cuts.select("pid", "need", F.posexplode("pieces").alias("piece", "own")).select("pid", "need", "piece", F.explode("own").alias("seed"))
    often = each.groupBy("seed").agg(F.count("*").alias("often"))
    return each.join(often, "seed").groupBy("pid", "piece").agg(F.min(F.struct("often", "seed"))["seed"].alias("seed"), F.max("need").alias("need")).select("seed", "pid", "need")


def seed_filter(table: DataFrame) -> np.ndarray:
    """A Bloom filter over the seeds with two probes, as bytes. Its chunks are built in tasks; what comes to the driver is at most FILTER_BITS."""
    count = table.count()
    bits = min(FILTER_BITS, max(CHUNK_BITS, 1 << (64 * count).bit_length()))
    top, low = F.shiftrightunsigned("seed", 64 - (bits.bit_length() - 1)), F.col("seed").bitwiseAND(F.lit(bits - 1))

    def packed(chunk: pa.Table) -> pa.Table:
        marks = np.zeros(CHUNK_BITS, dtype=np.uint8)
        marks[chunk["place"].to_numpy()] = 1
        return pa.table({"chunk": chunk["chunk"][:1], "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    places = table.select(F.explode(F.array(top, low)).alias("at")).select(F.floor(F.col("at") / CHUNK_BITS).cast("long").alias("chunk"), (F.col("at") % CHUNK_BITS).alias("place")).distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in places.groupBy("chunk").applyInArrow(packed, "chunk long, marks binary").toLocalIterator():
        out[row.chunk * CHUNK_BITS // 8:(row.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(row.marks, dtype=np.uint8)
    return out


def passing(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be seeds."""
    width = (len(held) * 8).bit_length() - 1
    there = lambda at: held[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    first = np.flatnonzero(there((hashes >> np.uint64(64 - width)).astype(np.int64)))
    return first[there((hashes[first] & np.uint64((1 << width) - 1)).astype(np.int64))]


def seeds_in(run: list[bytes], held: np.ndarray) -> list[np.ndarray]:
    """The distinct q-grams of every text that may be seeds. A text longer than a slice is read in slices that overlap by Q - 1 bytes."""
    if len(run) == 1 and len(run[0]) > SLICE_BYTES:
        found = [(own := grams(run[0][i:i + SLICE_BYTES + Q - 1]))[passing(held, own)] for i in range(0, len(run[0]), SLICE_BYTES)]
        return [np.unique(np.concatenate(found))]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in run])))
    own = grams(b"".join(run))
    place = passing(held, own)
    text = np.searchsorted(starts, place, side="right") - 1
    inside = place + Q <= starts[text + 1]  # q-grams over the end of a text are none
    place, text = place[inside], text[inside]
    cut = np.searchsorted(text, np.arange(len(run) + 1))
    out = [np.unique(own[place[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i, data in enumerate(run):
        if 0 < len(data) < Q:
            own_seed = whole(data)
            out[i] = own_seed[passing(held, own_seed)]
    return out


def found_in(docs: DataFrame, items: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, rate: float = EDIT_RATE, window: int = WINDOW_BYTES, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(tid, item_id, part, edits, start, end): a row for every item found in a text, whose SHA-256 is ``tid``."""
    spark = docs.sparkSession
    cuts = stored(passages(items, item_key, item_text, rate, window))
    table = stored(seeds(cuts))
    held = spark.sparkContext.broadcast(seed_filter(table))

    def looked_up(array: pa.Array) -> pa.Array:
        out = []
        for _, run in slices(map(folded, texts(array)), SLICE_BYTES):
            out += seeds_in(run, held.value)
        ends = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64), pa.int64()))

    def compared(array: pa.Array, meets: pa.Array) -> pa.Array:
        out = []
        for data, met in zip(texts(array), meets.to_pylist(), strict=True):
            group = Items(list(range(len(met))), [m["passage"] for m in met], rate).opened()
            (hits,) = group.hits([folded(data)])
            out.append([{**h, "item_id": (m := met[h["item_id"]])["item_id"], "item": m["item"], "part": m["nth"] > 0} for h in hits])
        return pa.array(out, pa.list_(_HIT))

    own = F.arrow_udf(looked_up, T.ArrayType(T.LongType())).asNondeterministic()("t")
    seen = stored(docs.select(F.col(f"`{text}`").alias("t")).withColumn("own", own).filter(F.size("own") > 0).withColumn("tid", F.sha2("t", 256)))
    # Every piece has one seed and a text's seeds are distinct, so rows count pieces.
    meets = seen.select("tid", "own").distinct().select("tid", F.explode("own").alias("seed")).join(broadcast_if_small(table), "seed").groupBy("tid", "pid").agg(
        F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("tid", "pid")
    meets = stored(meets.join(broadcast_if_small(cuts.select("pid", "item_id", "item", "nth", "passage")), "pid"))
    load = meets.groupBy("tid").agg(F.ceil(F.sum(F.octet_length("passage")) / block_bytes).alias("blocks"))
    work = meets.join(load, "tid").groupBy("tid", F.pmod(F.xxhash64("pid"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("item_id", "item", "nth", "passage")).alias("meets"))
    one = seen.join(broadcast_if_small(meets.select("tid")), "tid", "left_semi").groupBy("tid").agg(F.any_value("t").alias("t"))
    with batches_of(spark, 64):
        hits = stored(work.join(one, "tid").select("tid", F.inline(F.arrow_udf(compared, HITS).asNondeterministic()("t", "meets"))))
    # Windows of one item count once, and not at all where the item was found whole.
    best = hits.groupBy("tid", "item").agg(F.min(F.struct("part", "edits", "start", "end", "item_id")).alias("hit"))
    return stored(best.select("tid", *[F.col("hit")[c].alias(c) for c in ("item_id", "part", "edits", "start", "end")]))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, item_id, edits, start, end, part): a row for every item found in a document, with byte places; ``part`` where only a window of it is there."""
    hits = found_in(docs, items, text, **options)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.sha2(F.col(f"`{text}`"), 256).alias("tid"))
    return rows.join(broadcast_if_small(hits), "tid").select(F.col("k").alias(key), "item_id", "edits", "start", "end", "part")


def leaks_removed(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item or a window of one."""
    (tid,) = free(docs, "tid")
    hits = found_in(docs, items, text, **options).select(F.col("tid").alias(tid)).distinct()
    return docs.withColumn(tid, F.sha2(F.col(f"`{text}`"), 256)).join(broadcast_if_small(hits), tid, "left_anti").drop(tid)
