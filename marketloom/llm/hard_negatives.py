"""Hard negatives from blocks ordered along a Hilbert curve, of which zone maps say which an anchor has to read.

1. Components become ``floor(scale * x)``. Rows are ordered by (label, place on a Hilbert curve through the ``CURVE_DIMS``
   components of largest variance, id) by sampled ranges, and packed into Parquet blocks of at most ``BLOCK_ROWS`` rows of
   one label, each with the least and largest value of every component (its zone map). A block's own anchors are
   compared with it at once: its neighbours on the curve give each anchor a first score that its positives must reach.
2. Interval arithmetic bounds the inner product of an anchor with all rows of a block from both sides. Tiles of anchors
   meet tiles of zone maps (a stated query set against all rows, in blocks); only the zone columns are read for that.
   A block is chosen for an anchor's positives if its label is the same and its upper bound reaches the first score.
3. Chosen blocks are joined with the anchors that chose them and scored by matrix products; the best rows of a task go on.
4. With the positives known, each gives a window of scores. A block of another label is chosen for an anchor if its interval
   meets one of the windows, and is read and scored in the same way.

Bounds are only used to leave out blocks that cannot matter, so the result is exact. No block or tile grows with a label,
and rows that agree in everything are spread by id.

Defined results: rows with a null id, label, vector or component, or a component that is not finite, take no part, nor do
empty vectors; vectors of different length never meet; rows that agree in id, label and vector count once, and an anchor
never meets rows of its own id; rows that share an id but not a vector are anchors of their own; scores from 2**53 on are
computed exactly, but the ends of a window are rounded to float64 and scores stop at 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, parts, stored

BLOCK_ROWS = 512
PART_ROWS = 4096
TILE = 256
TILE_SLOTS = 16
#: Rows of vectors, and rows that hold a block or a tile each (some 100 kB), in an Arrow batch.
VECTOR_BATCH, TILE_BATCH = 1000, 64
CURVE_DIMS, CURVE_BITS = 8, 4
#: A float64 product of whole numbers is exact below this.
EXACT = float(1 << 53)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of every row of ``cells`` (whole numbers below ``2 ** bits``), by Skilling's transform."""
    x = [c.astype(np.uint64) for c in np.ascontiguousarray(cells.T)]
    zero = np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(len(x)):
            on = (x[i] & q) != zero
            swap = np.where(on, zero, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0]) ^ swap
            x[i] = x[0] if i == 0 else x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & np.uint64(1 << bit)) != zero, turn ^ np.uint64((1 << bit) - 1), turn)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            out = out << np.uint64(1) | ((c ^ turn) >> np.uint64(bit) & np.uint64(1))
    return out.astype(np.int64)


def packed(vectors: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if all fit, else as float64."""
    return vectors.astype(np.int16 if not vectors.size or np.abs(vectors).max() < 32768 else np.float64).tobytes()


def unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * rows * dims else np.float64
    return np.frombuffer(data, dtype=kind).reshape(rows, dims).astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: int64, or Python numbers where float64 would round."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object)
    return whole(a).dot(whole(b).T)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what the inner products of each row of ``a`` with the rows of each zone lie, with a margin for rounding."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
        return np.nan_to_num(least - slack, nan=-np.inf), np.nan_to_num(most + slack, nan=np.inf)


def _best(order: tuple[np.ndarray, ...], group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows of every group, in the order of the keys ``order`` (last one first, as in lexsort)."""
    by = np.lexsort((*order, group))
    new = np.concatenate((np.ones(min(1, len(by)), dtype=bool), group[by][1:] != group[by][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < most]


def _clipped(values) -> np.ndarray:
    top = (1 << 63) - 1
    return values if getattr(values, "dtype", None) == np.int64 else np.array([max(-top - 1, min(top, int(v))) for v in values], dtype=np.int64)


def _matrices(batch: pa.RecordBatch, scale: int):
    """(rows, vectors) of a batch, by length of the vectors."""
    vectors = batch.column(batch.schema.get_field_index("v"))
    length = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(length)))[:-1]
    for dims in np.unique(length):
        rows = np.flatnonzero(length == dims)
        yield rows, np.floor(flat[starts[rows, None] + np.arange(dims)] * float(scale))


def _moments(scale: int):
    def run(batches):
        for batch in batches:
            for rows, m in _matrices(batch, scale):
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1])), pa.array(np.full(m.shape[1], float(len(rows)))), pa.array(m.sum(axis=0)), pa.array((m * m).sum(axis=0))], names=["place", "n", "s", "q"])

    return run


def _on_curve(scale: int, axes: list[tuple[int, float, float]]):
    """(id, label, anchor, dims, h, v): ``axes`` are (component, start, width of a cell)."""
    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            for rows, m in _matrices(batch, scale):
                own = [(i, a, w) for i, a, w in axes if i < m.shape[1]]
                cells = np.stack([np.clip(np.floor((m[:, i] - a) / w), 0, (1 << CURVE_BITS) - 1) for i, a, w in own], axis=1) if own else np.zeros((len(rows), 1))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([column("id").take(take), column("label").take(take), column("anchor").take(take), pa.array(np.full(len(rows), m.shape[1], dtype=np.int32)), pa.array(hilbert(cells, CURVE_BITS)), pa.array([packed(x) for x in m], pa.binary())], names=["id", "label", "anchor", "dims", "h", "v"])

    return run


BLOCKS = "block long, label string, dims int, n int, low binary, high binary, ids binary, vectors binary, anchors array<int>, first array<double>"


def _blocks(positives: int):
    """Runs of rows of one label as blocks; ``anchors`` are places in the block, ``first`` what their positives must reach."""
    def block(number, label, dims, held):
        ids, v = np.array([h[0] for h in held], dtype=np.int64), np.stack([h[2] for h in held])
        places = [i for i, h in enumerate(held) if h[1]]
        found = scores(v[places], v)
        first = []
        for k, i in enumerate(places):
            other = sorted((s for j, s in enumerate(found[k]) if ids[j] != ids[i]), reverse=True)
            first.append(np.nextafter(float(other[positives - 1]), -np.inf) if len(other) >= positives else -np.inf)
        return (number, label, dims, len(held), packed(v.min(axis=0)), packed(v.max(axis=0)), ids.tobytes(), packed(v), places, first)

    def run(batches):
        from pyspark import TaskContext

        number, held, kind, last = TaskContext.get().partitionId() << 32, [], None, None
        out = []
        for batch in batches:
            for id_, label, anchor, dims, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "label", "anchor", "dims", "v")), strict=True):
                if (kind == (label, dims) and last == (id_, data)):
                    continue
                if held and (kind != (label, dims) or len(held) == BLOCK_ROWS):
                    out.append(block(number, *kind, held))
                    number, held = number + 1, []
                kind, last = (label, dims), (id_, data)
                held.append((id_, bool(anchor), unpacked(data, 1, dims)[0]))
            if len(out) >= 16:
                yield _batch(out, BLOCK_SCHEMA)
                out = []
        if held:
            out.append(block(number, *kind, held))
        if out:
            yield _batch(out, BLOCK_SCHEMA)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("anchors", pa.list_(pa.int32())), ("first", pa.list_(pa.float64()))])


def blocks(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchor: Column | None = None, scale: int = 256, positives: int = 5) -> DataFrame:
    """The stored block table of ``rows``; ``anchor`` says which of them ask."""
    labelled = F.col(f"`{label}`") if isinstance(label, str) else label
    asks = F.coalesce(anchor if anchor is not None else F.lit(True), F.lit(False))
    chosen = rows.select(F.col(f"`{key}`").cast("long").alias("id"), labelled.cast("string").alias("label"), asks.alias("anchor"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    chosen = chosen.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    moments = chosen.select("v").mapInArrow(_moments(scale), "place long, n double, s double, q double").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    spread = F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))
    # As many rows as a vector has components, of which the largest few are taken.
    top = moments.select("place", "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(spread).alias("dev")).orderBy(F.desc("dev"), "place").limit(CURVE_DIMS).collect()
    axes = [(r.place, r.mean - 2 * r.dev, 4 * r.dev / (1 << CURVE_BITS) or 1.0) for r in top if np.isfinite(r.dev) and np.isfinite(r.mean)]
    curve = stored(chosen.mapInArrow(_on_curve(scale, axes), "id long, label string, anchor boolean, dims int, h long, v binary"))
    ranged = curve.repartitionByRange(parts(curve.count(), PART_ROWS), "label", "dims", "h", "id").sortWithinPartitions("label", "dims", "h", "id", "v", F.desc("anchor"))
    return stored(ranged.mapInArrow(_blocks(positives), BLOCKS))


ANCHORS = pa.schema([("tile", pa.int64()), ("dims", pa.int32()), ("labels", pa.list_(pa.string())), ("keys", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("first", pa.binary())])
ZONES = pa.schema([("zone", pa.int64()), ("zdims", pa.int32()), ("zlabels", pa.list_(pa.string())), ("zblocks", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _ints(column) -> bytes:
    return np.array(column, dtype=np.int64).tobytes()


def _floats(column) -> bytes:
    return np.array(column, dtype=np.float64).tobytes()


def _vectors(column) -> bytes:
    return packed(np.stack(column))


def _tiled(schema: pa.Schema, take, *kinds):
    """Rows of one length of vectors in tiles of at most ``TILE``; ``kinds`` put the columns together."""
    def run(batches):
        from pyspark import TaskContext

        number, held, dims = TaskContext.get().partitionId() << 32, [], None
        tile = lambda: _batch([(number, dims, *(kind(c) for kind, c in zip(kinds, zip(*held, strict=True), strict=True)))], schema)
        for batch in batches:
            for row in (x for r in batch.to_pylist() for x in take(r)):
                if held and (dims != row[0] or len(held) == TILE):
                    yield tile()
                    number, held = number + 1, []
                dims = row[0]
                held.append(row[1:])
        if held:
            yield tile()

    return run


def _anchors_of(r):
    if r["anchors"]:
        v, ids = unpacked(r["vectors"], r["n"], r["dims"]), np.frombuffer(r["ids"], dtype=np.int64)
        for i, first in zip(r["anchors"], r["first"], strict=True):
            yield r["dims"], r["label"], (r["block"] >> 32) << 44 | (r["block"] & 0xFFFFFFFF) * BLOCK_ROWS + i, int(ids[i]), v[i], float(first)


def _zone_of(r):
    yield r["dims"], r["label"], r["block"], unpacked(r["low"], 1, r["dims"])[0], unpacked(r["high"], 1, r["dims"])[0]


ANCHORS_SQL = "tile long, dims int, labels array<string>, keys binary, ids binary, vectors binary, first binary"
ZONES_SQL = "zone long, zdims int, zlabels array<string>, zblocks binary, low binary, high binary"
#: The anchors of one tile that have to read a block: their keys, ids and vectors, and what scores must reach or lie between.
CHOSEN = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("wanted", pa.binary()), ("asking", pa.binary())])
CHOSEN_SQL = "block long, keys binary, ids binary, wanted binary, asking binary"


def _met(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """Every tile of anchors beside every tile of zones, dealt by slots of zones."""
    slots = parts(zones.count(), TILE_SLOTS)
    asked = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return asked.join(zones.withColumn("slot", F.pmod(F.xxhash64("zone"), F.lit(slots)).cast("int")), "slot")


def _chosen(windows: bool, low: int, high: int):
    """For every zone the anchors of the tile that have to read it. ``wanted`` holds, an anchor, what scores must lie between."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["dims"] != r["zdims"]:
                    continue
                dims, n, m = r["dims"], len(r["labels"]), len(r["zlabels"])
                a = unpacked(r["vectors"], n, dims)
                least, most = bounds(a, unpacked(r["low"], m, dims), unpacked(r["high"], m, dims))
                same = np.array(r["labels"], dtype=object)[:, None] == np.array(r["zlabels"], dtype=object)[None, :]
                keys, ids, numbers = (np.frombuffer(r[c], dtype=np.int64) for c in ("keys", "ids", "zblocks"))
                wanted = np.frombuffer(r["first"], dtype=np.float64).reshape(n, -1)
                if windows:
                    top = np.nan_to_num(wanted, nan=-1.0)[:, :, None]
                    reads = ~same & ((top >= 0) & (least[:, None, :] * 100 <= high * top) & (most[:, None, :] * 100 >= low * top)).any(axis=1)
                else:
                    reads = same & (most >= wanted)
                out = [(int(numbers[z]), keys[own].tobytes(), ids[own].tobytes(), wanted[own].tobytes(), packed(a[own])) for z in range(m) if len(own := np.flatnonzero(reads[:, z]))]
                if out:
                    yield _batch(out, CHOSEN)

    return run


FOUND = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("win", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "key long, anchor_id long, win int, other long, score long"


def _scored(windows: bool, low: int, high: int, most: int):
    """The best rows of the blocks read, an anchor and window; those of one batch are put together first."""
    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                dims, own = r["dims"], np.frombuffer(r["ids"], dtype=np.int64)
                keys, asking_ids = np.frombuffer(r["keys"], dtype=np.int64), np.frombuffer(r["asking_ids"], dtype=np.int64)
                wanted = np.frombuffer(r["wanted"], dtype=np.float64).reshape(len(keys), -1)
                s = scores(unpacked(r["asking"], len(keys), dims), unpacked(r["vectors"], r["n"], dims))
                other = asking_ids[:, None] != own[None, :]
                for k in range(wanted.shape[1]):
                    if windows:
                        top = np.array([0 if np.isnan(x) else int(x) for x in wanted[:, k]], dtype=s.dtype)[:, None]
                        fits = other & (100 * s <= high * top) & (100 * s >= low * top) & (wanted[:, k] >= 0)[:, None]
                    else:
                        fits = other & (s >= wanted[:, k][:, None])
                    i, j = np.nonzero(fits)
                    if len(i):
                        at = _best((own[j], -_clipped(s[i, j])), i, most)
                        found.append((keys[i[at]], asking_ids[i[at]], np.full(len(at), k), own[j[at]], _clipped(s[i[at], j[at]])))
            if found:
                key, anchor, win, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
                _, group = np.unique(np.stack((key, win), axis=1), axis=0, return_inverse=True)
                at = _best((row, -score), group.ravel(), most)
                yield pa.RecordBatch.from_arrays([pa.array(c[at], f.type) for c, f in zip((key, anchor, win.astype(np.int32), row, score), FOUND, strict=True)], schema=FOUND)

    return run


def _read(table: DataFrame, chosen: DataFrame, windows: bool, low: int, high: int, most: int) -> DataFrame:
    """The first ``most`` rows of every anchor and window, with their ``rank``."""
    asked = chosen.select("block", "keys", F.col("ids").alias("asking_ids"), "wanted", "asking")
    met = table.select("block", "dims", "n", "ids", "vectors").join(asked, "block")
    found = met.mapInArrow(_scored(windows, low, high, most), FOUND_SQL)
    first = Window.partitionBy("key", "win").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchor: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first ``negatives`` rows of another label whose
    scores lie between ``low`` and ``high`` per cent of a positive's score, for the first ``positives`` rows of the anchor's own label."""
    spark = rows.sparkSession
    with batches_of(spark, VECTOR_BATCH):
        table = blocks(rows, key, vector, label, anchor, scale, positives)
    with batches_of(spark, TILE_BATCH):
        # Only blocks with anchors are read for the anchors, and only the zone columns for the zones.
        asking = table.filter(F.size("anchors") > 0).select("block", "label", "dims", "n", "ids", "vectors", "anchors", "first")
        anchors = stored(asking.mapInArrow(_tiled(ANCHORS, _anchors_of, list, _ints, _ints, _vectors, _floats), ANCHORS_SQL))
        zones = stored(table.select("block", "label", "dims", "low", "high").mapInArrow(_tiled(ZONES, _zone_of, list, _ints, _vectors, _vectors), ZONES_SQL))
        chosen = stored(_met(anchors, zones).mapInArrow(_chosen(False, low, high), CHOSEN_SQL))
        near = stored(_read(table, chosen, False, low, high, positives).select("key", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
        # The windows of an anchor stand in its tile in place of the first scores: one for each positive.
        tops = near.groupBy("key").agg(F.collect_list(F.struct("place", "positive_score")).alias("tops"))
        listed = stored(anchors.mapInArrow(_untiled, "dims int, label string, key long, id long, vector binary").join(tops, "key"))
    with batches_of(spark, VECTOR_BATCH):
        again = stored(listed.mapInArrow(_tiled(ANCHORS, _windows_of(positives), list, _ints, _ints, _vectors, _floats), ANCHORS_SQL))
    with batches_of(spark, TILE_BATCH):
        chosen = stored(_met(again, zones).mapInArrow(_chosen(True, low, high), CHOSEN_SQL))
        far = stored(_read(table, chosen, True, low, high, negatives).select("key", "anchor_id", (F.col("win") + 1).alias("place"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"), "rank"))
    return far.join(near, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _untiled(batches):
    schema = pa.schema([("dims", pa.int32()), ("label", pa.string()), ("key", pa.int64()), ("id", pa.int64()), ("vector", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["labels"])
            v = unpacked(r["vectors"], n, r["dims"])
            yield _batch(list(zip([r["dims"]] * n, r["labels"], np.frombuffer(r["keys"], dtype=np.int64).tolist(), np.frombuffer(r["ids"], dtype=np.int64).tolist(), [packed(x) for x in v], strict=True)), schema)


def _windows_of(positives: int):
    def take(r):
        tops = np.full(positives, np.nan)
        for t in r["tops"]:
            tops[t["place"] - 1] = t["positive_score"]
        yield r["dims"], r["label"], r["key"], r["id"], unpacked(r["vector"], 1, r["dims"])[0], tops

    return take
