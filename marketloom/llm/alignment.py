"""Which tokens of two tokenizers cover the same bytes, and how often each pair of ids does in the whole corpus.

A text is cut before every space that follows no white space. Neither tokenizer has a token across such a place (A's pattern
starts anew there, and no piece of B holds a space after another character; ``Pair`` checks B's vocabulary for it), so the tokens
of a text are those of its segments, one after another, and a segment is encoded and aligned once for a whole unit of documents.

1. Texts over ``LONG_BYTES`` are dealt out as byte ranges that end at such places. The alignment of a byte range is a
   ``Fragment``: an open prefix up to its first common token end, closed groups, and an open suffix after its last one. Fragments
   are a monoid (``Fragment.then``), so those of a text are put together in a tree over Spark tasks, ``FAN`` at a time.
2. A task encodes units of about ``UNIT_BYTES``: each distinct segment once, then every text as a run of segments. Every byte
   interval between two neighbouring token ends is one link. A unit holds its distinct id pairs with their counts.
3. Pairs are counted over all units, and each B id's largest count is found, by aggregates. A unit gets the counts of its own
   pairs back by a join, and sums them by segment and then by text. Nothing is broadcast.

Tokenizer files are named by ``folder`` and sent to executors with ``addFile``.

Defined results: texts that are null or empty, or of which a tokenizer does not give back all bytes, have no tokens: zeros, an empty
digest, and no part in the counts. Rows may repeat, and a key may be null or of any type. A text without any space is one
range. The groups of one text must fit into a row of Spark (about 500 MB of text). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches_of, free, parts, stored, texts

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
LONG_BYTES = 1 << 16
UNIT_BYTES = 4 << 20
TEXT_BATCH, UNIT_BATCH = 1000, 4
#: Rows with texts that Parquet's reader takes at a time. Of units it takes ``UNIT_BATCH``: its own 4096 would be all of a file.
READ_ROWS = 64
FAN = 8
_CUT = re.compile(r"(?<=\S) ")
_BLANKS = re.compile(r"\s ")
_SPACE = "▁"
#: Fixed value: how byte-level vocabularies of this kind split texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Fragment:
    """A run of tokens of both sides. Without a common end (``cut``) all of it is ``head``; ids are text with commas, (A, B)."""

    head: tuple[str, str] = ("", "")
    body: tuple[str, ...] = ()
    tail: tuple[str, str] = ("", "")
    cut: bool = False

    def then(self, other: Fragment) -> Fragment:
        if not self.cut:
            return Fragment(_joined(self.head, other.head), other.body, other.tail, other.cut)
        if not other.cut:
            return Fragment(self.head, self.body, _joined(self.tail, other.head), True)
        return Fragment(self.head, (*self.body, "|".join(_joined(self.tail, other.head)), *other.body), other.tail, True)

    def groups(self) -> str:
        """All groups of a whole text, which begins and ends with no token open."""
        return ";".join(("|".join(self.head), *self.body) if self.cut else ())


def _joined(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    return tuple(f"{x},{y}" if x and y else x or y for x, y in zip(a, b, strict=True))


def fragment(groups: str) -> Fragment:
    """The fragment of a byte range at whose end both tokenizers end: its first group may go on to the left."""
    if not groups:
        return Fragment()
    first, *rest = groups.split(";")
    a, b = first.split("|")
    return Fragment((a, b), tuple(rest), cut=True)


def _byte_letters() -> dict[str, int]:
    """The bytes behind the letters of byte-level vocabularies: printable ones stand for themselves, the others for 256 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, and how many bytes each id stands for."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken

        with open(a, encoding="utf-8") as file:
            read = json.load(file)
        special = {t["content"] for t in read.get("added_tokens", ())}
        own = {t: i for t, i in read["model"]["vocab"].items() if t not in special}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in own.items() if all(c in letter for c in t)}
        # Ids follow the order of the merges, so the vocabulary is all that merging needs; special tokens are left out.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("a piece holds a space after another character, so texts cannot be cut at spaces")
        self.blank = self.b.piece_to_id(_SPACE)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        b = self.b.encode(segments, num_threads=1)
        # An empty segment is a text's last space, to which B adds none.
        return [self.a.encode_ordinary(f" {s}") for s in segments], [y if s else [self.blank] for s, y in zip(segments, b, strict=True)]


@lru_cache(maxsize=2)
def pair_of(a: str, b: str) -> Pair:
    return Pair(a, b)


class Aligned:
    """The segments of a unit: tokens, links and groups of each; those that do not give back their bytes are not ``good``."""

    def __init__(self, pair: Pair, segments: list[str]):
        a, b = pair.encoded(segments)
        raw = [f" {s}".encode() for s in segments]
        size_a, size_b = np.array([len(x) for x in pair.a_bytes], dtype=np.int64), np.array([len(x) for x in pair.b_bytes], dtype=np.int64)
        count = lambda x: np.fromiter(map(len, x), dtype=np.int64, count=len(x))
        flat = lambda x: np.fromiter(chain.from_iterable(x), dtype=np.int64)
        self.n_a, self.n_b, sizes = count(a), count(b), count(raw)
        ids_a, ids_b, whole = flat(a), flat(b), b"".join(raw)
        said = lambda ids, n, size, own: b"".join([own[i] for i in ids.tolist()]) == whole and (_sums(size[ids], np.concatenate(([0], np.cumsum(n)))) == sizes).all()
        self.good = np.ones(len(segments), dtype=bool)
        if not (said(ids_a, self.n_a, size_a, pair.a_bytes) and said(ids_b, self.n_b, size_b, pair.b_bytes)):
            self.good = np.array([b"".join([pair.a_bytes[i] for i in x]) == r and b"".join([pair.b_bytes[i] for i in y]) == r for x, y, r in zip(a, b, raw, strict=True)], dtype=bool)
            for k in np.flatnonzero(~self.good):
                a[k], b[k] = [], []
            self.n_a, self.n_b, sizes, ids_a, ids_b = count(a), count(b), np.where(self.good, sizes, 0), flat(a), flat(b)
        del a, b, raw, whole
        # Both sides cover the same bytes, so ends count through from segment to segment.
        end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
        ends = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        twice = ends[1:] == ends[:-1]
        common, ends = ends[1:][twice], ends[np.append(~twice, np.ones(min(1, len(ends)), dtype=bool))]
        pairs = ids_a[np.searchsorted(end_a, ends)] << 32 | ids_b[np.searchsorted(end_b, ends)]
        last = np.cumsum(sizes)
        self.starts = np.concatenate(([0], np.searchsorted(ends, last, side="right")))
        self.n_links = np.diff(self.starts)
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.n_groups = np.diff(np.concatenate(([0], np.searchsorted(common, last, side="right"))))
        # The ids of the group that ends at each common end, as text.
        cut_a, cut_b = (np.searchsorted(e, common, side="right").tolist() for e in (end_a, end_b))
        name_a, name_b = ([pair.names[i] for i in x.tolist()] for x in (ids_a, ids_b))
        group, i, j = [], 0, 0
        for p, q in zip(cut_a, cut_b, strict=True):
            group.append(f"{','.join(name_a[i:p])}|{','.join(name_b[j:q])}")
            i, j = p, q
        at, self.groups = 0, []
        for n in self.n_groups.tolist():
            self.groups.append(";".join(group[at:at + n]))
            at += n


def segments(text: str) -> list[str]:
    """The text cut at every space that follows no white space."""
    return _CUT.split(text) if text[:1] == " " or _BLANKS.search(text) else text.split(" ")


def _ints(x) -> bytes:
    return np.ascontiguousarray(x, dtype=np.int64).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


def _units(key: T.DataType, a: str, b: str):
    schema = _unit_schema(key)

    def unit(pair, number, rows):
        place, runs = {}, []
        for _, row, _, text in rows:
            runs.append([place.setdefault(s, len(place)) for s in segments(text)] if text or text is not None and row is not None else [])
        aligned = Aligned(pair, list(place))
        long = [r[1] is not None for r in rows]
        good = [bool(run) and bool(aligned.good[run].all()) for run in runs]
        sizes = np.array([len(r) if g else 0 for r, g in zip(runs, good, strict=True)], dtype=np.int64)
        used = np.fromiter((i for r, g in zip(runs, good, strict=True) if g for i in r), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        sums = [_sums(x[used], starts) for x in (aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links)]
        texts_of = [";".join([aligned.groups[i] for i in r]) if g else "" for r, g in zip(runs, good, strict=True)]
        digest = [hashlib.sha256(t.encode()).hexdigest() if g and not l else "" for t, g, l in zip(texts_of, good, long, strict=True)]
        kept = [t if l and g else None for t, g, l in zip(texts_of, good, long, strict=True)]
        times = np.bincount(used, minlength=len(place)).astype(np.int64)
        per_pair = np.zeros(len(aligned.pairs), dtype=np.int64)
        np.add.at(per_pair, aligned.pair, np.repeat(times, aligned.n_links))
        flat = lambda x: pa.array([x])
        return pa.RecordBatch.from_arrays([
            flat(number), flat(_ints(aligned.pairs)), flat(_ints(per_pair)), flat(_ints(aligned.starts)), pa.array([aligned.pair.astype(np.int32).tobytes()]), flat(_ints(starts)), pa.array([used.astype(np.int32).tobytes()]),
            pa.array([[r[0] for r in rows]], schema.field("keys").type), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), *(flat(_ints(s)) for s in sums),
            pa.array([[int(g or not r[3]) for r, g in zip(rows, good, strict=True)]], pa.list_(pa.int64())), pa.array([digest], pa.list_(pa.string())), pa.array([kept], pa.list_(pa.string()))], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        pair, number = pair_of(SparkFiles.get(a), SparkFiles.get(b)), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[3] or "") + 64
                if size >= UNIT_BYTES:
                    yield unit(pair, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield unit(pair, number, held)

    return run


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def _unit_type(key: T.DataType) -> T.StructType:
    binary = [T.StructField(c, T.BinaryType()) for c in ("pairs", "times", "seg_start", "seg_pair", "run_start", "run_seg")]
    return T.StructType([T.StructField("unit", T.LongType()), *binary, T.StructField("keys", T.ArrayType(key)), T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("chunks", T.ArrayType(T.LongType())),
                         *(T.StructField(c, T.BinaryType()) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("good", T.ArrayType(T.LongType())), T.StructField("digest", T.ArrayType(T.StringType())), T.StructField("groups", T.ArrayType(T.StringType()))])


def _unit_schema(key: T.DataType) -> pa.Schema:
    return pa.schema([pa.field(f.name, pa.list_(to_arrow_type(f.dataType.elementType)) if isinstance(f.dataType, T.ArrayType) else to_arrow_type(f.dataType)) for f in _unit_type(key)])


def ranges(text: str, size: int) -> list[str]:
    """Byte ranges of about ``size`` characters that end where both tokenizers end; the space before each later one is left to it."""
    out, at, cut = [], 0, None
    while at < len(text):
        cut = _CUT.search(text, at + size) if at + size < len(text) else None
        out.append(text[at:cut.start() if cut else len(text)])
        at = cut.end() if cut else len(text)
    # A text that ends with the cut space has an empty last range.
    if cut is not None:
        out.append("")
    return out


def _ranged(size: int):
    def run(batches):
        for batch in batches:
            row, key = batch.column(0), batch.column(1)
            for i, text in enumerate(texts(batch.column(2))):
                pieces = ranges(text.decode(), size)
                take = pa.array([i] * len(pieces))
                yield pa.RecordBatch.from_arrays([key.take(take), row.take(take), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.string())], names=["key", "row", "chunk", "text"])

    return run


def _pairs_of(batches):
    for batch in batches:
        for unit, pairs, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p, n = _numbers(pairs), _numbers(times)
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), unit)), pa.array(p[own]), pa.array(n[own])], names=["unit", "pair", "n"])


def _rated(key: T.DataType):
    schema = pa.schema([("key", to_arrow_type(key)), ("row", pa.int64()), ("chunk", pa.int64()), *((c, pa.int64()) for c in NUMBERS), ("groups_sha256", pa.string()), ("groups", pa.string())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                col = lambda c: batch.column(batch.schema.get_field_index(c))[k]  # noqa: E731, B023
                pairs, counts, tops = _numbers(col("pairs").as_py()), None, None
                counts, tops = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
                known = col("known").values
                if known is not None and len(known):
                    at = np.searchsorted(pairs, known.field("pair").to_numpy(zero_copy_only=False))
                    counts[at] = known.field("count").to_numpy(zero_copy_only=False)
                    tops[at] = known.field("top").to_numpy(zero_copy_only=False)
                seg, seg_start = np.frombuffer(col("seg_pair").as_py(), dtype=np.int32), _numbers(col("seg_start").as_py())
                used, start = np.frombuffer(col("run_seg").as_py(), dtype=np.int32), _numbers(col("run_start").as_py())
                best, total = (_sums(_sums(x[seg], seg_start)[used], start) for x in (tops, counts))
                own = [pa.array(_numbers(col(c).as_py())) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([col("keys").values.cast(schema.field("key").type), col("rows").values, col("chunks").values, *own, pa.array(best), pa.array(total), col("digest").values, col("groups").values], schema=schema)

    return run


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _composed(batches):
    """(row, node): fragments of one text in order, put together."""
    for table in batches:
        rows = table if isinstance(table, pa.Table) else pa.Table.from_batches([table])
        rows = rows.sort_by("chunk")
        whole = Fragment()
        for r in rows.to_pylist():
            whole = whole.then(Fragment((r["head_a"], r["head_b"]), (r["body"],) if r["body"] else (), (r["tail_a"], r["tail_b"]), r["cut"]))
        yield rows["row"][0].as_py(), rows["node"][0].as_py(), whole


FRAGMENTS = "row long, chunk long, head_a string, head_b string, body string, tail_a string, tail_b string, cut boolean"


def _compose(table: pa.Table) -> pa.Table:
    ((row, node, f),) = _composed([table])
    return pa.table({"row": [row], "chunk": [node], "head_a": [f.head[0]], "head_b": [f.head[1]], "body": [";".join(f.body)], "tail_a": [f.tail[0]], "tail_b": [f.tail[1]], "cut": [f.cut]})


def composed(fragments: DataFrame, most: int) -> DataFrame:
    """The fragment of every text, from those of its ranges, in a tree of ``FAN`` branches; ``most`` is the largest number of ranges."""
    for _ in range(max(0, math.ceil(math.log(most, FAN) - 1e-9)) if most > 1 else 0):
        fragments = stored(fragments.withColumn("node", F.floor(F.col("chunk") / FAN)).groupBy("row", "node").applyInArrow(_compose, FRAGMENTS), wide=True)
    return fragments


def _group_text(head_a: Column, head_b: Column, body: Column) -> Column:
    first = F.concat(head_a, F.lit("|"), head_b)
    return F.when(F.length(body) > 0, F.concat(first, F.lit(";"), body)).otherwise(first)


def _fragments(kept: DataFrame) -> DataFrame:
    """Stored ranges (row, chunk, groups) as fragments: the first group of a range may go on to the left."""
    first = F.substring_index("groups", ";", 1)
    body = F.expr("substring(groups, length(substring_index(groups, ';', 1)) + 2)")
    cut = F.length(F.coalesce("groups", F.lit(""))) > 0
    empty = F.lit("")
    return kept.select("row", "chunk", F.when(cut, F.substring_index(first, "|", 1)).otherwise(empty).alias("head_a"), F.when(cut, F.substring_index(first, "|", -1)).otherwise(empty).alias("head_b"), F.when(cut, body).otherwise(empty).alias("body"), empty.alias("tail_a"), empty.alias("tail_b"), cut.alias("cut"))


def shipped(spark: SparkSession, folder: str, files: tuple[str, str]) -> None:
    for name in files:
        spark.sparkContext.addFile(os.path.realpath(f"{folder}/{name}"))


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, files: tuple[str, str] = FILES, longest: int = LONG_BYTES) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for every row of ``docs``; texts over ``longest`` bytes go in ranges."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    shipped(spark, folder, files)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > longest, F.lit(False))
    own = T.StructType([T.StructField("key", kind), T.StructField("row", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType())])
    nothing = F.lit(None).cast("long")
    with batches_of(spark, TEXT_BATCH, READ_ROWS):
        # Written once, so that the rows keep their numbers.
        long = stored(rows.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInArrow(_ranged(longest), own), wide=True)
        size = long.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max("chunk").alias("chunk")).first()
        short = rows.filter(~is_long).select("key", nothing.alias("row"), nothing.alias("chunk"), "text")
        spread = long.repartition(parts(size.bytes or 0, UNIT_BYTES), "row", "chunk")
        units = stored(short.unionByName(spread).mapInArrow(_units(kind, *files), _unit_type(kind)), wide=True)
        lost = units.select(F.explode(F.arrays_zip("rows", "good")).alias("x")).filter("x.rows is not null and x.good = 0").select(F.col("x.rows").alias("row")).distinct()
        lost = stored(lost)
        if not lost.isEmpty():
            # A range that does not give back its bytes empties its whole text, and the counts are made without it.
            spread = spread.join(lost.withColumn("lost", F.lit(True)), "row", "left").withColumn("text", F.when(F.col("lost").isNull(), F.col("text"))).select("key", "row", "chunk", "text")
            units = stored(short.unionByName(spread).mapInArrow(_units(kind, *files), _unit_type(kind)), wide=True)
    with batches_of(spark, UNIT_BATCH, UNIT_BATCH):
        met = stored(units.select("unit", "pairs", "times").mapInArrow(_pairs_of, "unit long, pair long, n long"))
    counts = stored(met.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("top"))
    known = met.join(rated, "pair").groupBy("unit").agg(F.collect_list(F.struct("pair", "count", "top")).alias("known"))
    with batches_of(spark, UNIT_BATCH, UNIT_BATCH):
        full = T.StructType([T.StructField("key", kind), T.StructField("row", T.LongType()), T.StructField("chunk", T.LongType()), *(T.StructField(c, T.LongType()) for c in NUMBERS), T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType())])
        found = stored(units.join(known, "unit", "left").mapInArrow(_rated(kind), full), wide=True)
    (name,) = free(docs.select(), key)
    done = found.filter("row is null").select(F.col("key").alias(name), *NUMBERS, "groups_sha256")
    if size.chunk is None:
        return done
    ranged = found.filter("row is not null")
    sums = ranged.groupBy("row").agg(F.first("key").alias("key"), *(F.sum(c).alias(c) for c in NUMBERS))
    with batches_of(spark, UNIT_BATCH, UNIT_BATCH):
        whole = composed(_fragments(ranged.select("row", "chunk", "groups")), size.chunk + 1)
        digest = stored(whole.select("row", F.when(F.col("cut"), F.sha2(_group_text(F.col("head_a"), F.col("head_b"), F.col("body")), 256)).otherwise(F.lit("")).alias("groups_sha256")))
    return done.unionByName(sums.join(digest, "row").select(F.col("key").alias(name), *NUMBERS, "groups_sha256"))
