"""Near-duplicate groups by MinHash with tensored banding.

A text's set is its distinct shingles of ``width`` words, and texts whose sets share ``percent`` of their union are linked. Two collections of ``HALVES`` half keys, each made of
``WIDTH`` minhashes, are drawn; a table key is a pair of one half of either collection. So
``2 * HALVES * WIDTH`` minhashes give ``HALVES ** 2`` tables, where plain banding needs
``2 * WIDTH * HALVES ** 2``. A pair of similarity s is missed with a chance of at most
``2 * (1 - s ** WIDTH) ** HALVES``: 1.6e-3 at 0.8, 2.5e-4 at 0.85, 2e-5 at 0.9. Every candidate is confirmed on the full sets.

Texts with equal sets are one class and enter the tables once. In a bucket every class is compared with a lead,
the class that meets most others over all its buckets. Where all members are linked to the lead, the bucket is
settled. Where some are not, a pair x, y of the lead's members is decided by how both differ from the lead: with
D what a set lacks of the lead and A what it has beyond it, |x and y| = |lead| - |Dx| - |Dy| + |Dx and Dy| + |Ax and Ay|.
These differences are short, so the pairs with an unlinked member are counted in tasks, as products of 0-1 matrices
of at most ``BLOCK`` members a side, and only links that join something leave a task. A lead with more members is
dealt over the pairs of its blocks. So every pair that meets in a bucket is decided exactly, no pair becomes a row,
and no task holds more than two blocks.

Buckets are equality joins on hashed keys with partial aggregates below them, so a hot bucket is split.
Defined results: a null text or one without words has an empty set, links with nothing and is its own
component; fewer words than ``width`` are one shingle; equal rows share a component; a null id never names a
component while its group has another id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import free, mixed, stored, texts

#: The rule of operator 3's query; the pipeline's stage sets its own.
SHINGLE_WORDS = 3
SIMILAR_PERCENT = 85
BLOCK = 512
HALVES = 7
WIDTH = 2
_SEEDS = mixed(np.arange(1, 2 * HALVES * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
SIGNATURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("u", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.LongType()))])


def shingles(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    run = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        run = mixed(run + own[k:len(words) - width + 1 + k])
    return np.unique(run)


def signature(found: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(size, a hash of the whole set, first half keys, second half keys)."""
    if not len(found):
        return 0, 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at:at + 4096, None] * _SEEDS).min(axis=0), out=least)
    halves = least.reshape(2 * HALVES, WIDTH)
    key = np.arange(2 * HALVES, dtype=np.uint64)
    for k in range(WIDTH):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + halves[:, k])
    whole = mixed(np.array([mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(len(found))]))
    return len(found), int(whole.view(np.int64)[0]), key[:HALVES].view(np.int64), key[HALVES:].view(np.int64)


def _signatures(width: int):
    def run(array: pa.Array) -> pa.Array:
        rows = [signature(shingles(t, width)) for t in texts(array)]
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], longs), pa.array([r[3] for r in rows], longs)], names=SIGNATURE.names)

    return F.arrow_udf(run, SIGNATURE).asNondeterministic()


def _sets(width: int):
    def run(array: pa.Array) -> pa.Array:
        rows = [shingles(t, width) for t in texts(array)]
        return pa.StructArray.from_arrays([pa.array([signature(r)[1] for r in rows], pa.int64()), pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["sid", "shingles"])

    return F.arrow_udf(run, "sid long, shingles array<long>").asNondeterministic()


def row_key(key: str, text: str) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, row, n, sid, u, v) of every row, written once."""
    own = _signatures(width)(F.col(f"`{text}`"))
    return stored(docs.select(F.col(f"`{key}`").alias("id"), row_key(key, text).alias("row"), own.alias("s")).select("id", "row", "s.*"))


def _in_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, sid, n) of the buckets with two classes or more."""
    keys = F.flatten(F.transform("u", lambda a, i: F.transform("v", lambda b, j: F.xxhash64(i, j, a, b))))
    rows = classes.select(F.explode(keys).alias("bucket"), "sid", "n")
    shared = rows.groupBy("bucket").count().filter("count > 1").select("bucket")
    return stored(rows.join(shared, "bucket"))


def _against_leads(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(lead, members, sid, n, lead_n, lacks, linked, differs): each member against its lead on the full sets.

    ``differs`` holds the shingles the lead lacks and, with all bits turned, those the member lacks.
    """
    members = groups.groupBy("lead").agg(F.count("*").alias("members"))
    one = groups.join(members, "lead").join(sets.select("sid", "shingles"), "sid")
    both = one.join(sets.select(F.col("sid").alias("lead"), F.col("shingles").alias("own")), "lead")
    found = both.select("lead", "members", "sid", F.size("shingles").alias("n"), F.size("own").alias("lead_n"), F.array_except("shingles", "own").alias("more"), F.array_except("own", "shingles").alias("less"))
    common = F.col("n") - F.size("more")
    linked = 100 * common >= percent * (F.col("n") + F.col("lead_n") - common)
    return found.select("lead", "members", "sid", "n", "lead_n", F.size("less").alias("lacks"), linked.alias("linked"), F.concat("more", F.transform("less", F.bitwise_not)).alias("differs"))


def decided(sid: np.ndarray, n: np.ndarray, lead_n: int, lacks: np.ndarray, linked: np.ndarray, side: np.ndarray, differs: list[np.ndarray], cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links between members of one lead, at least one of which is not linked to it, as a forest.

    ``cross``: only pairs of one member of either side.
    """
    far, size = np.flatnonzero(~linked), len(sid)
    if not len(far) or size < 2:
        return []
    column = np.concatenate(differs)
    row = np.repeat(np.arange(size), [len(d) for d in differs])
    _, column, often = np.unique(column, return_inverse=True, return_counts=True)
    name = np.cumsum(often > 1) - 1  # elements of one member only are in no common part
    keep = often[column] > 1
    row, column = row[keep], name[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(far), size), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        low, high = np.searchsorted(column, (begin, begin + 4096))
        part = np.zeros((size, 4096), dtype=np.float32)
        part[row[low:high], column[low:high] - begin] = 1
        common += part[far] @ part.T
    both = lead_n - lacks[far][:, None] - lacks[None, :] + common.astype(np.int64)
    alike = 100 * both >= percent * (n[far][:, None] + n[None, :] - both)
    alike[np.arange(len(far)), far] = False
    if cross:
        alike &= side[far][:, None] != side[None, :]
    # What is linked to the lead is joined through it; of the rest, links that join two parts.
    up = np.arange(size)
    near = np.flatnonzero(linked)
    if len(near):
        up[near] = near[0]

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(alike), strict=True):
        a, b = root(far[i]), root(j)
        if a != b:
            up[a] = b
            out.append((int(sid[far[i]]), int(sid[j])))
    return out


def _decided(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        pick = lambda c: rows[c].to_numpy()
        flat = rows["differs"].combine_chunks()
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy()
        differs = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        links = decided(pick("sid"), pick("n").astype(np.int64), first["lead_n"], pick("lacks").astype(np.int64), rows["linked"].to_numpy(), pick("side"), differs, first["i"] != first["j"], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _between_members(met: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of the leads that are not linked to all of theirs."""
    open_ = met.filter("members > 1").groupBy("lead").agg(F.bool_and("linked").alias("all")).filter("not all").select("lead")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = met.join(open_, "lead").withColumn("side", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    return dealt.select("lead", "i", "j", "side", "sid", "n", "lead_n", "lacks", "linked", "differs").groupBy("lead", "i", "j").applyInArrow(_decided(percent), "a long, b long")


def links_of(docs: DataFrame, signatures: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Classes (sid, rep, n) and confirmed links (a, b) between them, enough to join all that are linked."""
    classes = signatures.filter("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.first("row").alias("row"), F.first("n").alias("n"), F.first("u").alias("u"), F.first("v").alias("v"))
    classes = stored(classes)
    members = _in_buckets(classes)
    wanted = members.select("sid").distinct().join(classes, "sid").select(F.col("row").alias("_row"))
    sought = docs.select(row_key(key, text).alias("_row"), F.col(f"`{text}`").alias("_text")).join(wanted, "_row", "left_semi")
    own = _sets(width)(F.col("_text"))
    sets = stored(sought.select(own.alias("s")).select("s.*").dropDuplicates(["sid"]))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    meets = members.join(sizes, "bucket").groupBy("sid").agg(F.sum("size").alias("meets"))
    ranked = members.join(meets, "sid")
    leads = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "sid"))["sid"].alias("lead"))
    groups = stored(members.join(leads, "bucket").filter("sid <> lead").select("lead", "sid").distinct())
    met = stored(_against_leads(groups, sets, percent))
    near = met.filter("linked").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    return classes, stored(near.unionByName(_between_members(met, percent)))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """(id, row, n, part, component, kept) of every row: ``component`` is the smallest id reachable, ``part`` names the group also where it has no id."""
    signatures = signed(docs, key, text, width)
    classes, links = links_of(docs, signatures, key, text, width, percent)
    parts = stored(connected_components(links, "a", "b").select(F.col("node").alias("sid"), F.col("component").alias("part")))
    least = parts.join(classes, "sid").groupBy("part").agg(F.min("rep").alias("least"))
    linked = parts.join(least, "part").select("sid", "part", "least")
    named = classes.join(linked, "sid", "left").select("sid", F.coalesce("part", "sid").alias("part"), F.coalesce("least", "rep").alias("component"))
    out = signatures.drop("u", "v").withColumn("sid", F.when(F.col("n") > 0, F.col("sid"))).join(named, "sid", "left")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select("id", "row", "n", "part", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def copies_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``docs`` with one row of every group. Rows equal in id and text are told apart by number; others meet their verdict by hash."""
    groups = grouped(docs, key, text, width, percent)
    # A group whose rows share an id, or have none, may keep several rows: all but one of those must go too.
    kept = groups.filter("kept and n > 0").groupBy("part", "row").count()
    one = stored(kept.groupBy("part").agg(F.min("row").alias("row"), F.sum("count").alias("rows")))
    several = one.filter("rows > 1").select("row", F.lit("one").alias("act"))
    gone = groups.filter("n > 0").select("row").distinct().join(one, "row", "left_anti").select("row", F.lit("go").alias("act"))
    row, act, nth = free(docs, "row", "act", "nth")
    acts = stored(several.unionByName(gone)).select(F.col("row").alias(row), F.col("act").alias(act))
    met = docs.withColumn(row, row_key(key, text)).join(acts, row, "left")
    rest = met.filter(F.col(act).isNull()).withColumn(nth, F.lit(1))
    single = met.filter(F.col(act) == "one").withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0))))
    return rest.unionByName(single.filter(F.col(nth) == 1)).select(*(F.col(f"`{c}`") for c in docs.columns))
