"""Two-pass external shuffle into shards.

Pass one scatters rows into buckets that fit a task: a seeded hash of the id picks the shard, as the
shard with the largest hash of (id, shard), so one more shard only takes rows and moves none between
the others; a second hash spreads the rows of a shard over its buckets. The number of buckets follows
from all bytes. Pass two permutes every bucket by a seeded Fisher-Yates shuffle (``F.shuffle``) and
numbers the rows; a bucket starts where the counts of the buckets before it end. Only built-in
columns are used.

Rows are ordered inside a bucket before they are gathered and the number of tasks is fixed, so a
lost task gives the same permutation when it runs again. Defined results: a null id counts as the
text ``null`` and goes to one shard, spread over that shard's buckets by the other columns of the
hash; a null text has no bytes; repeated rows are all kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, parts

SHARDS = 40
BUCKET_BYTES = 8 << 20
ROW_BYTES = 16
SEED = 20240607


def shard_of(key, shards: int, seed: int = SEED):
    """The shard with the largest seeded hash of (key, shard)."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(drawn)["s"].cast("int")


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = None, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (gapless from 0 in a shard) and ``grown_shard`` (with one more shard).

    ``size`` names a column with the bytes of a row, where ``text`` is not among the columns.
    """
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    weight = F.col(f"`{size}`") if size else F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + ROW_BYTES
    total = docs.agg(F.sum(weight).alias("b")).first().b or 0
    per_shard = parts(total, shards * bucket_bytes)
    tasks = parts(shards * per_shard, 4, min(shards, 64))
    row, home, slot, grown, bucket, order = free(docs, "row", "shard", "slot", "grown_shard", "bucket", "order")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    drawn = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), shard_of(named, shards, seed).alias(home), F.xxhash64(F.lit(seed + 1), named, *hashed).alias(order))
    drawn = drawn.withColumn(bucket, F.pmod(order, F.lit(per_shard)))
    dealt = drawn.repartition(tasks, home, bucket).sortWithinPartitions(home, bucket, order)
    gathered = dealt.groupBy(home, bucket).agg(F.collect_list(row).alias(row))
    permuted = gathered.select(home, bucket, F.shuffle(row, F.lit(seed + 2)).alias(row))
    counts = drawn.groupBy(home, bucket).count()
    starts = counts.select(F.col(home).alias("s"), F.col(bucket).alias("b"), (F.sum("count").over(Window.partitionBy(home).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).alias("start"))
    placed = permuted.join(starts, (F.col(home) == F.col("s")) & (F.col(bucket) == F.col("b")))
    rows = placed.select(home, F.coalesce("start", F.lit(0)).alias("start"), F.posexplode(row).alias("at", row))
    out = rows.select(*(F.col(row)[c].alias(c) for c in docs.columns), home, (F.col("start") + F.col("at")).cast("long").alias(slot))
    # One more shard wins a row only if its hash beats the best so far, so only that one is compared.
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    beats = F.xxhash64(F.lit(seed), named, F.lit(shards)) > F.xxhash64(F.lit(seed), named, F.col(home))
    return out.withColumn(grown, F.when(beats, F.lit(shards)).otherwise(F.col(home)).cast("int"))


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """Write the shards, one subfolder each, rows in the order of their slots within a file."""
    sharded(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
