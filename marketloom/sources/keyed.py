"""Keyed tables in hash buckets that take micro-batches exactly once.

A table is a folder with ``data/<version>/_bucket=<k>`` and one small manifest for every version, which says in which version
each bucket was last written and which batch every job has applied. A batch rewrites the buckets its keys fall in and
nothing else, and is published by the rename of one manifest: readers see all of it or none, a crash before the rename
leaves an unused folder that the next attempt overwrites, and a batch that is replayed after it is known by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def buckets_for(rows: int, each: int = 200_000, least: int = 8) -> int:
    """Buckets for a table that is to hold so many rows: a merge sorts and writes each in one task, so they grow in number and not in size."""
    return max(least, -(-rows // each))


class KeyedTable:
    """Rows with one key each. The number of buckets is fixed when a table is made; choose it so that a bucket stays a few hundred MB."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rest}" if rest else self.folder)

    def _versions(self) -> list[int]:
        place = self._path("manifest")
        if not self._fs.exists(place):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(place) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets: bucket -> version, jobs: job -> batch} of the newest or a given version."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": {}, "jobs": {}}
        stream = self._fs.open(self._path(f"manifest/{version or versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        final, fresh = (self._path(f"manifest/{manifest['version']:012d}.{kind}") for kind in ("json", "new"))
        if self._fs.exists(final):
            raise RuntimeError(f"another writer has published version {manifest['version']} of {self.folder}")
        out = self._fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(fresh, final):
            raise OSError(f"could not publish version {manifest['version']} of {self.folder}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _of(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{v}/_bucket={b}" for b, v in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.manifest(version))

    def applied(self, job: str) -> int:
        """The last batch of a job that is in the table, -1 before the first."""
        return self.manifest()["jobs"].get(job, -1)

    def merge(self, rows: DataFrame, job: str, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Lay a batch over the buckets it touches by ``combine(current, rows)``; False if the job had applied it before.

        ``combine`` must keep a key's rows in the key's bucket, which it does if it keeps keys.
        """
        now = self.manifest()
        if now["jobs"].get(job, -1) >= batch:
            return False
        touched = sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())
        version = now["version"] + 1
        if touched:
            merged = combine(self._of(now, touched), rows).select(*self.schema.names).withColumn("_bucket", self.bucket())
            # A file for each bucket, however many tasks the merge has; a large bucket may take several.
            merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/{version}")
        # A bucket that lost all its rows has no folder.
        left = {b for b in touched if self._fs.exists(self._path(f"data/{version}/_bucket={b}"))}
        buckets = {b: v for b, v in now["buckets"].items() if int(b) not in touched} | {str(b): version for b in left}
        self._publish({"version": version, "buckets": buckets, "jobs": now["jobs"] | {job: batch}})
        return True

    def expire(self, keep: int = 2) -> int:
        """Remove manifests but the newest ``keep``, and data that none of these names. Returns how many folders went."""
        versions = self._versions()
        held = {v for n in versions[-keep:] for v in self.manifest(n)["buckets"].values()} | set(versions[-keep:])
        for n in versions[:-keep]:
            self._fs.delete(self._path(f"manifest/{n:012d}.json"), False)
        place, gone = self._path("data"), 0
        # Folders newer than the newest manifest belong to a write that is under way.
        for f in self._fs.listStatus(place) if self._fs.exists(place) and versions else []:
            n = int(f.getPath().getName())
            if n <= versions[-1] and n not in held:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone
