"""Keyed changes to tables kept as plain files: upsert, patch, insert if absent, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], insert_only: list[str] = ("created_at",), order: list[str] = ()) -> DataFrame:
    """``stored`` with ``new`` laid over it by key.

    Columns that ``new`` carries overwrite, NULL included; other columns and the insert-only ones
    keep their stored value. Columns unknown to ``stored`` are dropped. Of several rows of ``new`` with
    one key the last by ``order`` is taken (by their values where none is given), so no key can grow.
    """
    given = [c for c in stored.columns if c in new.columns and c not in keys]
    value_ = F.struct(*given) if given else F.lit(True)
    ranks = [F.col(c) for c in order] or [F.to_json(value_) if given else F.lit(0)]
    fresh = new.groupBy(*keys).agg(F.max_by(value_, F.struct(*ranks)).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(fresh, keys, "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def value(c: str) -> Column:
        if c in keys or c not in given:
            return F.col(c)
        take = is_new & ~is_old if c in insert_only else is_new
        return F.when(take, F.col("_new")[c]).otherwise(F.col(c)).alias(c)

    return both.select(*[value(c) for c in stored.columns])


def patch(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows matching ``where`` get constant values."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` plus the rows of ``new`` whose key it lacks."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def seed_if_empty(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed when the table is empty, else the table."""
    return seed.select(*stored.columns) if stored.isEmpty() else stored


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def recover_table(spark, folder: str) -> None:
    """Put a table back that was moved aside by a run which ended before it moved the new version in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    old = place.suffix("__old")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(place) and not fs.rename(old, place):
        raise OSError(f"could not restore {folder}")


def replace_table(rows: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """Write a new version of a table beside the old one and swap the two folders.

    Between the two renames the table stands in ``__old`` only; :func:`recover_table` puts it back, and every
    call does so first, so a run that died there loses nothing. The work runs on the file system Spark is set up
    with, so the folder may be on any shared store.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fresh, old = place.suffix("__new"), place.suffix("__old")
    recover_table(spark, folder)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh.toString())
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"could not move {folder} aside")
    if not fs.rename(fresh, place):
        raise OSError(f"could not move the new version to {folder}")
    fs.delete(old, True)
