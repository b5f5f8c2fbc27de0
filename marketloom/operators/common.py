"""Shapes shared by many operators, written so that one hot key is never one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a maximum that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("top"))
    return top.select(*keys, *[F.col("top")[c].alias(c) for c in order + rest]).select(*df.columns)


def latest_by_map_safe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Like :func:`latest_by` for rows with maps, which have no order: ``max_by`` on the order columns."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("top"))
    return top.select(*keys, *[F.col("top")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per group; Spark prunes each task's rows to the limit before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("_rank") <= limit).drop("_rank")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which NULL keys meet, with the keys of the left side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def first_seen(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Flag ``is_first``: the row is its group's first; a NULL key is a key. A minimum per key joined back, not a sort per key."""
    lowest = df.groupBy(*keys).agg(F.min(position).alias("_first"))
    return join_null_safe(df, lowest, keys).withColumn("is_first", F.col(position) == F.col("_first")).drop("_first")


def previous_row(df: DataFrame, key: str, order: str, columns: list[str], bucket: Column) -> DataFrame:
    """Each row's predecessor within ``key`` by ``order``, as struct ``previous``.

    ``bucket`` must rise with ``order``. Rows are ordered inside (key, bucket) only; the last row of
    each bucket is carried to the next through one row per bucket, so a hot key is split.
    """
    row = F.struct(order, *columns)
    cut = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    cut = cut.withColumn("_near", F.lag(row).over(inside))
    edges = cut.groupBy(key, "_bucket").agg(F.max(row).alias("_last")).withColumn(
        "_far", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))).drop("_last")
    return join_null_safe(cut, edges, [key, "_bucket"]).withColumn("previous", F.coalesce("_near", "_far")).drop("_bucket", "_near", "_far")


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row results as one row: a union folded by ``max``, so no product of tables is built."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def exploded(array: Column | str) -> Column:
    """One row per item of an array without NULL items; for :func:`with_item`.

    A plain ``explode`` of a column makes Spark filter on the array's size first, below the step that builds the array, so that all of
    that step is written into the filter and computed again for each of its uses.
    """
    return F.explode_outer(array)


def with_item(rows: DataFrame, item: str) -> DataFrame:
    """The rows of :func:`exploded` that hold an item."""
    return rows.filter(F.col(item).isNotNull())


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns added or replaced, each computed once a row, also where rows are filtered by them later.

    A filter on columns of a plain projection is moved below it, with what they are computed from written out in it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*rest, one.alias("_once")).select(*rest, *[F.col("_once")[n].alias(n) for n in columns])


def skip_all(value: str | None) -> bool:
    return value is None or value in ("", "all")


def eq_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; a missing, empty or ``all`` value does not filter."""
    for name, value in wanted.items():
        if not skip_all(value):
            df = df.filter(F.col(name) == value)
    return df
