"""Running a stream to its present end, with its output in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for stream output and progress, under ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder under the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder as a stream. Times without a zone become plain timestamps, as
    watermarks need them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    zoneless = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({c: stream[c].cast("timestamp") for c in zoneless}) if zoneless else stream


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, append it to parquet and read that back."""
    spark = stream.sparkSession
    place = work_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/progress").outputMode(
        "append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def drain_batches(stream: DataFrame, name: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process everything available through a per-batch function."""
    place = work_folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()


def in_batches(rows: DataFrame, part: str, count: int, name: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """``rows`` as a stream of ``count`` micro-batches: those with ``part`` = 0 first, then 1, and so on.

    Every part is written as the same number of files, which is what a micro-batch takes.
    """
    spark = rows.sparkSession
    place = f"{work_folder(spark, name)}/input"
    held = {r[0]: r[1] for r in rows.groupBy(part).count().collect() if r[0] is not None}
    files = max(1, min((held.get(k, 0) for k in range(count)), default=0) // rows_per_file)
    for k in range(count):
        rows.filter(rows[part] == k).drop(part).repartition(files).write.mode("append").parquet(place)
    schema = rows.drop(part).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(place)
