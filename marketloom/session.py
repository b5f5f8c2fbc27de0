"""Session settings and the two plan helpers every operator shares."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "marketloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partitions stay at the cluster's own value unless given; AQE merges small ones and
    splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Page rows are large: bound an Arrow batch by rows, so a Python worker holds few pages.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started from. Once per context."""
    context = spark.sparkContext
    if getattr(context, "_marketloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/marketloom", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._marketloom_shipped = True


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, an upper bound for filters and projections."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the plan's size estimate is under ``limit``.

    Otherwise the side stays unhinted and the join shuffles, with AQE splitting skewed keys.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over all cores, for work that costs far more than reading: a table of many rows may be one small file, which is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder comes from ``spark.checkpoint.dir``. Only a local session that has none uses a folder under
    the warehouse; a cluster without the setting is an error, as a machine-local folder would not survive
    the loss of an executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
