"""The writer job: micro-batches of product rows through the quality gate into keyed tables, exactly once.

Each table has its own ledger, so a batch that broke off between two tables is finished by its replay, and no table takes it
twice. The gate's verdict is the same in a replay: a batch is compared with the last accepted metrics of *earlier* batches,
whatever the metrics table holds by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality as Q
from ..operators.common import latest_by_map_safe
from ..operators.payloads import offers, price_observations
from ..sources.keyed import KeyedTable
from ..sources.upsert import upsert

JOB = "writer"


class WriterJob:
    """Tables products, offers, observations, stores, quarantine and metrics under one folder."""

    def __init__(self, spark: SparkSession, folder: str, rows: DataFrame, stores_of: Callable[[DataFrame], DataFrame] | None = None, sources: DataFrame | None = None, buckets: int = 16):
        """``rows`` is an example of the batches, for their schema; ``stores_of`` takes a batch's store rows from it (store_location_id, ...)."""
        self.stores_of, self.sources = stores_of, sources
        with_created = lambda df: df.withColumn("created_at", F.lit(None).cast("timestamp"))
        table = lambda name, df, keys: KeyedTable(spark, f"{folder}/{name}", T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]), keys, buckets)
        self.products = table("products", with_created(rows), ["product_id"])
        self.offers = table("offers", with_created(offers(rows)), ["offer_id"])
        self.observations = table("observations", with_created(price_observations(rows)), ["observation_id"])
        self.stores = table("stores", with_created(stores_of(rows)), ["store_location_id"]) if stores_of else None
        metrics = Q.page_metrics(rows, ["source_id"])
        self.metrics = table("metrics", metrics.select("source_id", F.lit(0).cast("long").alias("batch"), *Q.METRICS, F.lit(False).alias("quarantined")), ["source_id", "batch"])
        held = Q.route_gate(rows, metrics, metrics, "source_id", ["source_id"])[1]
        self.quarantine = table("quarantine", self._kept_back(held, 0), ["batch", "row"])

    @staticmethod
    def _kept_back(held: DataFrame, batch: int) -> DataFrame:
        payload = F.struct(*(c for c in held.columns if c not in ("metrics", "previous_metrics", "reason")))
        rows = held.select(F.lit(batch).cast("long").alias("batch"), F.xxhash64(F.to_json(payload)).alias("row"), "source_id", "reason", payload.alias("payload"), "metrics", "previous_metrics")
        return rows

    def baseline(self, batch: int) -> DataFrame:
        """Every source's metrics of the last accepted batch before ``batch``."""
        earlier = self.metrics.read().filter((F.col("batch") < batch) & ~F.col("quarantined"))
        return latest_by_map_safe(earlier, ["source_id"], ["batch"]).select("source_id", *Q.METRICS)

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. The batch is judged once, and what came of it goes to all tables."""
        metrics = Q.page_metrics(batch, ["source_id"]).persist()
        written, held = (df.persist() for df in Q.route_gate(batch, metrics, self.baseline(batch_id), "source_id", ["source_id"], self.sources))
        try:
            self.write(batch, metrics, written, held, batch_id)
        finally:
            for df in (written, held, metrics):
                df.unpersist()

    def write(self, batch: DataFrame, metrics: DataFrame, written: DataFrame, held: DataFrame, batch_id: int) -> None:

        def lay(order):
            return lambda now, new: upsert(now, new.withColumn("created_at", F.col(order[0])), table.keys, order=order)

        if self.stores is not None:
            table = self.stores
            table.merge(self.stores_of(batch), JOB, batch_id, lay(["updated_at"]))
        # Of several rows of a batch with one key the newest counts, then the one of the greatest page.
        table = self.products
        table.merge(written, JOB, batch_id, lay(["updated_at", "raw_page_id"]))
        table = self.offers
        table.merge(offers(written), JOB, batch_id, lay(["updated_at", "raw_page_id"]))
        table = self.observations
        table.merge(price_observations(written), JOB, batch_id, lay(["observed_at"]))
        back = self._kept_back(held, batch_id)
        self.quarantine.merge(back, JOB, batch_id, lambda now, new: now.unionByName(new.dropDuplicates(self.quarantine.keys)))
        verdict = held.groupBy("source_id").agg(F.lit(True).alias("quarantined")).withColumnRenamed("source_id", "_source")
        run = metrics.join(verdict, F.col("source_id").eqNullSafe(F.col("_source")), "left").select("source_id", F.lit(batch_id).cast("long").alias("batch"), *Q.METRICS, F.coalesce("quarantined", F.lit(False)).alias("quarantined"))
        self.metrics.merge(run, JOB, batch_id, lambda now, new: now.unionByName(new))
