"""Structured Streaming forms of capture, price and quality jobs.

State is bounded by watermarks or by one entry per key. Sinks are given the batch number and write under it, so a
batch that is replayed replaces what it wrote before.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.common import latest_by_map_safe
from ..operators.quality import METRICS, drift_warnings, metric_struct
from ..sources.upsert import upsert


def first_captures(pages: DataFrame, hours: int = 24) -> DataFrame:
    """First capture of a URL within the hours; later ones are dropped while state lasts."""
    return pages.withWatermark("captured_at", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def daily_price_stream(observations: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Low, high, mean and count per product and day."""
    price = F.col("price_numeric")
    return observations.filter(price > 0).withWatermark("observed_at", lateness).groupBy(
        "product_id", F.window("observed_at", "1 day").alias("w")).agg(
        F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.round(F.avg(price), 2).alias("avg_price"),
        F.count("*").alias("observation_count")).select("product_id", F.col("w")["start"].alias("day"), "min_price", "max_price", "avg_price", "observation_count")


def sliding_source_prices(observations: DataFrame, width: str = "30 days", slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Mean price per source over sliding windows."""
    return observations.filter("price_numeric > 0").withWatermark("observed_at", lateness).groupBy(
        "source", F.window("observed_at", width, slide).alias("w")).agg(
        F.round(F.avg("price_numeric"), 2).alias("avg_price"), F.count("*").alias("count")).select(
        "source", F.col("w")["start"].alias("window_start"), "avg_price", "count")


def capture_sessions(events: DataFrame, gap: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Runs of capture events per source with no pause longer than the gap."""
    df = events.withWatermark("ts", lateness) if events.isStreaming else events
    return df.groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(
        "source", F.col("w")["start"].alias("session_start"), F.col("w")["end"].alias("session_end"), "events")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastMetrics(StatefulProcessor):
    """Pairs each run of a source, in order of time, with the source's last accepted metrics.

    A run waits in a list until the watermark has passed its time, so runs that arrive out of order, also in later
    micro-batches, are paired in order. Of a source only the runs inside the allowed lateness are held.
    """

    LAST = "run_id string, valid_products long, required_coverage double, brand_coverage double, duplicate_ratio double, median_price double"
    WAITING = f"run_at timestamp, quarantined boolean, {LAST}"
    NAMES = ["run_id", *METRICS]
    FRAME = 20_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.LAST)
        self.waiting = handle.getListState("waiting", self.WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[["run_at", "quarantined", *self.NAMES]].astype(object)
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)])
            first = min(filter(None, (first, _millis(frame["run_at"].min()))))
        self._wake(first)
        return iter(())

    def _wake(self, time: int) -> None:
        """One timer a source, for its earliest run: when it fires, all that the watermark has passed goes at once."""
        if time < min(self.handle.listTimers(), default=time + 1):
            self.handle.registerTimer(time)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, late = [], []
        for run in map(tuple, self.waiting.get()):
            (ready if _millis(run[0]) <= passed else late).append(run)
        if not ready:
            return  # An earlier timer of this micro-batch has released them.
        ready.sort(key=lambda w: (w[0], w[2]))
        if late:
            self.waiting.put(late)
            self.handle.registerTimer(min(_millis(w[0]) for w in late))
        else:
            self.waiting.clear()
        last = tuple(self.last.get()) if self.last.exists() else (None,) * len(self.NAMES)
        for start in range(0, len(ready), self.FRAME):
            out = []
            for run_at, quarantined, *values in ready[start:start + self.FRAME]:
                out.append((key[0], run_at, *values, *last))
                if not quarantined:
                    last = tuple(values)
            yield pd.DataFrame(out, columns=["source_id", "run_at", *self.NAMES, *[f"previous_{n}" for n in self.NAMES]]).astype(
                {f"{p}valid_products": "Int64" for p in ("", "previous_")})
        if last[0] is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


def _millis(time) -> int:
    """Milliseconds of a time, rounded up, so that a timer never fires before it."""
    return -(-pd.Timestamp(time).value // 1_000_000)


_PAIRED = ", ".join(["source_id string", "run_at timestamp", *[f"{p}{c.strip()}" for p in ("", "previous_") for c in LastMetrics.LAST.split(",")]])


def drift_stream(runs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Drift warnings of a stream of run metrics (source_id, run_id, run_at, metrics, quarantined).

    A run is paired once no run that is at most ``lateness`` older can still come; later ones are dropped, and so is a
    run without a time, which has no place in the order. Runs of one time go by their id. The state operator
    needs the RocksDB state store, which is set here.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The operator's set-up process does not see shipped packages, so the class travels by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    paired = runs.filter("run_at IS NOT NULL").withWatermark("run_at", lateness).groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=LastMetrics(), outputStructType=_PAIRED, outputMode="Append", timeMode="EventTime")
    before = F.when(F.col("previous_run_id").isNotNull(), metric_struct("previous_"))
    return paired.withColumn("warnings", drift_warnings(metric_struct(), before))


def write_gated(written: Callable[[DataFrame, int], None], held: Callable[[DataFrame, int], None],
                route: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that sends each micro-batch through a gate to two writers of (rows, batch number)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good, bad = route(batch)
            written(good, batch_id)
            held(bad, batch_id)
        finally:
            batch.unpersist()

    return sink


def newest_offers(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """Current offers after a batch: the latest event time per offer wins, and the higher price at one time, however rows arrive."""
    latest = latest_by_map_safe(arrived, ["offer_id"], ["updated_at", "price_numeric"])
    place = F.struct("updated_at", "price_numeric")
    held = current.select("offer_id", place.alias("_held"))
    fresh = latest.join(held, "offer_id", "left").filter(F.col("_held").isNull() | (place >= F.col("_held"))).drop("_held")
    return upsert(current, fresh, ["offer_id"])
