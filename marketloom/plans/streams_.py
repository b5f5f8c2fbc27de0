"""Queries that run the streaming jobs over the event and order tables to their present end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import part_id
from ..operators.common import latest_by
from ..sources.keyed import KeyedTable, buckets_for
from ..streaming import jobs as S
from ..streaming.run import drain, drain_batches, in_batches, stream_table, work_folder
from ..streaming.writer import WriterJob
from .registry import query


def _observations(t):
    lines = stream_table(t.spark, t.folder, "lineitem")
    return lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
                        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("double").alias("price_numeric"), F.col("l_shipdate").alias("observed_at"))


@query("m1_first_captures", "SELECT DISTINCT 'https://a.vn/' || event_type || '/' || CAST(user_id AS VARCHAR) AS url, CAST(1 AS BIGINT) AS kept FROM events")
def _(t):
    events = stream_table(t.spark, t.folder, "events")
    pages = events.select(F.concat(F.lit("https://a.vn/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("captured_at"))
    return drain(S.first_captures(pages), "captures").groupBy("url").agg(F.count("*").alias("kept"))


_PRICE = "CAST(floor(l_extendedprice / l_quantity * 100) AS DOUBLE)"


@query("m2_daily_prices", f"""SELECT 'p' || CAST(l_partkey AS VARCHAR) AS product_id, strftime(l_shipdate, '%Y-%m-%d') AS day, min({_PRICE}) AS min_price, max({_PRICE}) AS max_price, round(avg({_PRICE}), 2) AS avg_price, count(*) AS observation_count FROM lineitem
    WHERE date_trunc('day', l_shipdate) + INTERVAL 1 DAY <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(t):
    return drain(S.daily_price_stream(_observations(t)), "daily").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("m3_sliding_prices", f"""WITH s AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS source, {_PRICE} AS p, l_shipdate, unnest(generate_series(0, 3)) AS k FROM lineitem),
    w AS (SELECT source, p, l_shipdate, TIMESTAMP '1970-01-01' + to_days(CAST((floor(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) / 7) - k) * 7 AS INTEGER)) AS ws FROM s)
    SELECT source, strftime(ws, '%Y-%m-%d') AS window_start, round(avg(p), 2) AS avg_price, count(*) AS count FROM w WHERE l_shipdate < ws + INTERVAL 28 DAY AND ws + INTERVAL 28 DAY <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(t):
    return drain(S.sliding_source_prices(_observations(t), "28 days", "7 days"), "sliding").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("m4_capture_sessions", """WITH m AS (SELECT event_type AS source, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT source, ts, sum(new) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT source, epoch_us(min(ts)) AS started, count(*) AS events FROM s GROUP BY source, n HAVING max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    events = stream_table(t.spark, t.folder, "events").select(F.col("event_type").alias("source"), "ts")
    return drain(S.capture_sessions(events), "sessions").select("source", F.unix_micros("session_start").alias("started"), "events")


def _run_metrics(frame):
    return frame.select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("source_id"), F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
        (F.col("o_orderkey") % 40).alias("valid_products"), F.round((F.col("o_orderkey") % 11) / 10.0, 3).alias("required_coverage"), F.round((F.col("o_orderkey") % 7) / 6.0, 3).alias("brand_coverage"),
        F.round((F.col("o_orderkey") % 9) / 8.0, 3).alias("duplicate_ratio"), F.floor("o_totalprice").cast("double").alias("median_price"), (F.col("o_orderstatus") == "F").alias("quarantined"),
        F.col("o_orderdate").cast("timestamp").alias("run_at"))


_BEFORE = """(SELECT *, last_value(CASE WHEN NOT q THEN n END IGNORE NULLS) OVER w AS pn FROM (SELECT 's' || CAST(o_custkey % 50 AS VARCHAR) AS source_id, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, o_orderkey % 40 AS n, o_orderstatus = 'F' AS q, o_orderdate AS run_at FROM orders)
    WINDOW w AS (PARTITION BY source_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("m5_drift_state", f"SELECT source_id, run_id, coalesce(pn, -1) AS previous_products, CASE WHEN pn >= 5 AND n < pn * 0.5 THEN 'product count dropped from ' || CAST(pn AS VARCHAR) || ' to ' || CAST(n AS VARCHAR) ELSE '' END AS first_warning FROM {_BEFORE} WHERE run_at <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def _(t):
    """Runs in three micro-batches by date; of every month some come a micro-batch late, out of order but within the lateness."""
    runs = _run_metrics(t.orders)
    day = F.datediff("run_at", F.lit("1992-01-01"))
    late = F.pmod(F.xxhash64("run_id"), F.lit(4)) == 0
    # A day's part; a late run from the last 20 days before a part's end comes with the next part.
    part = lambda d: F.least(F.floor(d / 800), F.lit(2))
    runs = runs.withColumn("part", F.when(late, part(day + 20)).otherwise(part(day)).cast("int"))
    runs = drain(S.drift_stream(in_batches(runs, "part", 3, "runs"), "30 days"), "drift")
    first = F.get(F.filter("warnings", lambda w: w.startswith("product count")), 0)
    return runs.select("source_id", "run_id", F.coalesce("previous_valid_products", F.lit(-1)).alias("previous_products"), F.coalesce(first, F.lit("")).alias("first_warning"))


@query("m6_gated_sink", "SELECT 'p' || CAST(l_partkey AS VARCHAR) AS product_id, count(*) FILTER (l_discount < 0.08) AS written, count(*) FILTER (l_discount >= 0.08) AS held FROM lineitem GROUP BY 1")
def _(t):
    place = work_folder(t.spark, "gated")
    rows = stream_table(t.spark, t.folder, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"), "l_discount")
    good, bad = f"{place}/good", f"{place}/bad"
    under = lambda place: lambda rows, batch: rows.write.mode("overwrite").parquet(f"{place}/batch={batch}")
    sink = S.write_gated(under(good), under(bad),
                         lambda d: (d.filter("l_discount < 0.08"), d.filter("l_discount >= 0.08")))
    drain_batches(rows, "gate", sink)
    both = t.spark.read.parquet(good).select("product_id", F.lit(1).alias("w")).unionByName(t.spark.read.parquet(bad).select("product_id", F.lit(0).alias("w")))
    return both.groupBy("product_id").agg(F.sum("w").alias("written"), F.sum(1 - F.col("w")).alias("held"))


# Three batches of product rows. In the second, sources with even numbers lose most rows; in the third, some ask ten times the price.
_GROUP, _SHOP = "CAST(floor(pk / 100) AS BIGINT) % 8", "pk % 100"
_RUNS = f"""SELECT product_id, product_name, brand, product_url, currency, store_name, store_url, store_address, store_phone, domain, source_id, raw_page_id || '-' || CAST(k AS STRING) AS raw_page_id,
    CASE WHEN k = 2 AND {_SHOP} % 10 = 3 THEN price_numeric * 10 ELSE price_numeric + 1000 * k END AS price_numeric, k FROM products CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks
    WHERE (k = 0 AND {_GROUP} < 6) OR (k = 1 AND {_GROUP} < CASE WHEN pk % 2 = 0 THEN 1 ELSE 7 END) OR k = 2"""


def _verdict(now, before):
    return f"""CASE WHEN {now}.r < 0.65 THEN 'required coverage below 65%' WHEN {before}.n >= 5 AND {now}.n < {before}.n * 0.3 THEN 'product count dropped more than 70% (' || CAST({before}.n AS VARCHAR) || ' -> ' || CAST({now}.n AS VARCHAR) || ')'
        WHEN {now}.m <> 0 AND abs({now}.m - {before}.m) / nullif({before}.m, 0) > 0.8 THEN 'median price changed more than 80%' END"""


_ACCEPTED = f"""WITH arrivals AS ({_RUNS}),
    m AS (SELECT source_id, k, count(*) AS n, round(avg(CASE WHEN product_name <> '' AND product_url <> '' AND coalesce(price_numeric, 0) > 0 THEN 1 ELSE 0 END), 3) AS r,
        list_sort(list(price_numeric) FILTER (price_numeric > 0))[CAST(floor(count(*) FILTER (price_numeric > 0) / 2) AS BIGINT) + 1] AS m FROM arrivals GROUP BY source_id, k),
    v0 AS (SELECT a.*, CASE WHEN a.r < 0.65 THEN 'required coverage below 65%' END AS reason FROM m a WHERE k = 0),
    p1 AS (SELECT * FROM v0 WHERE reason IS NULL),
    v1 AS (SELECT a.*, {_verdict('a', 'p')} AS reason FROM m a LEFT JOIN p1 p ON a.source_id = p.source_id WHERE a.k = 1),
    p2 AS (SELECT source_id, arg_max(n, k) AS n, arg_max(m, k) AS m FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1) WHERE reason IS NULL GROUP BY source_id),
    v2 AS (SELECT a.*, {_verdict('a', 'p')} AS reason FROM m a LEFT JOIN p2 p ON a.source_id = p.source_id WHERE a.k = 2),
    judged AS (SELECT arrivals.*, v.reason FROM arrivals JOIN (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2) v USING (source_id, k)),
    kept AS (SELECT * FROM judged WHERE reason IS NULL)
    """


def _stores_of(rows):
    own = [F.col(c) for c in ("source_id", "domain", "store_name", "store_address", "store_url")]
    return rows.filter(F.coalesce("store_address", F.lit("")) != "").select(part_id(*own).alias("store_location_id"), "store_name", "store_address", "store_phone", "store_url", "domain", "source_id", "raw_page_id", "updated_at")


_WRITTEN: dict[tuple[str, str], WriterJob] = {}


def _writer(t):
    """The writer job after three micro-batches, run once a session and folder. ``updated_at`` is the hour of the batch."""
    run = (t.spark.sparkContext.applicationId, t.folder)
    if run not in _WRITTEN:
        _WRITTEN[run] = _run_writer(t)
    return _WRITTEN[run]


def _run_writer(t):
    rows = t.spark.sql(_RUNS.replace("FROM products", "FROM {products}"), products=t.products)
    rows = rows.withColumns({"rule_version": F.lit("v1"), "data_origin": F.lit("crawled"), "updated_at": F.timestamp_seconds(F.lit(1704067200) + 3600 * F.col("k"))})
    stream = in_batches(rows, "k", 3, "runs")
    job = WriterJob(t.spark, work_folder(t.spark, "writer"), rows.drop("k").limit(0), _stores_of, buckets=buckets_for(t.part.count(), least=4))
    drain_batches(stream, "writer", job.sink)
    return job


@query("m6_written_products", _ACCEPTED + "SELECT product_id, arg_max(price_numeric, k) FILTER (price_numeric IS NOT NULL) AS price_numeric, max(raw_page_id) AS raw_page_id, CAST(min(k) AS BIGINT) AS first_batch FROM kept GROUP BY product_id")
def _(t):
    hour = ((F.unix_timestamp("created_at") - 1704067200) / 3600).cast("long")
    return _writer(t).products.read().select("product_id", "price_numeric", "raw_page_id", hour.alias("first_batch"))


@query("m6_written_offers", _ACCEPTED + "SELECT product_id, domain, arg_max(price_numeric, k) AS price_numeric, max(raw_page_id) AS raw_page_id FROM kept WHERE price_numeric > 0 GROUP BY product_id, domain")
def _(t):
    return _writer(t).offers.read().select("product_id", "domain", "price_numeric", "raw_page_id")


@query("m6_written_observations", _ACCEPTED + "SELECT product_id, raw_page_id, price_numeric FROM kept WHERE price_numeric > 0")
def _(t):
    return _writer(t).observations.read().select("product_id", "raw_page_id", "price_numeric")


@query("m6_written_stores", _ACCEPTED + "SELECT source_id, domain, store_name, store_address, max(k) AS last_batch FROM judged WHERE coalesce(store_address, '') <> '' GROUP BY ALL")
def _(t):
    hour = ((F.unix_timestamp("updated_at") - 1704067200) / 3600).cast("int")
    return _writer(t).stores.read().select("source_id", "domain", "store_name", "store_address", hour.alias("last_batch"))


@query("m6_quarantine", _ACCEPTED + "SELECT CAST(k AS BIGINT) AS batch, source_id, product_id, reason FROM judged WHERE reason IS NOT NULL")
def _(t):
    return _writer(t).quarantine.read().select("batch", "source_id", F.col("payload")["product_id"].alias("product_id"), "reason")


@query("m7_newest_offers", "SELECT offer_id, max(struct_pack(updated_at := updated_at, price_numeric := price_numeric)).price_numeric AS price_numeric FROM offers GROUP BY offer_id")
def _(t):
    """Order lines in four micro-batches, in no order of time; each rewrites the buckets it touches."""
    price = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("double"))
    arrived = t.lineitem.select(F.concat(F.lit("o"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("offer_id"), price.alias("price_numeric"), F.col("l_shipdate").alias("updated_at"), F.pmod(F.xxhash64("l_orderkey"), F.lit(4)).cast("int").alias("k"))
    table = KeyedTable(t.spark, work_folder(t.spark, "offers"), arrived.drop("k").schema, ["offer_id"], buckets_for(t.lineitem.count(), least=16))
    drain_batches(in_batches(arrived, "k", 4, "arrivals"), "offers", lambda batch, n: table.merge(batch, "offers", n, S.newest_offers))
    return table.read().select("offer_id", "price_numeric")


@query("m7_newest_offers_batch", "SELECT offer_id, max(struct_pack(updated_at := updated_at, price_numeric := price_numeric)).price_numeric AS price_numeric FROM offers GROUP BY offer_id")
def _(t):
    return latest_by(t.offers.select("offer_id", "updated_at", "price_numeric"), ["offer_id"], ["updated_at", "price_numeric"]).select("offer_id", "price_numeric")
