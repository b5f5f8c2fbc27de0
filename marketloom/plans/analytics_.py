"""Queries over products, offers, sources and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.urls import without_www
from ..operators import analytics as O
from ..operators import common as M
from . import ansi as A
from .registry import query
from .resolution_ import CANONICAL, canonical



def AS_OF():
    return F.lit("2001-12-01").cast("timestamp")


AS_OF_SQL = "TIMESTAMP '2001-12-01'"


def _quarantine(t):
    """Products a gate would hold back: those without a price."""
    return t.products.filter("price_numeric IS NULL")


@query("e1_search_products", """SELECT product_id, product_name, updated_at FROM products WHERE domain = 'www.shop2.vn' AND (category = 'LARGE' OR normalized_category = 'LARGE' OR true)
    AND (store_name ILIKE '%SHOP 2%' OR store_url ILIKE '%SHOP 2%' OR store_address ILIKE '%SHOP 2%') AND (product_name ILIKE '%brand#1%' OR product_url ILIKE '%brand#1%') ORDER BY updated_at DESC, product_id LIMIT 50""")
def _(t):
    return O.search_products(t.products, text="brand#1", source="www.shop2.vn", store="SHOP 2", category_name="all", limit=50).select("product_id", "product_name", "updated_at")


@query("e1_search_by_category", "SELECT product_id, domain FROM products WHERE category = 'LARGE' OR normalized_category = 'LARGE' ORDER BY updated_at DESC, product_id LIMIT 80")
def _(t):
    return O.search_products(t.products, category_name="LARGE").select("product_id", "domain")


@query("e2_product_view", f"""SELECT product_id, product_name AS name, CASE WHEN price_numeric > 0 THEN price_numeric END AS price, CASE WHEN price_numeric > 0 THEN 'FOUND' ELSE 'MISSING' END AS price_status,
    {A.category("coalesce(nullif(category, ''), normalized_category)", 'product_name', 'product_url', 'domain')} AS category, coalesce(store_name, '') AS store_name, store_address, 'MISSING' AS address_status, domain AS source FROM products""")
def _(t):
    return O.product_view(t.products).select("product_id", "name", "price", "price_status", "category", "store_name", "store_address", "address_status", "source")


@query("e2_view_of_url_names", f"SELECT product_id, {A.name_from_url('product_url')} AS name, product_url AS url FROM products")
def _(t):
    return O.product_view(t.products.withColumns({"product_name": F.col("product_url"), "product_url": F.lit("")})).select("product_id", "name", "url")


_JOB = "CASE status WHEN 'pending' THEN 'Pending' WHEN 'running' THEN 'Processing' WHEN 'failed' THEN 'Failed' ELSE 'Completed' END"


@query("e3_page_view", f"SELECT raw_page_id AS id, raw_page_id || '.' || coalesce(content_type, 'mhtml') AS filename, coalesce(task_id, raw_page_id) AS task_id, domain, content_length AS size, {_JOB} AS status, captured_at AS updated_at FROM raw_pages")
def _(t):
    return O.raw_page_view(t.raw_pages).select("id", "filename", "task_id", "domain", "size", "status", "updated_at")


@query("e3_job_view", f"SELECT coalesce(task_id, raw_page_id) AS id, {_JOB} AS status, captured_at AS timestamp FROM raw_pages ORDER BY captured_at DESC, id LIMIT 50")
def _(t):
    return O.job_view(t.raw_pages).select("id", "status", "timestamp")


@query("e4_source_view", "SELECT source_id AS id, name, url, category, coalesce(store_scope, 'site') AS store_scope, coalesce(store_channel, 'online') AS store_channel, coalesce(auto_promote_rules, true) AS auto_promote_rules, coalesce(quality_gate_enabled, true) AS quality_gate_enabled FROM sources")
def _(t):
    return O.source_view(t.sources).select("id", "name", "url", "category", "store_scope", "store_channel", "auto_promote_rules", "quality_gate_enabled")


@query("e5_candidate_list", "SELECT candidate_id, domain, status, score FROM candidates WHERE status = 'validated' ORDER BY updated_at DESC, candidate_id LIMIT 50")
def _(t):
    return O.list_rows(t.candidates, [F.desc("updated_at"), F.col("candidate_id")], 50, status="validated", domain="all").select("candidate_id", "domain", "status", "score")


@query("e5_run_list", "SELECT run_id, status, created_at FROM runs WHERE pipeline_id = 'c7' ORDER BY created_at DESC, run_id LIMIT 20")
def _(t):
    return O.list_rows(t.runs, [F.desc("created_at"), F.col("run_id")], 20, pipeline_id="c7").select("run_id", "status", "created_at")


@query("e6_dedup_list", "SELECT candidate_id, status, score AS confidence FROM candidates ORDER BY (status <> 'rejected'), score DESC, candidate_id LIMIT 100")
def _(t):
    queue = t.candidates.select("candidate_id", F.when(F.col("status") == "rejected", "pending").otherwise("validated").alias("status"), F.col("score").alias("confidence"))
    return O.dedup_queue_list(queue, limit=100).replace("pending", "rejected", "status")


@query("e7_source_filter", "SELECT source_id FROM sources WHERE contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(url, ''), coalesce(category, ''), coalesce(type, ''), coalesce(note, ''))), 'nation_1')")
def _(t):
    return O.text_filter(t.sources, "NATION_1", ["name", "url", "category", "type", "note"]).select("source_id")


_LAST = "SELECT pipeline_id, max(struct_pack(created_at := created_at, run_id := run_id, status := status)) AS r, count(*) AS n FROM runs GROUP BY pipeline_id"


def _flow_view(t):
    return O.pipeline_view(t.pipelines, O.latest_runs(t.runs))


@query("e7_flow_filter", f"SELECT p.pipeline_id FROM pipelines p JOIN ({_LAST}) l ON p.pipeline_id = l.pipeline_id WHERE l.r.status IN ('blocked', 'failed') AND (contains(lower(name), 'shop1') OR contains(data, 'shop1') OR contains(lower(data), 'description\":\"shop1'))")
def _(t):
    return O.pipeline_filter(_flow_view(t), "warning", "Shop1").select("pipeline_id")


@query("e7_job_filter", f"SELECT coalesce(task_id, raw_page_id) AS id FROM raw_pages WHERE {_JOB} NOT IN ('Completed', 'Failed') AND (contains(lower(coalesce(task_id, raw_page_id)), '1') OR contains(domain, '1') OR contains(raw_page_id, '1'))")
def _(t):
    return O.job_filter(O.job_view(t.raw_pages, None), "running", "1").select("id")


@query("e8_flow_view", f"""SELECT p.pipeline_id, name, enabled, json_extract_string(data, '$.mode') AS mode, json_extract_string(data, '$.description') AS description, CAST(json_array_length(data, '$.source_ids') AS INTEGER) AS source_count,
    coalesce(CAST(json_extract_string(data, '$.page_budget') AS INTEGER), 100) AS page_budget, coalesce(n, 0) AS run_count, l.r.run_id AS last_run_id, l.r.status AS last_run_status FROM pipelines p LEFT JOIN ({_LAST}) l ON p.pipeline_id = l.pipeline_id""")
def _(t):
    return _flow_view(t).select("pipeline_id", "name", "enabled", "mode", "description", "source_count", "page_budget", "run_count", "last_run_id", "last_run_status")


@query("e9_merge_patch", """SELECT ok, CASE WHEN ok % 2 = 0 THEN 'done' ELSE status END AS status, CASE WHEN ok % 2 = 0 THEN 'patched' ELSE kind END AS kind, CASE WHEN ok % 2 = 0 THEN CAST(ok AS VARCHAR) END AS extra FROM runs""")
def _(t):
    docs = t.runs.select("ok", "status", F.create_map(F.lit("kind"), F.col("kind"), F.lit("status"), F.col("status")).alias("data"))
    patches = t.runs.filter("ok % 2 = 0").select("ok", F.create_map(F.lit("kind"), F.lit("patched"), F.lit("status"), F.lit("done"), F.lit("extra"), F.col("ok").cast("string")).alias("data"))
    out = O.merge_patch(docs, patches, "ok")
    return out.select("ok", "status", *[F.try_element_at("data", F.lit(k)).alias(k) for k in ("kind", "extra")])


@query("f1_product_stats", "SELECT count(*) AS total, count(DISTINCT domain) AS sources FROM products")
def _(t):
    return O.product_stats(t.products)


@query("f2_product_sources", "SELECT 'all' AS source UNION ALL SELECT DISTINCT domain FROM products")
def _(t):
    return O.product_sources(t.products)


_HISTORY = f"SELECT strftime(updated_at, '%Y-%m') AS month, round(avg(price_numeric), 0) AS avg_price, count(*) AS count FROM offers WHERE price_numeric > 0 AND updated_at >= {AS_OF_SQL} - INTERVAL {{days}} DAY GROUP BY 1"


@query("f5_monthly_price_history", _HISTORY.format(days=400))
def _(t):
    return O.monthly_price_history(t.offers, AS_OF())


_CHANGE = """SELECT *, lag(month) OVER (ORDER BY month) AS prev_month, lag(avg_price) OVER (ORDER BY month) AS prev_avg_price,
    round((avg_price - lag(avg_price) OVER (ORDER BY month)) / nullif(lag(avg_price) OVER (ORDER BY month), 0) * 100, 1) AS change_pct"""


@query("h5_monthly_change", f"{_CHANGE} FROM ({_HISTORY.format(days=3000)})")
def _(t):
    return O.monthly_change(O.monthly_price_history(t.offers, AS_OF(), 3000))


_TREND = f"""(SELECT coalesce(CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || CAST(CAST(change_pct AS DECIMAL(18,1)) AS VARCHAR) || '% (' || prev_month || ' -> ' || month || ')', 'N/A')
    FROM ({_CHANGE} FROM ({_HISTORY.format(days=400)})) ORDER BY month DESC LIMIT 1)"""
_MARKET = f"(SELECT round(avg(CASE WHEN price_numeric > 0 THEN price_numeric END), 0) FROM products) AS avg_price, 'VND' AS currency, {_TREND} AS trend"


@query("f3_market_stats", f"SELECT {_MARKET}")
def _(t):
    return O.market_stats(t.products, t.offers, AS_OF())


@query("f4_source_price_comparison", "SELECT source, round(avg(price_numeric), 0) AS avg_price, count(*) AS count FROM observations WHERE price_numeric > 0 GROUP BY source")
def _(t):
    return O.source_price_comparison(t.observations)


_COUNTS = "count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status IN ('running', 'processing')) AS processing, count(*) FILTER (status IN ('done', 'completed')) AS completed, count(*) FILTER (status = 'failed') AS failed"


@query("f6_job_counts", f"SELECT {_COUNTS} FROM raw_pages")
def _(t):
    return O.job_counts(t.raw_pages)


@query("f7_domain_counts", "SELECT domain, count(*) AS products, count(*) FILTER (price_numeric IS NULL) AS quarantined FROM products GROUP BY domain")
def _(t):
    return O.domain_counts(t.products, _quarantine(t))


@query("f8_overview", "SELECT (SELECT count(*) FROM pipelines) AS total, (SELECT count(*) FROM pipelines WHERE enabled) AS enabled, (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM runs WHERE status = 'running') AS running")
def _(t):
    return O.pipeline_overview(t.pipelines, t.runs)


@query("f9_status_totals", "SELECT count(*) AS \"all\", " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("completed", "blocked", "failed", "partial")) + " FROM runs")
def _(t):
    return O.status_totals(t.runs, ["completed", "blocked", "failed", "partial"])


@query("f9_success_share", f"""SELECT count(*) FILTER (s IN ('running', 'queued')) AS running, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s IN ('completed', 'failed', 'blocked', 'partial')) AS finished,
    round(count(*) FILTER (s = 'completed') * 100.0::DOUBLE / count(*) FILTER (s IN ('completed', 'failed', 'blocked', 'partial')), 1) AS success_pct FROM (SELECT l.r.status AS s FROM pipelines p LEFT JOIN ({_LAST}) l ON p.pipeline_id = l.pipeline_id)""")
def _(t):
    return O.success_share(_flow_view(t)).withColumn("success_pct", F.col("success_pct").cast("double"))


@query("f9_runs_by_kind", "SELECT kind, status, count(*) AS n FROM runs GROUP BY 1, 2")
def _(t):
    return t.runs.groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("f20_dashboard", f"SELECT (SELECT count(*) FROM products) AS total, (SELECT count(DISTINCT domain) FROM products) AS sources, {_COUNTS}, {_MARKET} FROM raw_pages")
def _(t):
    return O.dashboard(t.products, t.offers, t.raw_pages, AS_OF())


@query("f21_product_master", f"""SELECT canonical_product_id, arg_min(product_name, product_id) AS canonical_name, arg_min(brand, product_id) AS brand, count(*) AS listing_count, min(price_numeric) AS min_price, max(price_numeric) AS max_price
    FROM products JOIN {CANONICAL} c USING (product_id) GROUP BY canonical_product_id""")
def _(t):
    return O.product_master(t.products.join(canonical(t).select("product_id", "canonical_product_id"), "product_id")).drop("category")


# --- joins ----------------------------------------------------------------------------------

_SITE = A.bare("domain")


_REGISTRY = f"""SELECT source_id AS id, type, {A.labels("lower(category)", K.SOURCE_GROUP_KEYWORDS, K.DEFAULT_SOURCE_GROUP)} AS "group", saved IS NOT NULL AS has_raw_data, coalesce(n, 0) AS product_count, coalesce(q, 0) AS quarantine_count
    FROM (SELECT *, {_SITE} AS site FROM sources) s LEFT JOIN (SELECT DISTINCT {_SITE} AS site, 1 AS saved FROM shop_pages) g USING (site)
    LEFT JOIN (SELECT {_SITE} AS site, count(*) AS n, count(*) FILTER (price_numeric IS NULL) AS q FROM products GROUP BY 1) c USING (site)"""


def _registry(t):
    return O.source_registry(t.sources, t.shop_pages, t.products, _quarantine(t))


@query("g1_source_registry", _REGISTRY)
def _(t):
    return _registry(t).select("id", "type", "group", "has_raw_data", "product_count", "quarantine_count")


@query("f9_source_totals", f"SELECT count(*) FILTER (has_raw_data) AS captured_sources, CAST(sum(product_count) AS BIGINT) AS total_products, CAST(sum(quarantine_count) AS BIGINT) AS quarantined FROM ({_REGISTRY})")
def _(t):
    return O.source_totals(_registry(t))


@query("g2_latest_runs", f"SELECT pipeline_id, r.run_id AS run_id, r.status AS run_status, r.created_at AS run_at, n AS run_count FROM ({_LAST})")
def _(t):
    return O.latest_runs(t.runs)


@query("g3_runs_with_names", "SELECT run_id, status, name AS flow_name FROM runs LEFT JOIN pipelines USING (pipeline_id)")
def _(t):
    return O.runs_with_names(t.runs, t.pipelines).select("run_id", "status", F.col("pipeline_name").alias("flow_name"))


@query("g4_pages_with_rules", f"SELECT p.raw_page_id, r.version FROM (SELECT raw_page_id, 'd' || CAST(pk % 2000 AS VARCHAR) || '.vn' AS d FROM shop_pages) p JOIN active_rules r ON p.d = r.domain")
def _(t):
    pages = t.shop_pages.select("raw_page_id", F.concat(F.lit("d"), (F.col("pk") % 2000).cast("string"), F.lit(".vn")).alias("domain"))
    return pages.join(t.active_rules, "domain").select("raw_page_id", "version")


_CONFIG = "(SELECT source_id, store_name AS c_name, store_address AS c_address, store_channel AS c_channel FROM sources WHERE coalesce(store_scope, 'site') = 'site' AND coalesce(store_name, store_address, store_channel) IS NOT NULL)"


@query("g5_store_config", f"""SELECT product_id, CASE WHEN c.source_id IS NULL THEN store_name ELSE c_name END AS store_name, CASE WHEN c.source_id IS NULL THEN store_address ELSE c_address END AS store_address,
    CASE WHEN c.source_id IS NULL THEN 'x' WHEN c_address IS NOT NULL THEN 'FOUND' WHEN c_channel = 'online' THEN 'NOT_APPLICABLE' ELSE 'MISSING' END AS address_status FROM products p LEFT JOIN {_CONFIG} c ON p.source_id = c.source_id""")
def _(t):
    rows = t.products.withColumn("address_status", F.lit("x"))
    return O.apply_store_config(rows, t.sources, AS_OF()).select("product_id", "store_name", "store_address", "address_status")


@query("g7_semi_anti", f"SELECT (SELECT count(*) FROM shop_pages WHERE {_SITE} IN (SELECT {_SITE} FROM sources)) AS known, (SELECT count(*) FROM shop_pages WHERE {_SITE} NOT IN (SELECT {_SITE} FROM sources)) AS unknown")
def _(t):
    pages, sites = t.shop_pages.select(without_www("domain").alias("site")), t.sources.select(without_www("domain").alias("site"))
    return M.side_by_side(pages.join(sites, "site", "left_semi").agg(F.count("*").alias("known")), pages.join(sites, "site", "left_anti").agg(F.count("*").alias("unknown")))


@query("g8_either_key", "SELECT raw_page_id, task_id FROM raw_pages WHERE raw_page_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders) OR task_id IN (SELECT 't' || CAST(c_custkey * 3 AS VARCHAR) FROM customer)")
def _(t):
    wanted = t.orders.select(F.col("o_orderkey").cast("string").alias("job_id")).union(t.customer.select(F.concat(F.lit("t"), (F.col("c_custkey") * 3).cast("string"))))
    return O.find_by_either_key(t.raw_pages.select("raw_page_id", "task_id"), wanted, "raw_page_id", "task_id").select("raw_page_id", "task_id").distinct()


@query("g11_keyword_rules", f"""WITH rules AS (SELECT p_brand AS category, lower(p_brand) AS keyword, max(p_size) AS priority FROM part GROUP BY 1)
    SELECT raw_page_id, coalesce((SELECT max(struct_pack(priority := priority, category := category)).category FROM rules WHERE contains(lower(html), keyword)), 'none') AS category FROM raw_pages""")
def _(t):
    from ..operators.pages import keyword_category
    rules = t.part.groupBy(F.col("p_brand").alias("category")).agg(F.max("p_size").alias("priority")).withColumn("keyword", F.lower("category"))
    return keyword_category(t.raw_pages, "raw_page_id", "html", rules).select("raw_page_id", F.coalesce("category", F.lit("none")).alias("category"))


@query("g12_url_prefix", f"SELECT p.raw_page_id, s.source_id FROM shop_pages p JOIN sources s ON {A.bare('p.domain')} = {A.bare('s.domain')} AND starts_with(regexp_replace(p.url, '/+$', ''), regexp_replace(s.store_locator_url, '/+$', ''))")
def _(t):
    from ..functions.urls import without_end_slash
    pages = t.shop_pages.select("raw_page_id", "url", without_www("domain").alias("site"))
    sources = t.sources.select("source_id", without_www("domain").alias("site"), without_end_slash("store_locator_url").alias("locator"))
    return pages.join(sources, "site").filter(without_end_slash("url").startswith(F.col("locator"))).select("raw_page_id", "source_id")


@query("f19_run_summary", """SELECT run_id, count(*) AS processed_sources, CAST(sum(products) AS BIGINT) AS products_written, CAST(sum(offers) AS BIGINT) AS offers_written, count(*) FILTER (outcome = 'failed') AS failed_sources,
    count(*) FILTER (outcome = 'blocked') AS blocked_sources, CASE WHEN bool_and(outcome = 'failed') THEN 'failed' WHEN bool_and(outcome = 'blocked') THEN 'blocked' WHEN bool_or(outcome IN ('failed', 'blocked')) THEN 'partial' ELSE 'completed' END AS status
    FROM run_results GROUP BY run_id""")
def _(t):
    return O.run_summary(t.run_results)


# --- windows and orders ---------------------------------------------------------------------

_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {table}) WHERE rn <= {n}"


@query("h1_latest_per_key", f"SELECT pipeline_id, run_id, status FROM ({_NEWEST.format(key='pipeline_id', order='created_at DESC, run_id DESC', table='runs', n=1)})")
def _(t):
    return M.latest_by(t.runs.select("pipeline_id", "run_id", "status", "created_at"), ["pipeline_id"], ["created_at", "run_id"]).select("pipeline_id", "run_id", "status")


@query("h2_newest_per_domain", f"SELECT raw_page_id, domain FROM ({_NEWEST.format(key='domain', order='captured_at DESC, raw_page_id', table='shop_pages', n=10)})")
def _(t):
    return M.top_per_group(t.shop_pages, ["domain"], [F.desc("captured_at"), F.col("raw_page_id")], 10).select("raw_page_id", "domain")


@query("h4_top_k", "SELECT candidate_id, score FROM candidates ORDER BY score DESC, candidate_id LIMIT 200")
def _(t):
    return t.candidates.select("candidate_id", "score").orderBy(F.desc("score"), "candidate_id").limit(200)


@query("h9_duplicate_rows", "SELECT doc_id, row_number() OVER (PARTITION BY source, lang, n_chars ORDER BY doc_id) > 1 AS repeated FROM documents")
def _(t):
    return M.first_seen(t.documents.select("doc_id", "source", "lang", "n_chars"), ["source", "lang", "n_chars"], "doc_id").select("doc_id", (~F.col("is_first")).alias("repeated"))


def _prompts(t):
    return t.conversations.select(F.concat("role", F.lit("-"), (F.col("conv_id") % 50).cast("string")).alias("key"), F.col("turn").cast("int").alias("version"), F.col("text").alias("content"), "conv_id")


@query("h10_next_version", "SELECT key, max(version) + 1 AS version FROM (SELECT role || '-' || CAST(conv_id % 50 AS VARCHAR) AS key, CAST(turn AS INTEGER) AS version FROM conversations) GROUP BY key")
def _(t):
    from ..operators.lifecycle import next_versions
    prompts = _prompts(t)
    new = prompts.groupBy("key").agg(F.min("content").alias("content")).withColumn("position", F.lit(0))
    return next_versions(prompts, new).select("key", "version")


@query("h10_latest_prompt", "SELECT key, max(version) AS version FROM (SELECT role || '-' || CAST(conv_id % 50 AS VARCHAR) AS key, CAST(turn AS INTEGER) AS version FROM conversations) GROUP BY key")
def _(t):
    from ..operators.lifecycle import latest_prompts
    return latest_prompts(_prompts(t)).select("key", "version")


@query("n4_ordered_distinct", "SELECT o_custkey, string_agg(p, ',' ORDER BY f) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def _(t):
    firsts = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.min("o_orderkey").alias("f"))
    return firsts.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "p"))), lambda x: x["p"]), ",").alias("priorities"))
