"""Engine tables derived from the driver's tables.

Each definition is one SQL text that Spark and an ANSI engine read alike, so that a query and its
check start from the same rows. ``@hours(n)`` stands for a fixed start time plus n hours.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
START = "2024-01-01 00:00:00"
#: Tables of short rows whose products and pages cost far more than the scan.
SPREAD = {"part": ["p_partkey"]}

DERIVED = {
    # Products: one listing per part, spread over shops, with a name a shop would write.
    "products": """
        SELECT product_id, pk, product_name, product_name AS canonical_name, brand, domain, source_id,
               CASE WHEN pk % 3 = 0 THEN '' ELSE p_type END AS category,
               CASE WHEN pk % 3 = 0 THEN '' ELSE p_type END AS normalized_category,
               'https://' || domain || '/san-pham/' || replace(p_name, ' ', '-') || '-sp' || CAST(pk AS STRING) || '.html' AS product_url,
               CASE WHEN pk % 23 = 0 THEN 'Liên hệ'
                    ELSE CAST(CAST(floor(cents / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 1000 AS STRING), 3, '0') || ' đ' END AS price_text,
               CASE WHEN pk % 23 = 0 THEN NULL ELSE CAST(cents AS DOUBLE) END AS price_numeric,
               CASE WHEN pk % 4 = 1 THEN CAST(cents + 5000 AS DOUBLE) WHEN pk % 4 = 2 THEN CAST(cents - 5000 AS DOUBLE) ELSE NULL END AS old_price,
               'VND' AS currency,
               CASE WHEN pk % 6 = 0 THEN '' ELSE 'Shop ' || CAST(pk % 100 AS STRING) END AS store_name,
               'https://' || domain || '/' AS store_url,
               CASE WHEN pk % 4 = 0 THEN CAST(pk % 50 AS STRING) || ' phố Huế, Hà Nội' ELSE NULL END AS store_address,
               CASE WHEN pk % 3 = 1 THEN 'online' ELSE NULL END AS store_channel,
               '0901' || lpad(CAST(pk % 1000000 AS STRING), 6, '0') AS store_phone,
               CAST(pk AS STRING) AS raw_page_id, @hours(pk % 5000) AS updated_at, @hours(0) AS created_at
        FROM (SELECT 'p' || CAST(p_partkey AS STRING) AS product_id, p_partkey AS pk, p_name, p_brand AS brand, p_type,
                     CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
                     's' || CAST(p_partkey % 100 AS STRING) AS source_id,
                     CASE WHEN p_partkey % 2 = 0 THEN 'www.' ELSE '' END || 'shop' || CAST(p_partkey % 100 AS STRING) || '.vn' AS domain,
                     CASE p_type WHEN 'ECONOMY' THEN 'Bia lon' WHEN 'LARGE' THEN 'Rượu vang đỏ' WHEN 'MEDIUM' THEN 'Vodka'
                                 WHEN 'PROMO' THEN 'Sữa tươi' WHEN 'SMALL' THEN 'Thuốc lá' ELSE 'Hàng' END
                     || ' ' || p_brand || ' ' || p_name || ' ' || CAST((p_size % 8 + 1) * 125 AS STRING) || 'ml'
                     || CASE p_partkey % 5 WHEN 0 THEN ' 14,5%' WHEN 1 THEN ' 40%' WHEN 2 THEN ' 12 độ' ELSE '' END
                     || CASE p_partkey % 7 WHEN 0 THEN ' thùng 24' WHEN 1 THEN ' hộp quà' WHEN 2 THEN ' 6 lon' ELSE '' END AS product_name
              FROM part) AS shaped""",
    # Price observations and offers: one per order line.
    "observations": """
        SELECT 'b' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS observation_id,
               'p' || CAST(l_partkey AS STRING) AS product_id, 's' || CAST(l_suppkey AS STRING) AS source_id,
               'shop' || CAST(l_suppkey % 100 AS STRING) || '.vn' AS domain, 'shop' || CAST(l_suppkey % 100 AS STRING) || '.vn' AS source,
               CASE WHEN l_linenumber = 7 THEN 0.0 ELSE CAST(floor(l_extendedprice / l_quantity * 100) AS DOUBLE) END AS price_numeric,
               CASE WHEN l_tax > 0.07 THEN NULL ELSE 'VND' END AS currency, l_shipdate AS observed_at
        FROM lineitem""",
    "offers": """
        SELECT 'o' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS offer_id, 'p' || CAST(l_partkey AS STRING) AS product_id,
               's' || CAST(l_suppkey % 100 AS STRING) AS source_id, 'shop' || CAST(l_suppkey % 100 AS STRING) || '.vn' AS domain,
               CASE WHEN l_linenumber = 7 THEN 0.0 ELSE CAST(floor(l_extendedprice / l_quantity * 100) AS DOUBLE) END AS price_numeric,
               'Shop ' || CAST(l_suppkey AS STRING) AS store_name, CAST(NULL AS STRING) AS store_url, CAST(NULL AS STRING) AS store_address,
               CAST(NULL AS STRING) AS store_phone, l_shipdate AS updated_at, l_orderkey AS orderkey, l_linenumber AS linenumber
        FROM lineitem""",
    # Source registry: suppliers with the name of their region as category text.
    "sources": """
        SELECT 's' || CAST(s_suppkey AS STRING) AS source_id, s_suppkey AS sk, s_name AS name, domain, 'https://' || domain || '/' AS url,
               'https://' || domain || '/' AS base_url, CASE WHEN s_suppkey % 3 = 0 THEN 'E-commerce' ELSE 'Brand Site' END AS type,
               CASE WHEN r_name = 'ASIA' THEN 'Rượu bia' WHEN r_name = 'EUROPE' THEN 'Vang nhập' WHEN r_name = 'AFRICA' THEN 'Xì gà'
                    WHEN r_name = 'AMERICA' THEN 'Sữa' ELSE r_name END AS category,
               n_name AS note, CASE WHEN s_suppkey % 5 = 0 THEN 'branch' WHEN s_suppkey % 5 = 1 THEN 'site' ELSE NULL END AS store_scope,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Kho ' || s_name END AS store_name, CAST(NULL AS STRING) AS store_url,
               CASE WHEN s_suppkey % 7 = 0 THEN n_name || ', Hà Nội' ELSE NULL END AS store_address, CAST(NULL AS STRING) AS store_phone,
               CASE WHEN s_suppkey % 3 = 1 THEN 'online' ELSE NULL END AS store_channel,
               CASE WHEN s_suppkey % 2 = 0 THEN 'https://' || domain || '/p' ELSE NULL END AS store_locator_url,
               CASE WHEN s_suppkey % 6 = 0 THEN false ELSE NULL END AS auto_promote_rules,
               CASE WHEN s_suppkey % 8 = 0 THEN false ELSE NULL END AS quality_gate_enabled,
               s_acctbal > 5000 AS important, s_acctbal > 0 AS enabled, @hours(s_suppkey) AS updated_at
        FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'www.' ELSE '' END || 'shop' || CAST(s_suppkey AS STRING) || '.vn' AS domain FROM supplier) AS s
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # Stored pages with capture facts.
    "raw_pages": """
        SELECT CAST(page_id AS STRING) AS raw_page_id, page_id AS pk, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS domain,
               CASE page_id % 6 WHEN 0 THEN 'listing' WHEN 1 THEN 'product_detail' WHEN 2 THEN 'store_listing' WHEN 3 THEN 'entry' ELSE 'unknown' END AS page_type,
               CASE WHEN page_id % 4 = 0 THEN NULL ELSE 't' || CAST(page_id AS STRING) END AS task_id, @hours(page_id % 900) AS captured_at,
               CASE WHEN page_id % 3 = 0 THEN 'html' ELSE NULL END AS content_type, CAST(length(html) AS BIGINT) AS content_length,
               CASE page_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'completed' ELSE 'failed' END AS status, html
        FROM pages""",
    # Pages of the shops: their paths decide the class.
    "shop_pages": """
        SELECT CAST(pk AS STRING) AS raw_page_id, pk, domain, @hours(pk % 700) AS captured_at, status, task_id,
               'https://' || domain || CASE pk % 11 WHEN 0 THEN '/danh-muc/vang' WHEN 1 THEN '/product/x' || CAST(pk AS STRING) WHEN 2 THEN '/stores/hn'
                    WHEN 3 THEN '/a/b/c' || CAST(pk AS STRING) || '.html' WHEN 4 THEN '/san-pham/vang' WHEN 5 THEN '/listcategory?x=1' WHEN 6 THEN '/p' || CAST(pk AS STRING) || '.html'
                    WHEN 7 THEN '/search?q=bia' WHEN 8 THEN '/' WHEN 9 THEN '/Products/' ELSE '/tin-tuc/' || CAST(pk AS STRING) END AS url,
               CASE pk % 7 WHEN 0 THEN 'Listing' WHEN 1 THEN 'product_detail' WHEN 2 THEN 'store_detail' WHEN 3 THEN 'entry' ELSE NULL END AS page_type
        FROM (SELECT o_orderkey AS pk, CASE WHEN o_custkey % 2 = 0 THEN 'www.' ELSE '' END || 'shop' || CAST(o_custkey % 300 AS STRING) || '.vn' AS domain,
                     CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' ELSE 'done' END AS status, CAST(NULL AS STRING) AS task_id FROM orders) AS o""",
    # Pipelines and their runs.
    "pipelines": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS pipeline_id, c_custkey AS ck, c_name AS name, c_acctbal > 0 AS enabled,
               '{"mode":"' || CASE WHEN c_custkey % 3 = 0 THEN 'crawler' ELSE 'hybrid' END || '","description":"' || lower(c_mktsegment) || '","source_ids":["s'
               || CAST(c_custkey % 10 AS STRING) || '","s' || CAST(c_custkey % 7 AS STRING) || '"],"entry_urls":["https://shop' || CAST(c_custkey % 100 AS STRING) || '.vn/"]'
               || CASE WHEN c_custkey % 4 = 0 THEN ',"page_budget":20' ELSE '' END || '}' AS data, @hours(c_custkey) AS updated_at
        FROM customer""",
    "runs": """
        SELECT 'r' || CAST(o_orderkey AS STRING) AS run_id, o_orderkey AS ok, 'c' || CAST(o_custkey AS STRING) AS pipeline_id,
               CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'completed' WHEN o_orderkey % 3 = 0 THEN 'running'
                    WHEN o_orderkey % 3 = 1 THEN 'blocked' ELSE 'partial' END AS status, o_orderpriority AS kind, o_orderdate AS created_at
        FROM orders""",
    # Outcome of each source within a run: one per order line.
    "run_results": """
        SELECT 'r' || CAST(l_orderkey AS STRING) AS run_id, 's' || CAST(l_suppkey AS STRING) AS source_id,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'blocked' ELSE 'completed' END AS outcome,
               CAST(l_quantity AS BIGINT) AS products, CAST(l_linenumber AS BIGINT) AS offers, l_shipdate AS finished_at
        FROM lineitem""",
    # Metrics of each source and day, from the day's order lines.
    "source_days": """
        SELECT 's' || CAST(l_suppkey AS STRING) AS source_id, l_shipdate AS day, CAST(count(*) AS BIGINT) AS valid_products,
               round(avg(CASE WHEN l_discount < 0.06 THEN 1 ELSE 0 END), 3) AS required_coverage,
               round(avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END), 3) AS brand_coverage,
               round(avg(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END), 3) AS duplicate_ratio, max(CAST(floor(l_extendedprice) AS DOUBLE)) AS median_price,
               max(l_tax) > 0.07 AS quarantined
        FROM lineitem GROUP BY l_suppkey, l_shipdate""",
    # Rule candidates and generation attempts, one stream of them per domain.
    "candidates": """
        SELECT 'd' || CAST(o_custkey AS STRING) || '.vn' AS domain, 'h' || CAST(o_orderkey % 50 AS STRING) AS content_hash, 'v' || CAST(o_orderkey AS STRING) AS version,
               CASE WHEN o_orderkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, CASE o_orderstatus WHEN 'F' THEN 'rejected' ELSE 'validated' END AS status,
               o_orderstatus <> 'F' AS accepted, floor(o_totalprice / 5000) / 100 AS score, o_orderdate AS updated_at,
               'd' || CAST(o_custkey AS STRING) || '.vn:h' || CAST(o_orderkey % 50 AS STRING) || ':v' || CAST(o_orderkey AS STRING) AS candidate_id,
               'rule ' || CAST(o_orderkey AS STRING) AS structure, CASE WHEN o_orderkey % 5 = 0 THEN 'w' || CAST(o_custkey AS STRING) ELSE NULL END AS expected_version
        FROM orders""",
    "active_rules": """
        SELECT 'd' || CAST(c_custkey AS STRING) || '.vn' AS domain, 'rule of ' || c_name AS structure,
               CASE WHEN c_custkey % 2 = 0 THEN 'w' ELSE 'x' END || CAST(c_custkey AS STRING) AS version, floor(c_acctbal / 100) / 100 AS score, 'a' || CAST(c_custkey AS STRING) AS candidate_id
        FROM customer WHERE c_custkey % 3 <> 0""",
    "attempts": """
        SELECT 'd' || CAST(o_custkey AS STRING) || '.vn' AS domain, 'h' || CAST(l_partkey % 50 AS STRING) AS content_hash, o_orderdate AS attempted_at,
               CASE WHEN l_linenumber % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'done' END AS status,
               CASE l_linestatus WHEN 'F' THEN 'HTTP 429 quota' WHEN 'O' THEN '503 unavailable' ELSE 'timeout' END AS error
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # Rows as a model would invent them, in batches of ten.
    "synthetic": """
        SELECT 'b' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING) AS batch_id, CAST(p_partkey % 10 + 1 AS INT) AS position, 's' || CAST(p_partkey % 100 AS STRING) AS source_id,
               CASE WHEN p_partkey % 37 = 0 THEN 'product' ELSE p_name END AS name, CASE WHEN p_partkey % 41 = 0 THEN '' ELSE p_type END AS category,
               CASE WHEN p_partkey % 43 = 0 THEN '0' ELSE CAST(CAST(round(p_retailprice) AS BIGINT) AS STRING) END AS price,
               CASE WHEN p_partkey % 29 = 0 THEN '2,5' WHEN p_partkey % 31 = 0 THEN 'tốt' WHEN p_partkey % 2 = 0 THEN '4.5' ELSE '' END AS rating,
               CASE WHEN p_partkey % 47 = 0 THEN 'not a url' ELSE 'https://a.vn/' || CAST(p_partkey AS STRING) END AS url, '' AS source,
               'Kho ' || CAST(p_size % 2 AS STRING) AS store_name, @hours(p_partkey) AS updated_at,
               CASE WHEN p_partkey % 3 = 0 THEN @hours(p_partkey + 5) ELSE NULL END AS reviewed_at,
               CASE p_size % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'approved' ELSE 'rejected' END AS review_status, p_size AS size
        FROM part""",
}
_WORD = re.compile(r"\b(" + "|".join(DERIVED) + r")\b")


def _hours(sql: str, spark: bool) -> str:
    form = rf"timestampadd(HOUR, CAST(\1 AS INT), TIMESTAMP '{START}')" if spark else rf"(TIMESTAMP '{START}' + to_hours(CAST(\1 AS INT)))"
    return re.sub(r"@hours\(([^()]*)\)", form, sql)


def with_tables(sql: str) -> str:
    """An ANSI query with the derived tables it names put in front as common table expressions."""
    names, queue = [], [sql]
    while queue:
        for name in _WORD.findall(queue.pop()):
            if name not in names:
                names.append(name)
                queue.append(DERIVED[name])
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({_hours(DERIVED[n], spark=False)})" for n in reversed(names))
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {sql.lstrip()[4:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"


class Tables:
    """Base and derived tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(rows, *SPREAD[name]) if name in SPREAD else rows
        sql = _hours(DERIVED[name], spark=True)
        used = {w for w in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if w in BASE or w in DERIVED}
        braced = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
        braced = braced.replace('{"', "\x01").replace("}'", "\x02")
        braced = braced.replace("\x01", '{{"').replace("\x02", "}}'")
        return self.spark.sql(braced, **{w: getattr(self, w) for w in used})
