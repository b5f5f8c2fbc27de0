"""Queries over stored pages and over shop pages that Spark derives from the product table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.classify import page_class
from ..functions.urls import without_www
from ..operators import extraction as E
from ..operators import pages as P
from ..operators import payloads as D
from ..operators import quality as Q
from ..session import spread
from ..sources import files as S
from ..streaming.run import work_folder
from . import ansi as A
from .registry import query


def _when(text):
    return F.lit(text).cast("timestamp")


# --- text and previews ----------------------------------------------------------------------

def _inner(tag):
    return A.clean(A.unescape(f"regexp_replace(regexp_extract({A.body('html')}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '<[^>]*>', ' ', 'g')"))


@query("c19_page_text", f"""SELECT raw_page_id, md5({A.text_of('html')}) AS digest, {_inner('title')} AS title, {_inner('h1')} AS h1,
    CAST(len(regexp_extract_all({A.body('html')}, '(?i)<a\\b')) AS INTEGER) AS link_count, CAST(len(regexp_extract_all({A.body('html')}, '(?i)<p\\b')) AS INTEGER) AS paragraph_count FROM raw_pages""")
def _(t):
    return P.page_facts(t.raw_pages).select("raw_page_id", F.md5(F.col("text").cast("binary")).alias("digest"), "title", "h1", "link_count", "paragraph_count")


@query("a21_page_preview", f"SELECT raw_page_id, md5(substr(html, 1, 4000)) AS excerpt, substr({A.text_of('html')}, 1, 1200) AS text_preview, CAST(length(html) AS INTEGER) AS content_length FROM raw_pages")
def _(t):
    return P.page_preview(t.raw_pages).select("raw_page_id", F.md5(F.col("html_excerpt").cast("binary")).alias("excerpt"), "text_preview", "content_length")


@query("c20_grounding_evidence", f"""SELECT raw_page_id, 'URL: ' || url || chr(10) || 'Nội dung: ' || x AS evidence FROM (SELECT *, substr({A.text_of('html')}, 1, 1800) AS x, row_number() OVER (PARTITION BY {A.bare('domain')} ORDER BY captured_at DESC, raw_page_id) AS rn FROM raw_pages) WHERE rn <= 3 AND x <> ''""")
def _(t):
    return P.grounding_evidence(t.raw_pages).select("raw_page_id", "evidence")


# --- links ----------------------------------------------------------------------------------

_HREFS = f"""(SELECT raw_page_id, url, unnest(regexp_extract_all({A.body('html')}, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1)) AS href FROM raw_pages)"""
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]*')"
_LINK = f"regexp_replace(regexp_replace(CASE WHEN starts_with(href, '/') THEN {_ORIGIN} || href ELSE href END, '#.*$', ''), '/+$', '')"
_LPATH = "lower(regexp_extract(link, '^https?://[^/?#]*([^?#;]*)', 1))"
_SCORE = f"(CASE WHEN {A.any_of(_LPATH, K.DISCOVERY_WORDS)} THEN 2 ELSE 0 END + CASE WHEN contains({_LPATH}, '/san-pham/') THEN 3 ELSE 0 END + CASE WHEN contains({_LPATH}, '/danh-muc/') OR contains({_LPATH}, '/category/') THEN 2 ELSE 0 END)"
_LINKS = f"""SELECT raw_page_id, link, {_SCORE} AS score FROM (SELECT DISTINCT raw_page_id, url, {_LINK} AS link FROM {_HREFS} WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)'))
    WHERE {A.authority('link')} = {A.authority('url')} AND NOT contains(string_split(regexp_extract(link, '^https?://[^/?#]*([^?#;]*)', 1), '/')[-1], '.')"""


@query("b10_links", _LINKS)
def _(t):
    return P.same_site_links(t.raw_pages).select("raw_page_id", "link", "score")


@query("b10_best_links")
def _(t):
    return P.same_site_links(t.raw_pages, 5).select("raw_page_id", "link", "score")


def _sitemaps(t):
    """Sitemaps of a bounded number of product pages, each with one nested index and one foreign entry."""
    loc = F.concat(F.lit("<url><loc> "), "product_url", F.lit(" </loc></url>"))
    files = t.products.groupBy("domain", F.floor(F.col("pk") / 1000).cast("string").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(loc)), "").alias("l"))
    return files.select(F.concat(F.lit("https://"), "domain", F.lit("/sitemap-p"), "k", F.lit(".xml")).alias("url"), F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://s.org/0.9">'), "l", F.lit("<url><loc>/sitemap-2.xml#x</loc></url><url><loc>https://other.vn/a</loc></url></urlset>")).alias("body"))


@query("b11_sitemap_urls", "SELECT product_url AS link, false AS is_index FROM products UNION ALL SELECT 'https://' || domain || '/sitemap-2.xml', true FROM (SELECT DISTINCT domain, floor(pk / 1000) FROM products)")
def _(t):
    return P.sitemap_urls(_sitemaps(t)).select("link", "is_index")


@query("b11_robots_sitemaps", "SELECT 'https://' || domain || '/sitemap-' || brand || '.xml' AS link FROM (SELECT DISTINCT domain, brand FROM products)")
def _(t):
    line = F.concat(F.lit("Sitemap: /sitemap-"), "brand", F.lit(".xml"))
    files = t.products.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("l"))
    return P.robots_sitemaps(files.select(F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nDisallow: /x\n"), "l").alias("body"))).select("link")


@query("b12_seed_urls", """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS flow, 'https://a' || CAST(c_custkey AS VARCHAR) || '.vn' AS url, 0 AS tier FROM customer UNION ALL
    SELECT 'c' || CAST(c_custkey AS VARCHAR), 'https://a' || CAST(c_custkey AS VARCHAR) || '.vn/search?q=' || lower(c_mktsegment) || '+x', 1 FROM customer UNION ALL
    SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR), 'https://a' || CAST(o_custkey AS VARCHAR) || '.vn/p' || CAST(o_orderkey % 5 AS VARCHAR), 2 FROM orders WHERE o_orderkey % 5 > 0""")
def _(t):
    key, site = (lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("pipeline_id")), (lambda c: F.concat(F.lit("https://a"), F.col(c).cast("string"), F.lit(".vn")))
    entries = t.customer.select(key("c_custkey"), F.lit(0).alias("position"), F.concat(F.lit(" "), site("c_custkey"), F.lit("/")).alias("url"))
    searches = t.customer.select(key("c_custkey"), F.lit(0).alias("position"), F.concat(F.lower("c_mktsegment"), F.lit(" x ")).alias("query"))
    five = F.col("o_orderkey") % 5
    found = t.orders.select(key("o_custkey"), five.cast("int").alias("position"), F.when(five == 0, site("o_custkey")).otherwise(F.concat(site("o_custkey"), F.lit("/p"), five.cast("string"), F.lit("/"))).alias("url"))
    return P.seed_urls(entries, searches, found).select(F.col("pipeline_id").alias("flow"), "url", "tier")


@query("b13_frontier", """WITH links AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS u, 'p' || CAST(l_partkey AS VARCHAR) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem),
    d0 AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS root, 'c' || CAST(c_custkey AS VARCHAR) AS url, 0 AS depth FROM customer),
    d1 AS (SELECT DISTINCT root, v AS url, 1 AS depth FROM d0 JOIN links ON url = u), d2 AS (SELECT DISTINCT root, v AS url, 2 AS depth FROM d1 JOIN links ON url = u)
    SELECT root, url, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY 1, 2""")
def _(t):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    links = lines.select(tag("c", "o_custkey").alias("url"), tag("p", "l_partkey").alias("link")).union(t.lineitem.select(tag("p", "l_partkey"), tag("s", "l_suppkey"))).distinct().withColumn("score", F.lit(0))
    seeds = t.customer.select(tag("n", "c_nationkey").alias("root"), tag("c", "c_custkey").alias("url"))
    return P.expand_frontier(seeds, links, 2).select("root", "url", "depth")


@query("b14_recrawl", """WITH u AS (SELECT DISTINCT url FROM shop_pages), r AS (SELECT url, max(struct_pack(captured_at := captured_at, raw_page_id := raw_page_id)) AS p FROM shop_pages WHERE captured_at >= TIMESTAMP '2024-01-25' - INTERVAL 24 HOUR GROUP BY url)
    SELECT u.url, coalesce(r.p.raw_page_id, 'fetch') AS page FROM u LEFT JOIN r ON u.url = r.url""")
def _(t):
    fetch, reuse = P.recently_captured(t.shop_pages.select("url").distinct(), t.shop_pages, _when("2024-01-25"))
    return fetch.select("url", F.lit("fetch").alias("page")).unionByName(reuse.select("url", F.col("raw_page_id").alias("page")))


@query("b15_truncation", "SELECT page_id, strlen(html) > 3000 AS truncated FROM pages")
def _(t):
    cut = P.truncate_payload(t.pages.select("page_id", F.col("html").cast("binary").alias("content")), 3000)
    return cut.filter(F.octet_length("content") <= 3000).select("page_id", "truncated")


_CLASS = A.page_class("page_type", "url")


@query("b16_source_discovery", f"""SELECT s.source_id, p.raw_page_id, true AS has_rule FROM sources s JOIN (SELECT *, row_number() OVER (PARTITION BY {A.bare('domain')} ORDER BY captured_at DESC, raw_page_id) AS rn FROM shop_pages) p ON {A.bare('s.domain')} = {A.bare('p.domain')} WHERE rn <= 300""")
def _(t):
    rules = t.sources.select("domain", F.lit("v1").alias("version"))
    return P.discover_source_pages(t.sources, t.shop_pages, rules).select("source_id", "raw_page_id", "has_rule")


@query("b17_run_pages", f"""WITH here AS (SELECT *, {A.bare('domain')} AS site FROM shop_pages WHERE pk % 10 = 0), w AS (SELECT {A.bare('domain')} AS site, store_locator_url AS loc FROM sources WHERE store_locator_url IS NOT NULL
      AND {A.bare('domain')} NOT IN (SELECT site FROM here WHERE {_CLASS} = 'store_listing')),
    x AS (SELECT raw_page_id, row_number() OVER (PARTITION BY w.site ORDER BY captured_at DESC, raw_page_id) AS rn FROM shop_pages p JOIN w ON {A.bare('p.domain')} = w.site AND starts_with(regexp_replace(url, '/+$', ''), regexp_replace(loc, '/+$', '')) WHERE pk % 10 <> 0)
    SELECT raw_page_id FROM here UNION ALL SELECT raw_page_id FROM x WHERE rn <= 6""")
def _(t):
    return P.pages_of_run(t.shop_pages, t.shop_pages.filter("pk % 10 = 0"), t.sources).select("raw_page_id")


_SIGNALS = f"""SELECT domain, bool_or(class IN ('product_detail', 'listing')) AS has_products, bool_or(class = 'listing' OR links >= 20) AS has_lists, bool_or(class = 'store_listing' OR regexp_matches(x, '{K.PHONE_PATTERN}')) AS has_stores, bool_or(paras >= 3 AND links >= 3) AS has_structure
    FROM (SELECT domain, {_CLASS} AS class, {A.text_of('html')} AS x, len(regexp_extract_all({A.body('html')}, '(?i)<a\\b')) AS links, len(regexp_extract_all({A.body('html')}, '(?i)<p\\b')) AS paras FROM raw_pages) GROUP BY domain"""


@query("b18_site_acceptance", f"SELECT *, has_products::INT + has_lists::INT + has_stores::INT + has_structure::INT AS signals, has_products::INT + has_lists::INT + has_stores::INT + has_structure::INT >= 2 AS accepted FROM ({_SIGNALS})")
def _(t):
    return P.site_signals(P.page_facts(t.raw_pages).withColumn("class", page_class("page_type", "url")))


_PRIO = f"CASE {_CLASS} WHEN 'product_detail' THEN 1 WHEN 'listing' THEN 2 WHEN 'store_listing' THEN 3 ELSE 5 END"


@query("b18_page_priority", f"SELECT domain, raw_page_id FROM (SELECT domain, raw_page_id, row_number() OVER (PARTITION BY domain ORDER BY {_PRIO}, captured_at DESC, raw_page_id) AS rn FROM shop_pages) WHERE rn <= 3")
def _(t):
    from ..operators.common import top_per_group
    order = [P.page_priority(page_class("page_type", "url")), F.desc("captured_at"), F.col("raw_page_id")]
    return top_per_group(t.shop_pages, ["domain"], order, 3).select("domain", "raw_page_id")


@query("h8_writer_pages", f"""WITH c AS (SELECT raw_page_id, domain, captured_at, {_CLASS} AS class FROM shop_pages), f AS (SELECT *, class = 'listing' AS fits FROM c), b AS (SELECT *, bool_or(fits) OVER (PARTITION BY domain) AS any_fit FROM f),
    k AS (SELECT *, CASE WHEN class <> 'unknown' THEN 0 ELSE 1 END AS tier FROM b WHERE fits OR NOT any_fit), l AS (SELECT *, min(tier) OVER (PARTITION BY domain) AS low FROM k)
    SELECT raw_page_id, class FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY captured_at DESC, raw_page_id) AS rn FROM l WHERE tier = low) WHERE rn <= 6""")
def _(t):
    pages = t.shop_pages.withColumns({"source_id": F.col("domain"), "targets": F.array(F.lit("listing"))})
    return P.writer_pages(pages).select("raw_page_id", "class")


# --- selector previews ----------------------------------------------------------------------

_FIELDS = [("listing", "product_name", "nav li a", True), ("listing", "price", ".ad", True), ("product_detail", "product_name", "article h1", True), ("product_detail", "brand", ".none", False), ("product_detail", "price", "nav a[href]", True)]


def _previews(t):
    fields = F.array(*[F.struct(F.lit(a).alias("target"), F.lit(n).alias("name"), F.lit(s).alias("selector"), F.lit(None).cast("string").alias("attr"), F.lit(r).alias("required")) for a, n, s, r in _FIELDS])
    rules = t.raw_pages.select("domain").distinct().withColumn("domain", without_www("domain")).distinct().withColumn("fields", fields)
    return P.selector_previews(t.raw_pages, rules)


_NAV = f"len(regexp_extract_all(regexp_extract({A.body('html')}, '(?is)<nav>(.*?)</nav>', 1), '<a '))"
_AD = f"len(regexp_extract_all({A.body('html')}, '<div class=.ad.>'))"
_H1 = f"len(regexp_extract_all(regexp_extract({A.body('html')}, '(?is)<article>(.*)</article>', 1), '<h1>'))"
_PREVIEW = " UNION ALL ".join(f"SELECT raw_page_id, '{a}' AS target, '{n}' AS name, CAST({e} AS INTEGER) AS matches, {str(r).lower()} AS required FROM raw_pages" for (a, n, s, r), e in zip(_FIELDS, (_NAV, _AD, _H1, "0", _NAV)))


@query("c14_selector_preview", f"SELECT raw_page_id, target, name, matches FROM ({_PREVIEW})")
def _(t):
    return _previews(t).select("raw_page_id", "target", "name", "matches")


@query("c15_draft_validation", f"""SELECT raw_page_id, target, bool_and(matches > 0) FILTER (required) AS required_pass, round(avg(CASE WHEN matches > 0 THEN 1.0 ELSE 0.0 END), 2) AS field_score,
    CASE target WHEN 'listing' THEN concat_ws(',', 'brand', CASE WHEN NOT bool_or(name = 'price' AND matches > 0) THEN 'price' END, CASE WHEN NOT bool_or(name = 'product_name' AND matches > 0) THEN 'product_name' END, 'product_url')
      ELSE concat_ws(',', 'brand', CASE WHEN NOT bool_or(name = 'price' AND matches > 0) THEN 'price' END, CASE WHEN NOT bool_or(name = 'product_name' AND matches > 0) THEN 'product_name' END, 'product_url') END AS missing FROM ({_PREVIEW}) GROUP BY 1, 2""")
def _(t):
    return Q.draft_results(_previews(t)).select("raw_page_id", "target", "required_pass", F.col("field_score").cast("double").alias("field_score"), F.array_join("missing_recommended", ",").alias("missing"))


_LACKS = """concat_ws(', ', 'brand', CASE WHEN NOT coalesce(bool_or(name = 'price' AND matches > 0), false) THEN 'price' END, CASE WHEN NOT coalesce(bool_or(name = 'product_name' AND matches > 0), false) THEN 'product_name' END, 'product_url')"""


@query("c15_draft_verdicts", f"""WITH per AS (SELECT raw_page_id, target, coalesce(bool_and(matches > 0) FILTER (required), false) AS ok, target || ': missing ' || {_LACKS} AS warning FROM ({_PREVIEW}) GROUP BY 1, 2)
    SELECT raw_page_id, bool_or(ok) AS accepted, count(*) FILTER (ok) AS accepted_targets, string_agg(warning, '; ' ORDER BY target) AS warnings FROM per GROUP BY 1""")
def _(t):
    verdicts = Q.draft_verdicts(Q.draft_results(_previews(t)))
    return verdicts.select("raw_page_id", "accepted", "accepted_targets", F.array_join("warnings", "; ").alias("warnings"))


@query("c16_evidence_excerpt")
def _(t):
    return P.evidence_excerpt(_detail_pages(t).select("raw_page_id", "html"))


# --- shop pages with products ---------------------------------------------------------------

def _detail_pages(t):
    """A product page per product: heading, prices, stock, a labelled brand and the shop's JSON-LD."""
    c = F.col
    jsonld = F.concat(F.lit('{"@graph":[{"@type":"Organization","name":"'), c("store_name"), F.lit('","address":{"streetAddress":"1 phố Huế","addressLocality":"Hà Nội"},"telephone":"'), c("store_phone"), F.lit('"}]}'))
    html = F.concat(
        F.lit("<html><head><title>"), c("product_name"), F.lit(" | Cửa hàng</title><meta property='og:site_name' content='Chuỗi "), c("store_name"),
        F.lit("'><script type='application/ld+json'>"), jsonld, F.lit("</script></head><body><nav><a href='/'>Trang chủ</a></nav><h1>"), c("product_name"),
        F.lit("</h1><div class='box'><span class='price'>"), c("price_text"), F.lit("</span><del class='old'>"), F.coalesce(c("old_price").cast("long").cast("string"), F.lit("")),
        F.lit("</del></div><table><tr><th>Thương hiệu</th><td> "), c("brand"), F.lit(" </td></tr></table><img data-src='/img/"), c("raw_page_id"), F.lit(".jpg'><footer>2024</footer></body></html>"))
    return t.products.select("raw_page_id", "domain", F.col("product_url").alias("url"), F.lit("product_detail").alias("page_type"), html.alias("html"))


def _listing_pages(t):
    """Listing pages of up to ten products each, per shop."""
    link = F.regexp_replace("product_url", "^https://[^/]+", "")
    item = F.concat(F.lit('<div class="product-item"><h3><a href="'), link, F.lit('">'), F.col("product_name"), F.lit('</a></h3><p class="price">'), F.col("price_text"), F.lit("</p></div>"))
    pages = spread(t.products.withColumn("k", F.floor(F.col("pk") / 1000)), "domain", "k").groupBy("domain", "k").agg(F.array_sort(F.collect_list(F.struct("pk", item.alias("i")))).alias("l"))
    return pages.select(F.concat("domain", F.lit("#"), F.col("k").cast("string")).alias("raw_page_id"), "domain", F.concat(F.lit("https://"), "domain", F.lit("/danh-muc/tat-ca?page="), F.col("k").cast("string")).alias("url"),
                        F.lit("unknown").alias("page_type"), F.concat(F.lit("<html><body><ul class=menu><li>x<li>y</ul>"), F.array_join(F.transform("l", lambda x: x["i"]), ""), F.lit("</body></html>")).alias("html"))


def _shop_rules(t):
    """One rule per bare shop domain, with a listing and a detail section."""
    def field(name, selector, attr=None, transform=None):
        return F.struct(F.lit(name).alias("name"), F.lit(selector).alias("selector"), F.lit(attr).cast("string").alias("attr"), F.lit(True).alias("required"), F.lit(transform).cast("string").alias("transform"))

    def section(item, *fields):
        return F.struct(F.lit(item).cast("string").alias("item_selector"), F.array(*fields).alias("fields"))

    listing = section(".product-item", field("product_name", "h3 a"), field("product_url", "h3 > a", "href"), field("price", "p[class='price'], .sale-price", None, "clean_price"))
    detail = section(None, field("product_name", "h1"), field("price", ".box .price", None, "clean_price"), field("old_price", "del.old"), field("abv", "h1", None, "extract_percentage"), field("volume_ml", "h1", None, "extract_volume_ml"), field("image_url", "img", "data-src"))
    structure = F.struct(listing.alias("listing"), detail.alias("product_detail"), F.lit(None).cast(E.SECTION).alias("stores"))
    return t.products.select(without_www("domain").alias("domain")).distinct().select("domain", structure.alias("structure"), F.lit("v1").alias("version"))


def _read(t, pages, generic=False, facts=True):
    return E.read_pages(pages, _shop_rules(t), generic=generic, facts=facts)


_DIGITS = "CASE WHEN price_numeric IS NULL THEN NULL ELSE CAST(CAST(price_numeric AS BIGINT) AS VARCHAR) END"


@query("c2_listing_rows", f"SELECT domain || '#' || CAST(CAST(floor(pk / 1000) AS BIGINT) AS VARCHAR) AS raw_page_id, row_number() OVER (PARTITION BY domain, floor(pk / 1000) ORDER BY pk) - 1 AS row_no, product_name, product_url, {_DIGITS} AS price FROM products")
def _(t):
    rows = _read(t, _listing_pages(t)).select("raw_page_id", F.explode(E.finished_rows(F.col("listing"))).alias("r"))
    get = lambda n: F.try_element_at(F.col("r")["record"], F.lit(n)).alias(n)
    return rows.select("raw_page_id", F.col("r")["row_no"].cast("long").alias("row_no"), get("product_name"), get("product_url"), get("price"))


@query("c1_field_transforms", f"""SELECT raw_page_id, {_DIGITS} AS price, CASE WHEN old_price IS NOT NULL THEN CAST(CAST(old_price AS BIGINT) AS VARCHAR) END AS old_price, replace(nullif(regexp_extract(product_name, '\\d+(?:[.,]\\d+)?\\s*%'), ''), ',', '.') AS abv,
    CAST({A.volume('product_name')} AS VARCHAR) AS volume_ml, 'https://' || domain || '/img/' || raw_page_id || '.jpg' AS image_url FROM products""")
def _(t):
    rows = _read(t, _detail_pages(t)).select("raw_page_id", F.explode(E.finished_rows(F.col("product_detail"))).alias("r"))
    return rows.select("raw_page_id", *[F.try_element_at(F.col("r")["record"], F.lit(n)).alias(n) for n in ("price", "old_price", "abv", "volume_ml", "image_url")])


@query("o1_named_transforms", f"SELECT raw_page_id, coalesce({_DIGITS}, '') || '|' || coalesce(replace(nullif(regexp_extract(product_name, '\\d+(?:[.,]\\d+)?\\s*%'), ''), ',', '.'), '') || '|' || CAST({A.volume('product_name')} AS VARCHAR) AS v FROM products")
def _(t):
    make = lambda n, c: F.coalesce(E.TRANSFORMS[n](F.col(c)), F.lit(""))
    return t.products.select("raw_page_id", F.concat_ws("|", make("clean_price", "price_text"), make("extract_percentage", "product_name"), make("extract_volume_ml", "product_name")).alias("v"))


@query("c3_generic_rows", f"SELECT raw_page_id, product_name, {_DIGITS} AS price FROM products")
def _(t):
    none = _shop_rules(t).filter("domain = 'no such shop'")
    chosen = E.choose_rows(E.read_pages(_detail_pages(t), none, generic=True))
    row = F.get("product_rows", 0)["record"]
    return chosen.select("raw_page_id", F.try_element_at(row, F.lit("product_name")).alias("product_name"), F.try_element_at(row, F.lit("price")).alias("price"))


@query("c4_store_locator", "SELECT raw_page_id, 'GS25' AS store_name, brand || ' đường ' || domain AS store_address, store_phone FROM products")
def _(t):
    c = F.col
    html = F.concat(F.lit("<div class='box-store-list'><div class='item'><div class='left'><b></b></div><div class='right'><p>"), c("brand"), F.lit(" đường "), c("domain"), F.lit("</p><p>"), c("store_phone"), F.lit("</p><p>View map</p></div></div></div>"))
    pages = t.products.select("raw_page_id", F.lit("www.gs25.com.vn").alias("domain"), F.lit("https://www.gs25.com.vn/stores").alias("url"), F.lit("").alias("page_type"), html.alias("html"))
    chosen = E.choose_rows(E.read_pages(pages, _shop_rules(t)))
    row = F.get("store_rows", 0)["record"]
    return chosen.select("raw_page_id", *[F.try_element_at(row, F.lit(n)).alias(n) for n in ("store_name", "store_address", "store_phone")])


@query("c5_jsonld_products", "SELECT raw_page_id, product_name, CAST(pk + 0.5 AS DOUBLE) AS price, brand, product_url FROM products")
def _(t):
    c = F.col
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), c("product_name").alias("name"), F.struct(c("brand").alias("name")).alias("brand"), F.regexp_replace("product_url", "^https://[^/]+", "").alias("url"),
                              F.struct((c("pk") + 0.5).alias("price"), F.lit("VND").alias("priceCurrency")).alias("offers")))
    html = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":[['), node, F.lit(']]}</script><script type="application/ld+json">{bad</script>'))
    pages = t.products.select("raw_page_id", "domain", F.concat("store_url", F.lit("x/y")).alias("url"), F.lit("listing").alias("page_type"), html.alias("html"))
    rows = _read(t, pages).select("raw_page_id", "domain", "url", F.explode("jsonld_products").alias("record"))
    return D.with_payload(rows).select("raw_page_id", "product_name", "price", "brand", "product_url")


@query("c6_page_context", "SELECT raw_page_id, brand, coalesce(nullif(store_name, ''), 'Chuỗi') AS store_name, 'https://' || domain || '/' AS store_url, '1 phố Huế, Hà Nội' AS store_address, store_phone FROM products")
def _(t):
    context = E.with_context(_read(t, _detail_pages(t))).select("raw_page_id", "context.*")
    return context.select("raw_page_id", "brand", "store_name", "store_url", "store_address", "store_phone")


def _chosen(t, pages, sources=None):
    return D.attach_store_config(E.choose_rows(_read(t, pages), generic=False), sources)


def _products(t):
    return D.products_of_pages(_chosen(t, _detail_pages(t)), _when("2024-06-01"))


_PID = A.sha16("domain", "product_url")
_STORE = "coalesce(nullif(store_name, ''), product_url)"
_LABEL = A.category("CAST(NULL AS VARCHAR)", "product_name", "product_url", "domain")


@query("c7_extracted_products", f"SELECT raw_page_id, {_PID} AS product_id, product_name, price_numeric, brand, {_LABEL} AS category FROM products")
def _(t):
    return _products(t).select("raw_page_id", "product_id", "product_name", "price_numeric", "brand", "category")


@query("c8_product_payload", f"SELECT {_PID} AS product_id, product_name, CASE WHEN price_numeric > 0 THEN 'FOUND' WHEN contains(lower(price_text), 'liên hệ') THEN 'CONTACT' ELSE 'MISSING' END AS price_status, CASE WHEN store_address IS NOT NULL THEN 'FOUND' WHEN store_channel = 'online' THEN 'NOT_APPLICABLE' ELSE 'MISSING' END AS address_status, {A.category("nullif(category, '')", 'product_name', 'product_url', 'domain')} AS category FROM products")
def _(t):
    names = {"name": "product_name", "price": "price_text", "href": "product_url", "store_address": "store_address", "store_channel": "store_channel", "category": "category"}
    record = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.col(v) for v in names.values()])), lambda k, v: v.isNotNull())
    rows = t.products.select("domain", F.col("store_url").alias("url"), record.alias("record"))
    return D.with_payload(rows).select("product_id", "product_name", "price_status", "address_status", "category")


_SELLER = A.sha16("domain", "surl", "sname", "'1 phố Huế, Hà Nội'", "store_phone")
_SHAPED = f"(SELECT *, {_PID} AS pid, product_url AS surl, {_STORE} AS sname FROM products)"


@query("c9_offers", f"SELECT {A.sha16('pid', _SELLER)} AS offer_id, {_SELLER} AS seller_key, pid AS product_id, price_numeric FROM {_SHAPED} WHERE price_numeric > 0")
def _(t):
    return D.offers(_products(t)).select("offer_id", "seller_key", "product_id", "price_numeric")


@query("c10_price_observations", f"SELECT {A.sha16('pid', 'raw_page_id', A.float_text('price_numeric'), 'surl', 'sname')} AS observation_id, pid AS product_id, price_numeric FROM {_SHAPED} WHERE price_numeric > 0")
def _(t):
    return D.price_observations(_products(t)).select("observation_id", "product_id", "price_numeric")


@query("c11_stores", f"SELECT {A.sha16('domain', 'sname2', chr(39) + '1 phố Huế, Hà Nội' + chr(39), 'surl')} AS store_location_id, sname AS store_name, '1 phố Huế, Hà Nội' AS store_address, store_phone FROM (SELECT *, product_url AS surl, {_STORE} AS sname, store_name AS sname2 FROM products)")
def _(t):
    return D.stores_of_pages(_chosen(t, _detail_pages(t))).select("store_location_id", "store_name", "store_address", "store_phone")


_CONF = "(SELECT *, coalesce(store_scope, 'site') = 'site' AS site_wide, coalesce(store_name, store_address, store_channel) IS NOT NULL AS set_up FROM sources)"


@query("c12_store_enrichment", f"""SELECT p.raw_page_id, s.source_id, CASE WHEN NOT coalesce(site_wide, true) THEN NULL WHEN set_up THEN s.store_name ELSE coalesce(nullif(p.store_name, ''), p.product_url) END AS store_name,
    CASE WHEN NOT coalesce(site_wide, true) THEN NULL WHEN set_up THEN s.store_address ELSE '1 phố Huế, Hà Nội' END AS store_address FROM products p LEFT JOIN {_CONF} s ON {A.bare('p.domain')} = {A.bare('s.domain')}""")
def _(t):
    rows = D.products_of_pages(_chosen(t, _detail_pages(t), t.sources), _when("2024-06-01"))
    return rows.select("raw_page_id", "source_id", "store_name", "store_address")


@query("c13_provenance", "SELECT raw_page_id, 'crawled' AS data_origin, 'v1' AS rule_version, 'selector' AS name_source, 'page_metadata' AS brand_source, 'h1' AS name_selector, price_text AS raw_price FROM products")
def _(t):
    entry = lambda c, k: F.try_element_at(c, F.lit(k))
    return _products(t).select("raw_page_id", "data_origin", "rule_version", entry("field_sources", "product_name").alias("name_source"), entry("field_sources", "brand").alias("brand_source"),
                               entry("field_details", "product_name")["selector"].alias("name_selector"), F.coalesce(entry("field_details", "price")["raw_value"], F.when(F.col("price_numeric").isNull(), "Liên hệ")).alias("raw_price"))


@query("n2_union_of_rows", "SELECT domain || '#' || CAST(CAST(floor(pk / 1000) AS BIGINT) AS VARCHAR) AS raw_page_id, count(*) AS product_rows FROM products GROUP BY 1")
def _(t):
    return E.choose_rows(_read(t, _listing_pages(t)), generic=False).select("raw_page_id", F.size("product_rows").cast("long").alias("product_rows"))


@query("b8_capture_class", "SELECT domain || '#' || CAST(CAST(floor(pk / 1000) AS BIGINT) AS VARCHAR) AS raw_page_id, 'listing' AS page_type FROM products GROUP BY 1 UNION ALL SELECT raw_page_id, 'product_detail' FROM products")
def _(t):
    pages = _listing_pages(t).unionByName(_detail_pages(t)).withColumn("depth", F.lit(1))
    return P.classify_captures(pages).select("raw_page_id", "page_type")


@query("b8_capture_class_stored")
def _(t):
    return P.classify_captures(t.raw_pages.withColumn("depth", F.lit(0))).select("raw_page_id", "page_type")


#: Shops whose detail pages nobody has classified, so that their rules are tried on pages of unknown class.
_UNDECIDED = "CAST(regexp_extract(domain, '([0-9]+)', 1) AS INTEGER) % 5 = 0"


def _rule_rows(t):
    """Rule rows of both kinds of shop pages, with the samples they were tried on."""
    details = _detail_pages(t).withColumn("class", F.when(F.expr(_UNDECIDED), "unknown").otherwise(page_class("page_type", "url")))
    pages = _listing_pages(t).withColumn("class", page_class("page_type", "url")).unionByName(details)
    read = _read(t, pages, facts=False)
    # The classes of the pages go into the targets, the samples and every figure: find them once.
    place = work_folder(t.spark, "rule_pages")
    classed = pages.select("domain", "raw_page_id", "class")
    classed.write.parquet(place)
    classed = t.spark.read.schema(classed.schema).parquet(place)
    targets = classed.select("domain").distinct().select("domain", F.explode(F.array(F.lit("listing"), F.lit("product_detail"))).alias("target"))
    samples = Q.sample_targets(classed, targets)
    sections = F.array(*[F.struct(F.lit(n).alias("target"), E.finished_records(F.col(n)).alias("records")) for n in ("listing", "product_detail")])
    rows = read.select("domain", "raw_page_id", F.explode(sections).alias("s")).select("domain", "raw_page_id", F.col("s")["target"].alias("target"), F.explode(F.col("s")["records"]).alias("record"))
    # Every figure below goes over these rows: read the pages once and write what they hold.
    place = work_folder(t.spark, "rule_rows")
    rows = Q.checked_rows(rows.join(samples.select("raw_page_id", "target"), ["raw_page_id", "target"], "left_semi"))
    rows.write.parquet(place)
    return t.spark.read.schema(rows.schema).parquet(place), samples


_OK_PRICE = "coalesce(price_numeric BETWEEN low AND high, false)"


def _target_sql(bounds):
    # A listing names its items by URL, a detail page, whose rule has no URL, by name, which products of one shop may share.
    return f"""(SELECT domain, 'listing' AS target, count(*) AS row_count, count(DISTINCT floor(pk / 1000)) AS sample_count, count(*) FILTER ({_OK_PRICE}) AS valid_rows, count(DISTINCT floor(pk / 1000)) FILTER ({_OK_PRICE}) AS good, count(DISTINCT lower(product_url)) FILTER ({_OK_PRICE}) AS unique_items FROM {bounds} GROUP BY domain
    UNION ALL SELECT domain, 'product_detail', count(*), count(*), count(*) FILTER ({_OK_PRICE}), count(*) FILTER ({_OK_PRICE}), count(DISTINCT lower(product_name)) FILTER ({_OK_PRICE}) FROM {bounds} GROUP BY domain)"""


def _bounds_sql():
    from .functions_ import bounds_table
    return bounds_table("CAST(NULL AS VARCHAR)")


@query("f12_target_metrics", f"""SELECT domain, target, sample_count, valid_rows, unique_items, round(good / sample_count, 3) AS sample_success,
    CASE WHEN target = 'listing' THEN least({K.MIN_SAMPLES['listing']}, sample_count) WHEN {_UNDECIDED} THEN 1 ELSE least({K.MIN_SAMPLES['product_detail']}, sample_count) END AS minimum_samples FROM {_target_sql(_bounds_sql())}""")
def _(t):
    return Q.target_results(*_rule_rows(t)).select("domain", "target", "sample_count", "valid_rows", "unique_items", "sample_success", F.col("minimum_samples").cast("long").alias("minimum_samples"))


@query("f12_sample_results", f"""SELECT domain || '#' || CAST(CAST(floor(pk / 1000) AS BIGINT) AS VARCHAR) AS raw_page_id, 'listing' AS target, 'listing' AS page_type, count(*) AS row_count, count(*) FILTER ({_OK_PRICE}) AS valid_rows, round(count(*) FILTER ({_OK_PRICE}) / count(*), 3) AS coverage FROM {_bounds_sql()} GROUP BY 1
    UNION ALL SELECT raw_page_id, 'product_detail', CASE WHEN {_UNDECIDED} THEN 'unknown' ELSE 'product_detail' END, 1, CASE WHEN {_OK_PRICE} THEN 1 ELSE 0 END, CASE WHEN {_OK_PRICE} THEN 1.0 ELSE 0.0 END FROM {_bounds_sql()}""")
def _(t):
    return Q.sample_results(*_rule_rows(t)).drop("domain")


_PASSED = "sample_count >= 1 AND valid_rows >= CASE target WHEN 'listing' THEN 2 ELSE 1 END AND good / sample_count >= 0.8"
#: Share of the rows with an old price (detail pages carry one) that lies above the price, among the valid rows.
_CONSISTENT = f"(SELECT domain, coalesce(sum(CASE WHEN old_price >= price_numeric THEN 1.0 ELSE 0.0 END) FILTER ({_OK_PRICE} AND old_price IS NOT NULL) / nullif(count(*) FILTER ({_OK_PRICE} AND old_price IS NOT NULL), 0), 1.0) AS same FROM {_bounds_sql()} GROUP BY domain)"
_SCORE = f"""round(sum(CASE target WHEN 'listing' THEN 2 * row_count + valid_rows ELSE row_count + valid_rows END) / sum(CASE target WHEN 'listing' THEN 3 * row_count ELSE 2 * row_count END) * 0.65
      + least(1.0, sum(valid_rows) / 5) * 0.25 + any_value(same) * 0.10, 3)"""
_VERDICTS = f"""(SELECT domain, {_SCORE} AS score, bool_and({_PASSED}) AND {_SCORE} >= 0.72 AS accepted,
      concat_ws(',', CASE WHEN bool_or(target = 'listing' AND {_PASSED}) THEN 'listing' END, CASE WHEN bool_or(target = 'product_detail' AND {_PASSED}) THEN 'product_detail' END) AS passed
      FROM {_target_sql(_bounds_sql())} JOIN {_CONSISTENT} USING (domain) GROUP BY domain)"""


def _verdicts(t):
    rows, samples = _rule_rows(t)
    return Q.rule_verdicts(Q.target_results(rows, samples), Q.rule_metrics(rows))


@query("f14_rule_verdicts", f"SELECT domain, score, accepted, passed FROM {_VERDICTS}")
def _(t):
    return _verdicts(t).select("domain", "score", "accepted", F.array_join("passed_targets", ",").alias("passed"))


# A listing names its items by URL, a detail page without one in its rule by name.
@query("f14_rule_metrics", f"""SELECT domain, count(*) FILTER ({_OK_PRICE}) * 2 AS valid_products, round(1 - least(1.0, count(*) FILTER ({_OK_PRICE}) * 2 / 5), 3) AS duplicate_ratio, median(price_numeric) FILTER ({_OK_PRICE}) AS median_price,
    round((3 * count(*) + 2 * count(*) FILTER ({_OK_PRICE})) / (5 * count(*)), 3) AS required_coverage FROM {_bounds_sql()} GROUP BY domain""")
def _(t):
    return _verdicts(t).select("domain", "valid_products", "duplicate_ratio", "median_price", "required_coverage")


@query("j7_rule_reuse", f"SELECT domain, passed FROM {_VERDICTS} WHERE accepted")
def _(t):
    from ..operators.lifecycle import reused_rules
    return reused_rules(_verdicts(t)).select("domain", F.array_join("allowed_targets", ",").alias("passed"))


@query("f13_store_metrics", "SELECT domain, count(*) AS sample_count, count(*) AS valid_rows, true AS passed FROM products GROUP BY domain")
def _(t):
    html = F.concat(F.lit("<div class='store'><b>"), "product_name", F.lit("</b><i>"), "raw_page_id", F.lit(" phố Huế</i></div><div class='store'><b>Thiếu địa chỉ</b></div>"))
    field = lambda n, s: F.struct(F.lit(n).alias("name"), F.lit(s).alias("selector"), F.lit(None).cast("string").alias("attr"), F.lit(False).alias("required"), F.lit(None).cast("string").alias("transform"))
    section = F.struct(F.lit(".store").alias("item_selector"), F.array(field("store_name", "b"), field("store_address", "i")).alias("fields"))
    empty = F.lit(None).cast(E.SECTION)
    rules = t.products.select(without_www("domain").alias("domain")).distinct().select("domain", F.struct(empty.alias("listing"), empty.alias("product_detail"), section.alias("stores")).alias("structure"))
    pages = t.products.select("raw_page_id", "domain", F.concat("store_url", F.lit("stores/"), "raw_page_id").alias("url"), F.lit("").alias("page_type"), html.alias("html"))
    read = E.read_pages(pages, rules, generic=False, facts=False)
    rows = read.select("domain", "raw_page_id", F.lit("stores").alias("target"), F.explode(E.finished_rows(F.col("stores"))).alias("r")).select("domain", "raw_page_id", "target", F.col("r")["record"].alias("record"))
    samples = pages.select("domain", "raw_page_id", F.lit("stores").alias("target"), F.lit("store_listing").alias("class"))
    return Q.target_results(rows, samples).select("domain", "sample_count", "valid_rows", "passed")


@query("a3_merge_pages", "SELECT raw_page_id, CASE WHEN pk % 3 = 0 THEN 'again' ELSE coalesce(content_type, 'html') END AS content_type, url FROM raw_pages")
def _(t):
    stored = t.raw_pages.withColumn("content_type", F.coalesce("content_type", F.lit("html")))
    again = stored.filter("pk % 3 = 0").select("raw_page_id", F.lit("again").alias("content_type"), "captured_at")
    return S.merged_pages(stored, again).select("raw_page_id", "content_type", "url")


@query("o2_rule_function", "SELECT raw_page_id, 'product_name' AS name, product_name AS raw, CAST(NULL AS VARCHAR) AS link FROM products UNION ALL SELECT raw_page_id, 'image_url', '/img/' || raw_page_id || '.jpg', 'https://' || domain || '/img/' || raw_page_id || '.jpg' FROM products")
def _(t):
    E.register_rule_function(t.spark)
    section = '{"fields":[{"name":"product_name","selector":"h1"},{"name":"image_url","selector":"img","attr":"data-src"}]}'
    return t.spark.sql("SELECT raw_page_id, r.name, r.raw, r.link FROM {pages}, LATERAL rule_rows(html, url, '" + section.replace("{", "{{").replace("}", "}}") + "') AS r", pages=_detail_pages(t))


# --- files ----------------------------------------------------------------------------------

@query("a2_page_payloads", "SELECT raw_page_id, md5(html) AS digest FROM raw_pages")
def _(t):
    half = F.col("pk") % 2 == 0
    pages = t.raw_pages.select("raw_page_id", F.when(half, F.col("html")).alias("content"), F.when(~half, F.concat("raw_page_id", F.lit(".html"))).alias("object_key"))
    objects = t.raw_pages.select(F.concat(F.lit("s3://lake/x/"), "raw_page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return S.resolve_payloads(pages, objects=objects).select("raw_page_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("a4_archives", "SELECT raw_page_id AS path, md5(html) AS digest FROM raw_pages")
def _(t):
    head = "MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=BB\r\n\r\n--BB\r\nContent-Type: text/css\r\n\r\na{}\r\n--BB\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    body = F.concat(F.lit(head), F.base64(F.col("html").cast("binary")), F.lit("\r\n--BB--\r\n"))
    decoded = S.decode_archives(t.raw_pages.select(F.col("raw_page_id").alias("path"), body.cast("binary").alias("content")))
    return decoded.select("path", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("a9_output_files", "SELECT product_name AS name, domain AS source, CAST(pk AS VARCHAR) AS price, product_url AS url FROM products")
def _(t):
    place = work_folder(t.spark, "outputs")
    product = F.struct(F.col("product_name").alias("name"), F.col("pk").alias("price"), F.col("product_url").alias("url"))
    one_file_text = t.products.groupBy("domain", F.floor(F.col("pk") / 1000).alias("k")).agg(F.collect_list(product).alias("products")).select(F.col("domain").alias("source_site"), "products")
    one_file_text.write.json(place)
    return S.read_output_files(t.spark, place, multi_line=False).select("name", "source", "price", "url")


@query("a10_job_status", "SELECT run_id AS id, CASE WHEN status = 'failed' THEN 'Failed' WHEN status IN ('completed', 'partial') THEN 'Completed' ELSE 'Pending' END AS status FROM runs")
def _(t):
    metas = t.runs.select(F.col("run_id").alias("job_id"), F.col("pipeline_id").alias("source"), F.col("created_at").alias("modified_at"))
    outputs = t.runs.filter("status IN ('completed', 'partial', 'failed')").select(F.col("run_id").alias("job_id"))
    return S.job_files(metas, outputs, t.runs.filter("status = 'failed'").select(F.col("run_id").alias("job_id"))).select("id", "status")


@query("a10_job_files", "SELECT 'j' || CAST(sk AS VARCHAR) || 'x' AS id, name AS source, CASE WHEN sk % 5 = 0 THEN 'Failed' WHEN sk % 2 = 0 THEN 'Completed' ELSE 'Pending' END AS status FROM sources WHERE sk % 7 <> 0")
def _(t):
    place = work_folder(t.spark, "jobs")
    k = F.col("sk")
    job = F.concat(F.lit("j"), k.cast("string"), F.lit("x"))
    meta = F.when(k % 7 == 0, "{ no file facts").otherwise(F.to_json(F.struct(F.col("name").alias("domain"))))
    files = t.sources.select(F.explode(F.array_compact(F.array(
        F.struct(F.concat(F.lit("raw/"), "domain", F.lit("/"), job, F.lit(".meta.json")).alias("path"), meta.alias("text")),
        F.when(k % 5 == 0, F.struct(F.concat(F.lit("raw/"), "domain", F.lit("/"), job, F.lit(".error")).alias("path"), F.lit("x").alias("text"))),
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("outputs/out_"), job, F.lit("_2024.json")).alias("path"), F.lit("[]").alias("text")))))).alias("f")).select("f.*")
    S.write_named_files(files, place)
    return S.scan_jobs(t.spark, f"{place}/raw", f"{place}/outputs").select("id", "source", "status")


@query("a11_rule_files", "SELECT domain, '.' || CAST(sk % 7 AS VARCHAR) AS item, CAST(1 + sk % 2 AS INTEGER) AS fields FROM sources WHERE sk % 3 <> 0")
def _(t):
    place = work_folder(t.spark, "rules")
    one = F.concat(F.lit('{"name":"f'), F.col("sk").cast("string"), F.lit('","selector":"h3"}'))
    two = F.when(F.col("sk") % 2 == 1, F.concat(F.lit(","), F.lit('{"name":"price","selector":".p"}'))).otherwise("")
    item = F.when(F.col("sk") % 5 == 0, "container_selector").otherwise("item_selector")
    body = F.concat(F.lit('{"domain":"'), F.upper("domain"), F.lit('","listing":{"'), item, F.lit('":".'), (F.col("sk") % 7).cast("string"), F.lit('","fields":['), one, two, F.lit("]}}"))
    # Files of one folder, written by all cores: a folder for each would be listed one by one.
    files = t.sources.select(F.concat(F.col("sk").cast("string"), F.lit(".json")).alias("path"), F.when(F.col("sk") % 3 == 0, "{ no rule").otherwise(body).alias("text"))
    S.write_named_files(spread(files, "path"), place)
    rules = S.read_rule_files(t.spark, place)
    return rules.select("domain", F.col("structure")["listing"]["item_selector"].alias("item"), F.size(F.col("structure")["listing"]["fields"]).alias("fields"))


@query("a13_json_lines", "SELECT domain, count(*) AS pages FROM shop_pages GROUP BY domain")
def _(t):
    place = work_folder(t.spark, "lines")
    S.write_json_lines(t.shop_pages.groupBy("domain").agg(F.count("*").alias("pages")), place)
    return t.spark.read.schema("domain string, pages long").json(place)


@query("a17_append", "SELECT run_id, status, count(*) AS n FROM (SELECT run_id, status FROM runs UNION ALL SELECT run_id, status FROM runs WHERE status = 'failed') GROUP BY 1, 2")
def _(t):
    place = work_folder(t.spark, "events")
    rows = t.runs.select("run_id", "status")
    S.append_rows(rows, place)
    S.append_rows(rows.filter("status = 'failed'"), place)
    return t.spark.read.schema(rows.schema).parquet(place).groupBy("run_id", "status").agg(F.count("*").alias("n"))
