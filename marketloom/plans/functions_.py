"""Queries over column functions and page classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import classify as C
from ..functions import ids as I
from ..functions import text as X
from ..functions import urls as U
from ..functions import validity as V
from . import ansi as A
from .registry import query

# --- text -----------------------------------------------------------------------------------


@query("d1_clean_text", f"SELECT doc_id, md5(s) AS digest, CAST(length(s) AS INTEGER) AS size FROM (SELECT doc_id, {A.clean('text')} AS s FROM documents)")
def _(t):
    s = X.clean_text("text")
    return t.documents.select("doc_id", F.md5(s.cast("binary")).alias("digest"), F.length(s).alias("size"))


@query("d2_clean_price", f"SELECT product_id, {A.price('price_text')} AS price FROM products")
def _(t):
    return t.products.select("product_id", X.clean_price("price_text").alias("price"))


@query("d2_clean_price_documents", f"SELECT doc_id, {A.price('text')} AS price FROM documents")
def _(t):
    return t.documents.select("doc_id", X.clean_price("text").alias("price"))


@query("d3_normalize_price", f"SELECT observation_id, count(*) AS n, max(CASE WHEN p > 0 THEN p END) AS price FROM (SELECT observation_id, {A.price('CAST(CAST(price_numeric AS BIGINT) AS VARCHAR)')} AS p FROM observations) GROUP BY 1")
def _(t):
    p = X.positive_price(F.col("price_numeric").cast("long"))
    return t.observations.groupBy("observation_id").agg(F.count("*").alias("n"), F.max(p).alias("price"))


@query("d4_category", f"SELECT product_id, {A.category('category', 'product_name', 'product_url', 'domain')} AS category FROM products")
def _(t):
    return t.products.select("product_id", C.category(*[F.col(c) for c in ("category", "product_name", "product_url", "domain")]).alias("category"))


@query("d4_category_documents", f"SELECT {A.category('text')} AS category, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy(C.category(F.col("text")).alias("category"), "lang").agg(F.count("*").alias("n"))


@query("d5_source_group", f"SELECT source_id, {A.labels('lower(coalesce(category, chr(32)))', K.SOURCE_GROUP_KEYWORDS, K.DEFAULT_SOURCE_GROUP)} AS grp FROM sources")
def _(t):
    return t.sources.select("source_id", C.source_group("category").alias("grp"))


@query("d6_address_status", f"SELECT product_id, CASE WHEN {A.clean('store_address')} <> '' THEN 'FOUND' WHEN store_channel = 'online' THEN 'NOT_APPLICABLE' ELSE 'MISSING' END AS status FROM products")
def _(t):
    return t.products.select("product_id", C.address_status("store_address", F.col("store_channel")).alias("status"))


@query("d7_price_status", f"SELECT product_id, CASE WHEN price_numeric > 0 THEN 'FOUND' WHEN {A.any_of('lower(' + A.clean('price_text') + ')', K.CONTACT_WORDS)} THEN 'CONTACT' ELSE 'MISSING' END AS status FROM products")
def _(t):
    return t.products.select("product_id", C.price_status("price_text", F.col("price_numeric")).alias("status"))


@query("d8_part_ids", f"SELECT product_id, {A.sha16('domain', 'store_name', 'store_address')} AS id16, substr(sha1(coalesce(domain, '') || '|' || coalesce(store_name, '') || '|' || coalesce(store_address, '')), 1, 20) AS id20 FROM products")
def _(t):
    parts = ("domain", "store_name", "store_address")
    return t.products.select("product_id", I.part_id(*parts).alias("id16"), I.full_part_id(*parts).alias("id20"))


@query("d9_first_present", "SELECT product_id, coalesce(nullif(store_name, ''), nullif(store_address, ''), nullif(brand, '')) AS v FROM products")
def _(t):
    return t.products.select("product_id", X.first_present("store_name", "store_address", "brand").alias("v"))


@query("d10_alias_lookup", "SELECT product_id, product_name AS name, CAST(pk AS VARCHAR) AS price, nullif(store_name, '') AS store_name, CAST(NULL AS VARCHAR) AS rating FROM products")
def _(t):
    record = F.create_map(F.lit(" Tên sản phẩm "), F.col("product_name"), F.lit("GIA"), F.col("pk").cast("string"), F.lit("Kênh Bán"), F.col("store_name"))
    low = t.products.select("product_id", X.lower_keys(record).alias("r"))
    return low.select("product_id", *[X.first_alias(F.col("r"), K.SYNTHETIC_ALIASES[n]).alias(n) for n in ("name", "price", "store_name", "rating")])


@query("d11_percentage", rf"SELECT product_id, replace({A.first('product_name', chr(92) + 'd+(?:[.,]' + chr(92) + 'd+)?' + chr(92) + 's*%', 0)}, ',', '.') AS pct FROM products")
def _(t):
    return t.products.select("product_id", X.percentage("product_name").alias("pct"))


@query("d12_volume", f"SELECT product_id, {A.volume('product_name')} AS ml, {A.volume(A.joined('product_name', 'brand'))} AS joined_ml, {A.folded_volume(A.fold('product_name'))} AS folded_ml FROM products")
def _(t):
    n = F.col("product_name")
    return t.products.select("product_id", X.volume_ml(n).alias("ml"), X.infer_volume_ml(n, F.col("brand")).alias("joined_ml"), X.canonical_volume_ml(n).alias("folded_ml"))


_PACKAGE = ", ".join(f"try_cast({A.first(A.joined('product_name'), p)} AS INTEGER)" for p in (
    r"(?i)(?:thùng|hộp|lốc|pack|case)\s*(\d{1,3})", r"(?i)(\d{1,3})\s*(?:chai|lon|hộp|goi|gói)\b", r"(?i)x\s*(\d{1,3})\b"))


@query("d13_package_count", f"SELECT product_id, greatest(1, least(coalesce({_PACKAGE}, 1), 500)) AS n FROM products")
def _(t):
    return t.products.select("product_id", X.infer_package_count(F.col("product_name")).alias("n"))


@query("d14_pack_size", f"SELECT product_id, coalesce({A.folded_pack(A.fold('product_name'))}, -1) AS pack FROM products")
def _(t):
    return t.products.select("product_id", F.coalesce(X.canonical_pack_size(F.col("product_name")), F.lit(-1)).alias("pack"))


@query("d15_abv", f"SELECT product_id, {A.folded_abv(A.fold('product_name'))} AS abv FROM products")
def _(t):
    return t.products.select("product_id", X.canonical_abv(F.col("product_name")).alias("abv"))


_STOCK = "CASE pk % 4 WHEN 0 THEN 'Tạm hết hàng' WHEN 1 THEN 'CÒN HÀNG' WHEN 2 THEN 'In Stock' ELSE brand END"


@query("d16_stock", f"SELECT product_id, CASE WHEN {A.any_of('lower(s)', K.SOLD_OUT_WORDS)} THEN 'OUT_OF_STOCK' WHEN {A.any_of('lower(s)', K.IN_STOCK_WORDS)} THEN 'IN_STOCK' END AS stock FROM (SELECT product_id, {_STOCK} AS s FROM products)")
def _(t):
    return t.products.select("product_id", X.stock_status(F.expr(_STOCK)).alias("stock"))


@query("d17_rating", r"SELECT product_id, try_cast(replace(nullif(regexp_extract(s, '\d+(?:[.,]\d+)?'), ''), ',', '.') AS DOUBLE) AS rating, CAST(nullif(regexp_extract(s, '\d+'), '') AS INTEGER) AS reviews FROM (SELECT product_id, CAST(pk % 5 AS VARCHAR) || ',' || CAST(pk % 10 AS VARCHAR) || ' / 5 (' || brand || ')' AS s FROM products)")
def _(t):
    s = F.concat((F.col("pk") % 5).cast("string"), F.lit(","), (F.col("pk") % 10).cast("string"), F.lit(" / 5 ("), "brand", F.lit(")"))
    return t.products.select("product_id", X.rating_number(s).alias("rating"), X.review_count(s).alias("reviews"))


_PHONE_SQL = A.clean(f"regexp_extract(text, '{K.PHONE_PATTERN}')")


@query("d18_phone", f"SELECT doc_id, {_PHONE_SQL} AS phone FROM documents")
def _(t):
    return t.documents.select("doc_id", X.phone("text").alias("phone"))


@query("d19_name_key", r"SELECT product_id, trim(regexp_replace(lower(product_name), '[^\p{L}\p{N}_]+', ' ', 'g')) AS k FROM products")
def _(t):
    return t.products.select("product_id", X.product_name_key("product_name").alias("k"))


@query("d20_fold_text", f"SELECT product_id, {A.fold('product_name')} AS folded FROM products")
def _(t):
    return t.products.select("product_id", X.fold_text("product_name").alias("folded"))


@query("d20_fold_documents", f"SELECT doc_id, md5({A.fold('text')}) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.fold_text("text").cast("binary")).alias("digest"))


@query("d21_name_core", f"SELECT product_id, {A.core(A.fold('product_name'), A.fold('brand'))} AS core FROM products")
def _(t):
    return t.products.select("product_id", X.name_core("product_name", "brand").alias("core"))


@query("d22_canonical_key", f"SELECT product_id, canonical_key FROM ({A.features()})")
def _(t):
    from ..operators.resolution import canonical_features
    return canonical_features(t.products).select("product_id", "canonical_key")


@query("d24_pair_id", "SELECT observation_id, count(*) AS n, max(substr(sha1(least(l, r) || '|' || greatest(l, r)), 1, 12)) AS pair FROM (SELECT observation_id, source || ':' || observation_id AS l, source_id || ':' || product_id AS r FROM observations) GROUP BY 1")
def _(t):
    pair = I.pair_id(F.col("source"), F.col("observation_id"), F.col("source_id"), F.col("product_id"))
    return t.observations.groupBy("observation_id").agg(F.count("*").alias("n"), F.max(pair).alias("pair"))


def bounds_table(category: str = "category") -> str:
    """Products with label c and price bounds low and high."""
    def bound(which: int) -> str:
        base = "CASE c " + " ".join(f"WHEN '{k}' THEN {v[which]}" for k, v in K.PRICE_LIMITS.items()) + " END"
        scale = ("CASE WHEN ml IS NULL OR ml = 0 THEN 1.0 WHEN c IN ('Rượu', 'Bia') THEN greatest(0.15, least(ml / 750.0, 4.0)) "
                 "WHEN c = 'Sữa' THEN greatest(0.1, least(ml / 1000.0, 10.0)) ELSE 1.0 END")
        return f"CAST(trunc(CAST({base} AS DOUBLE) * CAST(n AS DOUBLE) * CAST({scale} AS DOUBLE)) AS BIGINT)"

    label = A.category(category, "product_name", "product_url", "domain")
    return (f"(SELECT *, {bound(0)} AS low, {bound(1)} AS high FROM (SELECT *, {label} AS c, greatest(1, least(coalesce({_PACKAGE}, 1), 500)) AS n, "
            f"CAST({A.volume(A.joined('product_name'))} AS DOUBLE) AS ml FROM products))")


_BOUNDS = bounds_table()


@query("d25_price_bounds", f"SELECT product_id, low, high FROM {_BOUNDS}")
def _(t):
    b = V.price_bounds(*[F.col(c) for c in ("product_name", "category", "product_url", "domain")])
    return t.products.select("product_id", b["low"].alias("low"), b["high"].alias("high"))


_GENERIC = ", ".join(f"'{g}'" for g in K.GENERIC_NAMES)


@query("d26_valid_name", f"SELECT doc_id, length({A.clean('text')}) BETWEEN 3 AND 300 AND NOT regexp_matches({A.clean('text')}, '(?i)^https?://') AND lower({A.clean('text')}) NOT IN ({_GENERIC}) AS ok FROM documents")
def _(t):
    return t.documents.select("doc_id", C.valid_product_name("text").alias("ok"))


_VALID_URL = f"regexp_matches({A.clean('url')}, '^https?://') AND {A.authority(A.clean('url'))} <> '' AND {A.bare(A.authority(A.clean('url')))} = {A.bare('domain')} AND {A.path(A.clean('url'))} NOT IN ('', '/')"


@query("d27_valid_url", f"SELECT raw_page_id, {_VALID_URL} AS ok FROM shop_pages")
def _(t):
    return t.shop_pages.select("raw_page_id", C.valid_product_url("url", "domain").alias("ok"))


@query("d28_row_checks", f"""SELECT product_id, length(product_name) BETWEEN 3 AND 300 AS name_ok, coalesce(price_numeric BETWEEN low AND high, false) AS price_ok,
    {_VALID_URL.replace("'url'", "'product_url'").replace('CAST(url ', 'CAST(product_url ')} AS url_ok, old_price IS NULL OR price_numeric IS NULL OR old_price >= price_numeric AS old_ok FROM {_BOUNDS}""")
def _(t):
    row = {c: F.col(c) for c in ("product_name", "product_url", "category")}
    row |= {"price": F.col("price_text"), "old_price": F.col("old_price").cast("long").cast("string")}
    c = V.row_checks(row, F.col("domain"), "listing")
    return t.products.select("product_id", *[c[n].alias(a) for n, a in (("product_name", "name_ok"), ("price", "price_ok"), ("product_url", "url_ok"), ("old_price", "old_ok"))])


@query("d29_content_hash", "SELECT raw_page_id, substr(sha256(html), 1, 16) AS h FROM raw_pages")
def _(t):
    return t.raw_pages.select("raw_page_id", I.text_hash(F.col("html")).alias("h"))


@query("d31_labels", """SELECT run_id, CASE status WHEN 'failed' THEN 'Failed' WHEN 'completed' THEN 'Completed' WHEN 'running' THEN 'Processing' WHEN 'blocked' THEN 'Blocked' ELSE 'Partial' END AS label,
    CASE status WHEN 'running' THEN 'processing' ELSE status END AS bucket, lower(trim(kind)) AS hint FROM runs""")
def _(t):
    return t.runs.select("run_id", C.job_label("status").alias("label"), C.job_bucket("status").alias("bucket"), C.target_hint("kind").alias("hint"))


@query("d32_safe_domain", r"SELECT raw_page_id, regexp_full_match(lower(trim(split_part(url, '//', 2))), '[a-z0-9.\-]+') AS safe, regexp_full_match(domain, '[a-z0-9.\-]+') AS domain_safe FROM shop_pages")
def _(t):
    return t.shop_pages.select("raw_page_id", U.is_safe_domain(F.split_part("url", F.lit("//"), F.lit(2))).alias("safe"), U.is_safe_domain("domain").alias("domain_safe"))


@query("d33_cooldown", "SELECT domain, content_hash, sum(CASE WHEN error LIKE '%429%' THEN 1800 WHEN error LIKE '%503%' THEN 600 ELSE 300 END)::BIGINT AS seconds FROM attempts GROUP BY 1, 2")
def _(t):
    return t.attempts.groupBy("domain", "content_hash").agg(F.sum(C.cooldown_seconds("error")).alias("seconds"))


@query("d38_clean_list", f"SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(list_sort(l), '|')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[,\\n]'), lambda x: {A.clean('x')}), lambda x: x <> '')) AS l FROM documents)")
def _(t):
    items = t.documents.select("doc_id", X.clean_list(F.col("text")).alias("l"))
    return items.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join(F.array_sort("l"), "|").cast("binary")).alias("digest"))


@query("d39_labels", "SELECT product_id, CASE WHEN price_numeric > 0 THEN replace(format('{:,}', CAST(price_numeric AS BIGINT)), ',', '.') || ' VND' ELSE 'N/A' END AS price, coalesce(nullif(store_address, ''), CASE WHEN store_channel = 'online' THEN 'Online' ELSE 'Chưa có địa chỉ' END) AS address FROM products")
def _(t):
    return t.products.select("product_id", X.price_label(F.col("price_numeric")).alias("price"), X.address_label(F.col("store_address"), F.lit("MISSING"), F.col("store_channel")).alias("address"))


# --- URLs and page classes ------------------------------------------------------------------


@query("b1_domain", f"SELECT page_id, {A.bare('lower(' + A.authority('url') + ')')} AS domain, {A.path('url')} AS path FROM pages")
def _(t):
    return t.pages.select("page_id", U.normalize_domain("url").alias("domain"), U.path("url").alias("path"))


@query("b2_domain_aliases", f"SELECT s.source_id, count(*) AS pages FROM sources s JOIN shop_pages p ON {A.bare('s.domain')} = {A.bare('p.domain')} GROUP BY 1")
def _(t):
    sources = t.sources.select("source_id", U.without_www("domain").alias("site"))
    counts = t.shop_pages.groupBy(U.without_www("domain").alias("site")).agg(F.count("*").alias("pages"))
    return sources.join(counts, "site").select("source_id", "pages")


@query("b3_resolve_domains", f"""WITH asked AS (SELECT DISTINCT domain AS wanted FROM shop_pages), keys AS (
    SELECT source_id, {A.bare('domain')} AS k FROM sources UNION SELECT source_id, {A.bare(A.authority('url'))} FROM sources)
    SELECT wanted, min(source_id) AS source_id, CASE WHEN min(source_id) IS NULL THEN 'Source not found' ELSE '' END AS error FROM asked LEFT JOIN keys ON {A.bare('wanted')} = k GROUP BY wanted""")
def _(t):
    from ..operators.pages import resolve_domains
    return resolve_domains(t.shop_pages.select(F.col("domain").alias("wanted")).distinct(), t.sources)


@query("b4_resolve_url", f"SELECT page_id, {A.authority('url')} AS host, regexp_extract(url, '^https?://[^/?#]*') || '/x/' || CAST(page_id AS VARCHAR) AS absolute, regexp_extract(url, '^https?://[^/?#]*') || '/up.html' AS climbed FROM pages")
def _(t):
    return t.pages.select("page_id", U.authority("url").alias("host"), U.resolve_url(F.concat(F.lit("/x/"), F.col("page_id").cast("string")), "url").alias("absolute"),
                          U.resolve_url(F.lit("../../../up.html"), "url").alias("climbed"))


@query("b5_name_from_url", f"SELECT product_id, regexp_matches(product_url, '(?i)^https?://') AS url_like, {A.name_from_url('product_url')} AS name FROM products")
def _(t):
    return t.products.select("product_id", U.is_url_like("product_url").alias("url_like"), U.name_from_url("product_url").alias("name"))


@query("b5_name_from_page_url", f"SELECT page_id, {A.name_from_url('url')} AS name FROM pages")
def _(t):
    return t.pages.select("page_id", U.name_from_url("url").alias("name"))


@query("b6_extraction_target", f"SELECT raw_page_id, coalesce({A.target('page_type', 'url')}, 'none') AS target FROM shop_pages")
def _(t):
    return t.shop_pages.select("raw_page_id", F.coalesce(C.extraction_target("page_type", "url"), F.lit("none")).alias("target"))


@query("b6_extraction_target_pages", f"SELECT raw_page_id, coalesce({A.target('page_type', 'url')}, 'none') AS target FROM raw_pages")
def _(t):
    return t.raw_pages.select("raw_page_id", F.coalesce(C.extraction_target("page_type", "url"), F.lit("none")).alias("target"))


@query("b7_page_class", f"SELECT raw_page_id, {A.page_class('page_type', 'url')} AS class FROM shop_pages")
def _(t):
    return t.shop_pages.select("raw_page_id", C.page_class("page_type", "url").alias("class"))


@query("b9_looks_dynamic", rf"SELECT page_id, {A.any_of('lower(html)', K.SCRIPT_RENDER_MARKS)} OR (length(regexp_replace(regexp_replace(lower(html), '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g')) < 500 AND (length(lower(html)) - length(replace(lower(html), '<a ', ''))) / 3 < 5) AS dynamic FROM pages")
def _(t):
    return t.pages.select("page_id", C.looks_dynamic("html").alias("dynamic"))
