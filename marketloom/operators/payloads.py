"""Extracted records to products, offers, price observations and stores. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.classify import address_status, category_of, price_status
from ..functions.ids import part_id, price_part, text_hash
from ..functions.urls import is_url_like, name_from_url, resolve_url, without_www
from ..session import broadcast_if_small
from .common import computed_once, exploded, with_item

STORE_CONFIG = ["store_scope", "store_name", "store_url", "store_address", "store_phone", "store_channel"]
TRACED_FIELDS = ["product_name", "price", "brand", "product_url", "store_name", "store_url", "store_address", "store_phone"]


def _entry(record: Column, name: str) -> Column:
    return X.blank_to_null(F.try_element_at(record, F.lit(name)))


PAYLOAD = [
    "product_id", "product_name", "canonical_name", "product_url", "image_url", "price_numeric", "price", "price_status",
    "old_price", "currency", "brand", "category", "normalized_category", "store_name", "store_url", "store_address",
    "store_channel", "address_status", "store_phone", "raw_data",
]


def with_payload(df: DataFrame) -> DataFrame:
    """Add the payload columns of ``record``; rows with neither name nor URL are dropped.

    Needs record, domain and url. Built in steps, so that each value is computed once; rows are filtered by name, URL and price
    here and later.
    """
    record, link = F.col("record"), F.col("product_url")
    df = df.withColumns({
        "_name": X.clean_text(X.first_alias(record, K.NAME_ALIASES)), "_price": X.first_alias(record, K.PRICE_ALIASES),
        "product_url": F.coalesce(resolve_url(X.first_alias(record, K.URL_ALIASES), F.col("url")), F.col("url")),
        "image_url": resolve_url(X.first_alias(record, K.IMAGE_ALIASES), F.col("url")),
        "old_price": X.clean_price(X.first_alias(record, K.OLD_PRICE_ALIASES)),
        "currency": F.coalesce(_entry(record, "currency"), F.lit("VND")),
        "_category": F.coalesce(_entry(record, "category"), _entry(record, "normalized_category")),
        "store_address": X.blank_to_null(X.clean_text(_entry(record, "store_address"))),
        **{n: _entry(record, n) for n in ("brand", "store_name", "store_url", "store_channel", "store_phone")}})
    named = F.col("_name")
    df = computed_once(df, {
        "product_url": F.when(is_url_like(named), named).otherwise(link),
        "product_name": F.when(is_url_like(named), name_from_url(named))
        .when((named == "") & link.isNotNull(), name_from_url(link)).otherwise(named),
        "price_numeric": F.coalesce(_entry(record, "price_number").try_cast("double"), X.clean_price("_price"))})
    df = df.filter((F.col("product_name") != "") | (F.coalesce(link, F.lit("")) != ""))
    df = df.withColumn("_words", X.joined_lower(F.col("_category"), F.col("product_name"), link, F.col("domain")))
    df = df.withColumns({
        "product_id": part_id("domain", F.coalesce(X.blank_to_null(link), F.col("product_name"))),
        "category": category_of(F.col("_words")),
        "price_status": price_status("_price", F.col("price_numeric")),
        "address_status": address_status("store_address", F.col("store_channel")),
        "raw_data": F.map_filter(record, lambda k, v: ~k.isin("store_id", "price_number"))})
    return df.withColumns({"canonical_name": F.col("product_name"), "price": F.col("price_numeric"),
                           "normalized_category": F.col("category")}).drop("_name", "_price", "_category", "_words")


def attach_store_config(pages: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Pages with their source's id and store settings, joined on the bare domain."""
    if sources is None:
        return pages.withColumns({
            "source_id": F.lit(None).cast("string"),
            "store_config": F.struct(*[F.lit("site" if n == "store_scope" else None).cast("string").alias(n) for n in STORE_CONFIG])})
    config = sources.select(
        without_www("domain").alias("config_domain"), "source_id",
        F.struct(*[F.col(n).cast("string").alias(n) for n in STORE_CONFIG]).alias("store_config"))
    return pages.join(broadcast_if_small(config), without_www(pages["domain"]) == F.col("config_domain"), "left").drop("config_domain")


def stores_of_pages(chosen: DataFrame) -> DataFrame:
    """Store rows of the pages; a row without an address is no store."""
    rows = with_item(chosen.select("raw_page_id", "domain", "url", "source_id", exploded("store_rows").alias("row")), "row")
    record = F.col("row")["record"]
    address = X.clean_text(X.first_alias(record, K.STORE_ADDRESS_ALIASES))
    name = X.clean_text(X.first_alias(record, K.STORE_NAME_ALIASES))
    link = F.coalesce(resolve_url(X.first_alias(record, K.STORE_URL_ALIASES), F.col("url")), F.col("url"))
    channel = _entry(record, "store_channel")
    return rows.filter(address != "").select(
        part_id("source_id", "domain", name, address, link).alias("store_location_id"),
        F.coalesce(X.blank_to_null(name), link).alias("store_name"), address.alias("store_address"),
        address_status(address, channel).alias("address_status"), channel.alias("store_channel"),
        X.clean_text(X.first_alias(record, K.STORE_PHONE_ALIASES)).alias("store_phone"), link.alias("store_url"),
        "domain", "source_id", "raw_page_id", record.alias("raw_data"))


def products_of_pages(chosen: DataFrame, as_of: Column, method: str = "rule", model: Column | None = None,
                      score: Column | None = None) -> DataFrame:
    """Product rows of the pages, with store fields filled in for single-store sites.

    The fill comes from the source's settings or else from the first store on the same page, read
    from the page's own array, so it needs no window over pages.
    """
    origin = "crawled" if method == "rule" else "ai_extracted"
    config, store = F.col("store_config"), F.col("_store")
    site_wide = F.lower(F.coalesce(X.blank_to_null(config["store_scope"]), F.lit("site"))) == "site"
    set_up = F.coalesce(*[X.blank_to_null(config[n]) for n in STORE_CONFIG[1:]]).isNotNull()
    chosen = chosen.withColumn("_store", F.get(F.filter(
        "store_rows", lambda r: X.clean_text(X.first_alias(r["record"], K.STORE_ADDRESS_ALIASES)) != ""), 0)["record"])
    chosen = chosen.withColumn("_store_link", F.when(store.isNotNull(), F.coalesce(
        resolve_url(X.first_alias(store, K.STORE_URL_ALIASES), F.col("url")), F.col("url"))))
    page_value = {
        "store_name": F.coalesce(X.blank_to_null(X.clean_text(X.first_alias(store, K.STORE_NAME_ALIASES))), F.col("_store_link")),
        "store_url": F.col("_store_link"),
        "store_address": X.clean_text(X.first_alias(store, K.STORE_ADDRESS_ALIASES)),
        "store_phone": X.clean_text(X.first_alias(store, K.STORE_PHONE_ALIASES)),
        "store_channel": _entry(store, "store_channel"),
    }
    fills = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n).alias("k"), X.blank_to_null(F.when(site_wide, F.when(set_up, config[n]).otherwise(v))).alias("v"))
        for n, v in page_value.items()]), lambda e: e["v"].isNotNull()))
    fill_sources = F.map_from_entries(F.array(*[
        F.struct(F.lit(n), F.when(X.blank_to_null(config[n]).isNotNull(), "source_config").otherwise("site_metadata"))
        for n in page_value]))
    rows = with_item(chosen.select(
        "raw_page_id", "domain", "url", "source_id", "content_hash", "rule_version",
        fills.alias("fills"), fill_sources.alias("fill_sources"), exploded("product_rows").alias("row")), "row")
    own = F.map_filter(F.col("row")["record"], lambda k, v: F.coalesce(v, F.lit("")) != "")
    row_sources = F.map_filter(F.col("row")["sources"], lambda k, v: F.map_contains_key(own, k))
    rows = rows.withColumns({
        "record": F.map_concat(F.map_filter("fills", lambda k, v: ~F.map_contains_key(own, k)), own),
        "traces": F.map_concat(F.map_filter("fill_sources", lambda k, v: F.map_contains_key(F.col("fills"), k) & ~F.map_contains_key(own, k)), row_sources),
        "row_no": F.col("row")["row_no"]})
    rows = with_payload(rows)
    filled = lambda n: X.blank_to_null(F.col(n).cast("string")).isNotNull()
    sources = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n).alias("k"), F.when(filled(n), F.coalesce(F.try_element_at("traces", F.lit(n)), F.lit(method))).alias("v"))
        for n in TRACED_FIELDS]), lambda e: e["v"].isNotNull()))
    details = F.map_filter(F.col("row")["details"], lambda k, v: k.isin(TRACED_FIELDS))
    return rows.select(
        *PAYLOAD, "domain", "source_id", "raw_page_id", "row_no",
        F.lit(origin).alias("data_origin"), F.col("raw_page_id").alias("evidence_id"), "rule_version",
        F.lit(method).alias("extraction_method"), (model if model is not None else F.lit(None).cast("string")).alias("model"),
        "content_hash", sources.alias("field_sources"), details.alias("field_details"),
        (score if score is not None else F.lit(None).cast("double")).alias("validation_score"), as_of.alias("updated_at"))


def seller_key() -> Column:
    return part_id("domain", "store_url", "store_name", "store_address", "store_phone")


def offers(products: DataFrame) -> DataFrame:
    """One offer per priced product and seller."""
    return products.filter(F.col("product_id").isNotNull() & (F.col("price_numeric") > 0)).withColumn("seller_key", seller_key()).select(
        part_id("product_id", "seller_key").alias("offer_id"), "seller_key", "product_id", "product_name", "product_url",
        "price_numeric", F.coalesce("currency", F.lit("VND")).alias("currency"), "store_name", "store_url", "store_address",
        "store_phone", "domain", "source_id", "raw_page_id", "updated_at")


def price_observations(products: DataFrame) -> DataFrame:
    """One observation per priced product, page and store."""
    return products.filter(F.col("product_id").isNotNull() & (F.col("price_numeric") > 0)).select(
        part_id("product_id", "raw_page_id", price_part(F.col("price_numeric")), "store_url", "store_name").alias("observation_id"),
        "product_id", "price_numeric", F.coalesce("currency", F.lit("VND")).alias("currency"), "domain", "source_id",
        "raw_page_id", "rule_version", "data_origin", F.col("updated_at").alias("observed_at"))


def records_as_pages(records: DataFrame) -> DataFrame:
    """Parsed model records (one per row) grouped onto their page in the shape of chosen rows.

    Needs raw_page_id, domain, url, entity_type and a record map. Each record stays its own row:
    store records are routed to store_rows, everything else to product_rows.
    """
    row = F.array(F.struct(
        F.lit(0).alias("row_no"), F.col("record"), F.map_filter("record", lambda k, v: F.lit(False)).alias("sources"),
        F.lit(None).cast("map<string,struct<source:string,selector:string,attr:string,transform:string,raw_value:string,normalized_value:string>>").alias("details")))
    is_store = F.lower(X.clean_text("entity_type")) == "store"
    none = F.filter(row, lambda r: F.lit(False))
    return records.withColumns({
        "product_rows": F.when(is_store, none).otherwise(row), "store_rows": F.when(is_store, row).otherwise(none),
        "content_hash": F.lit(None).cast("string"), "rule_version": F.lit(None).cast("string")})


def publishable_reviews(reviews: DataFrame, as_of: Column) -> DataFrame:
    """Product payloads of approved product reviews, marked as coming from review."""
    ready = reviews.filter((F.col("status") == "approved") & (F.lower("entity_type") != "store"))
    return with_payload(ready).select(*PAYLOAD, "domain", "raw_page_id", "source_id", F.lit("ai_extracted").alias("data_origin"),
                       F.col("raw_page_id").alias("evidence_id"), F.lit("ai_review").alias("extraction_method"), "model",
                       F.lit(None).cast("string").alias("rule_version"),
                       F.col("confidence").alias("validation_score"), as_of.alias("updated_at"))


def review_rows(items: DataFrame) -> DataFrame:
    """Review-queue rows of parsed items (domain, raw_page_id, url, place, item struct).

    The id hashes domain, page, type, place, name and URL, so a repeated parse gives the same rows.
    """
    item = F.col("item")
    payload = F.struct(*[item[n].alias(n) for n in ("name", "url", "price", "currency", "store_name", "store_url", "image_url", "confidence", "reason")],
                       item["address"].alias("store_address"), item["phone"].alias("store_phone"))
    key = F.to_json(F.struct("domain", item["entity_type"].alias("entity_type"), (F.col("place") + 1).alias("index"), item["name"].alias("name"),
                             F.coalesce("raw_page_id", F.lit("")).alias("raw_page_id"), item["url"].alias("url")))
    return items.select(
        text_hash(key).alias("review_id"), "domain", "raw_page_id", F.col("url").alias("raw_page_url"), item["entity_type"].alias("entity_type"),
        payload.alias("payload"), item["confidence"].alias("confidence"), item["reason"].alias("reason"),
        F.coalesce(X.blank_to_null(item["review_status"]), F.lit("needs_review")).alias("status"), F.lit("").alias("note"))
