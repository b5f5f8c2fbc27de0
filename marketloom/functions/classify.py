"""Classifying columns: categories, statuses, page classes, labels. CASE expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import blank_to_null, clean_text, col, contains_any, joined_lower, let
from .urls import authority, path, without_www


def _first_label(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    cases = reduce(lambda acc, rule: acc.when(contains_any(text, rule[1]), rule[0]), rules[1:],
                   F.when(contains_any(text, rules[0][1]), rules[0][0]))
    return cases.otherwise(default)


def category(*values: Column, rules: list[tuple[str, list[str]]] | None = None, whole_words: bool = False) -> Column:
    """Category of the first rule with a keyword inside the joined, lowered values.

    Keywords match as substrings; ``whole_words`` asks for word bounds instead.
    """
    return category_of(joined_lower(*values), rules, whole_words)


def category_of(text: Column, rules: list[tuple[str, list[str]]] | None = None, whole_words: bool = False) -> Column:
    """:func:`category` of text that is joined and lowered already, as a column of its own."""
    rules = rules or K.CATEGORY_KEYWORDS
    if not whole_words:
        return _first_label(text, rules, K.DEFAULT_CATEGORY)
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return _first_label(padded, [(name, [f" {word} " for word in words]) for name, words in rules], K.DEFAULT_CATEGORY)


def source_group(value: Column | str) -> Column:
    return _first_label(F.lower(F.coalesce(col(value), F.lit(""))), K.SOURCE_GROUP_KEYWORDS, K.DEFAULT_SOURCE_GROUP)


def address_status(address: Column | str, channel: Column) -> Column:
    return F.when(clean_text(address) != "", "FOUND").when(channel == "online", "NOT_APPLICABLE").otherwise("MISSING")


def price_status(text: Column | str, price: Column) -> Column:
    words = F.lower(clean_text(text))
    return F.when(price > 0, "FOUND").when(contains_any(words, K.CONTACT_WORDS), "CONTACT").otherwise("MISSING")


def _html_leaf_in_folder(page: Column) -> Column:
    """``.html`` page three or more levels deep that is not under a product folder."""
    depth = F.length(page) - F.length(F.replace(page, F.lit("/"), F.lit("")))
    return page.rlike(r"\.html?$") & (depth >= 3) & ~contains_any(page, K.PRODUCT_PATH_WORDS)


def _lower_path(url: Column | str) -> Column:
    return F.regexp_replace(path(F.lower(clean_text(url))), "/+$", "")


_PRODUCT_INDEX = r"/(?:products|san-pham)(?:/[^/.]+)?$"


def extraction_target(page_type: Column | str, url: Column | str) -> Column:
    """Which rule section applies to a page: stores, listing, product_detail or NULL."""
    kind, page = F.lower(clean_text(page_type)), _lower_path(url)
    return (
        F.when(contains_any(page, K.STORE_PATH_WORDS) | contains_any(kind, K.STORE_TYPE_WORDS), "stores")
        .when(contains_any(page, K.LISTING_PATH_WORDS) | _html_leaf_in_folder(page), "listing")
        .when(contains_any(kind, K.LISTING_TYPE_WORDS), "listing")
        .when(contains_any(kind, K.DETAIL_TYPE_WORDS), "product_detail")
        .when(page.rlike(_PRODUCT_INDEX), "listing")
        .when(page.contains("/product/") | page.rlike(r"\.html?$"), "product_detail")
    )


def page_class(page_type: Column | str, url: Column | str) -> Column:
    """Class of a stored page for sampling: store_listing, listing, product_detail, unknown."""
    kind, page = F.lower(clean_text(page_type)), _lower_path(url)
    return (
        F.when(F.lower(clean_text(url)).contains("listcategory"), "unknown")
        .when(contains_any(page, K.STORE_PATH_WORDS), "store_listing")
        .when(contains_any(page, K.LISTING_PATH_WORDS) | _html_leaf_in_folder(page), "listing")
        .when(contains_any(kind, K.LISTING_TYPE_WORDS), "listing")
        .when(contains_any(kind, K.DETAIL_TYPE_WORDS), "product_detail")
        .when(page.contains("/product/") | page.rlike(r"\.html?$"), "product_detail")
        .when(page.rlike(_PRODUCT_INDEX), "listing")
        .otherwise("unknown")
    )


def capture_class(url: Column | str, depth: Column, product_blocks: Column, has_product_jsonld: Column) -> Column:
    """Class given at capture time, from the page's content first and its path second."""
    page = _lower_path(url)
    return (
        F.when(page.contains("listcategory"), "discovered")
        .when(product_blocks >= 2, "listing")
        .when(has_product_jsonld, "product_detail")
        .when(contains_any(page, K.LISTING_PATH_WORDS) | _html_leaf_in_folder(page) | page.rlike(_PRODUCT_INDEX), "listing")
        .when(page.contains("/product/") | page.rlike(r"\.html?$"), "product_detail")
        .when(depth == 0, "entry").otherwise("discovered")
    )


def looks_dynamic(html: Column | str) -> Column:
    """Page that likely needs script rendering: framework marks, or little text and few links."""
    text = F.lower(col(html))
    links = (F.length(text) - F.length(F.replace(text, F.lit("<a "), F.lit("")))) / 3
    visible = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"^\s+|\s+$", ""))
    return contains_any(text, K.SCRIPT_RENDER_MARKS) | ((F.length(visible) < 500) & (links < 5))


def valid_product_name(name: Column | str) -> Column:
    return let(clean_text(name), lambda text: F.length(text).between(3, 300) & ~text.rlike("(?i)^https?://") & ~F.lower(text).isin(K.GENERIC_NAMES))


def valid_product_url(url: Column | str, domain: Column | str) -> Column:
    return let(clean_text(url), lambda text: text.rlike("^https?://") & (authority(text) != "")
               & (without_www(authority(text)) == without_www(domain)) & ~path(text).isin("", "/"))


_STATUS_LABELS = {
    "pending": "Pending", "running": "Processing", "processing": "Processing",
    "done": "Completed", "completed": "Completed", "failed": "Failed",
}


def job_label(status: Column | str) -> Column:
    text = F.lower(F.coalesce(blank_to_null(col(status)), F.lit("pending")))
    known = reduce(lambda acc, kv: acc.when(text == kv[0], kv[1]), list(_STATUS_LABELS.items())[1:],
                   F.when(text == "pending", "Pending"))
    return known.otherwise(F.initcap(text))


def job_bucket(status: Column | str) -> Column:
    """Counting bucket of a task status: running counts as processing, done as completed."""
    text = col(status)
    return F.when(text == "running", "processing").when(text == "done", "completed").otherwise(text)


def target_hint(value: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(blank_to_null(col(value)), F.lit("auto"))))
    return (F.when(text == "product_listing", "listing").when(text.isin("store_listing", "store_detail"), "stores")
            .when(text == "detail", "product_detail").when(text == "", "auto").otherwise(text))


def cooldown_seconds(error: Column | str) -> Column:
    text = F.lower(F.coalesce(col(error), F.lit("")))
    return (F.when(contains_any(text, ["429", "too many requests", "quota"]), 1800)
            .when(contains_any(text, ["503", "high demand", "unavailable"]), 600).otherwise(300))
