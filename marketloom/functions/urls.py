"""URL columns by regex, so that a malformed URL gives an empty part and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, clean_text, col, let, title_case

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def authority(url: Column | str) -> Column:
    """Host with its port, as written."""
    return F.regexp_extract(col(url), _AUTHORITY, 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _PATH, 1)


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (authority(url) != "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def without_www(domain: Column | str) -> Column:
    return F.regexp_replace(col(domain), r"^www\.", "")


def normalize_domain(value: Column | str) -> Column:
    """Lowered host of a domain or URL, without ``www.``."""
    text = F.lower(F.trim(F.coalesce(col(value), F.lit(""))))
    host = F.when(text.rlike("^https?://"), F.coalesce(blank_to_null(authority(text)), text)).otherwise(text)
    return without_www(host)


def same_site(left: Column | str, right: Column | str) -> Column:
    return without_www(left) == without_www(right)


def is_safe_domain(value: Column | str) -> Column:
    return F.lower(F.trim(col(value))).rlike(r"^[a-z0-9.\-]+$")


def is_url_like(value: Column | str) -> Column:
    return clean_text(value).rlike("(?i)^https?://")


def name_from_url(value: Column | str) -> Column:
    """Product name out of the last path part: extension and item codes dropped, title case."""
    text = F.regexp_replace(clean_text(value), r"[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(text, "/+$", ""), "/"), -1)
    last = F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", "")
    last = F.regexp_replace(last, r"[-_]+", " ")
    last = F.regexp_replace(last, r"(?i)\b(sp|sku|id|vk)\d+\b", "")
    return title_case(clean_text(last))


def _merge_path(text: Column) -> Column:
    """Resolve ``.`` and ``..`` parts of an absolute path, keeping a trailing slash."""
    def merge(parts: Column) -> Column:
        kept = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^/+", "/")

    return let(F.split(F.regexp_replace(text, "^/", ""), "/", -1), merge)


def resolve_url(value: Column | str, base: Column | str) -> Column:
    """Absolute form of a link on page ``base``; NULL for an empty link.

    Pure column logic: relative parts are folded with ``aggregate``, so no row leaves the JVM.
    """
    def resolve(link: Column) -> Column:
        text, page = link["text"], link["page"]
        page_path = F.regexp_extract(page, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
        target, rest = F.regexp_extract(text, r"^[^?#]*", 0), F.regexp_extract(text, r"^[^?#]*(.*)$", 1)
        folder = F.coalesce(blank_to_null(F.regexp_extract(page_path, r"^(.*/)", 1)), F.lit("/"))
        full = let(F.when(text.startswith("/"), target).otherwise(F.concat(folder, target)),
                   lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|$)"), _merge_path(p)).otherwise(p))
        return (
            F.when(text == "", F.lit(None).cast("string"))
            .when((page == "") | text.rlike(_SCHEME), text)
            .when(text.startswith("//"), F.concat(scheme(page), F.lit(":"), text))
            .when(text.startswith("?"), F.concat(origin(page), page_path, text))
            .when(text.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), text))
            .otherwise(F.concat(origin(page), full, rest))
        )

    return let(F.struct(clean_text(value).alias("text"), F.coalesce(col(base), F.lit("")).alias("page")), resolve)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_end_slash(url: Column | str) -> Column:
    return F.regexp_replace(col(url), "/+$", "")
