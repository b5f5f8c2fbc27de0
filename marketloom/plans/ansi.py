"""SQL fragments for the checks, one per column function."""

from __future__ import annotations

from .. import constants as K

SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '{SPACES}', ' ', 'g'))"


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def price(x: str) -> str:
    return rf"try_cast(nullif(regexp_replace(regexp_extract({clean(x)}, '\d[\d.,\s]*'), '\D', '', 'g'), '') AS DOUBLE)"


def joined(*values: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif(lower({clean(v)}), '')" for v in values) + ")"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def labels(x: str, rules: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, words)} THEN '{name}'" for name, words in rules) + f" ELSE '{default}' END"


def category(*values: str) -> str:
    return labels(joined(*values), K.CATEGORY_KEYWORDS, K.DEFAULT_CATEGORY)


def fold(x: str) -> str:
    return rf"trim(regexp_replace(replace(strip_accents(lower({clean(x)})), 'đ', 'd'), '[^a-z0-9.%]+', ' ', 'g'))"


def volume(text: str, pattern: str = r"(?i)(\d+(?:[.,]\d+)?)\s*(ml|l|lit|liter|lít)") -> str:
    unit = f"lower(regexp_extract({text}, '{pattern}', 2))"
    return (f"CAST(trunc(try_cast(replace({first(text, pattern)}, ',', '.') AS DOUBLE) * "
            f"CASE {unit} WHEN 'ml' THEN 1 WHEN 'cl' THEN 10 ELSE 1000 END) AS INTEGER)")


FOLDED_VOLUME = r"(\d+(?:[.,]\d+)?)\s*(ml|l|lit|liter|cl)\b"
FOLDED_ABV = r"(\d+(?:[.,]\d+)?)\s*(?:%|\bdo\b)"
FOLDED_PACK = r"\b(?:thung|hop|pack|case)\s*(\d+)|\b(\d+)\s*(?:lon|chai|hop|goi)\b"


def folded_volume(text: str) -> str:
    return volume(text, FOLDED_VOLUME)


def folded_abv(text: str) -> str:
    return f"try_cast(replace({first(text, FOLDED_ABV)}, ',', '.') AS DOUBLE)"


def folded_pack(text: str) -> str:
    return f"try_cast(coalesce({first(text, FOLDED_PACK)}, {first(text, FOLDED_PACK, 2)}) AS INTEGER)"


def core(text: str, brand: str) -> str:
    noise = "[" + ", ".join(f"'{w}'" for w in K.NAME_NOISE_WORDS) + "]"
    bare = rf"regexp_replace({text}, '\b' || regexp_replace({brand}, '([.%])', '\\\1', 'g') || '\b', ' ', 'g')"
    for p in (FOLDED_VOLUME, FOLDED_ABV, FOLDED_PACK):
        bare = f"regexp_replace({bare}, '{p}', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({bare}, ' '), lambda w: w <> '' AND NOT list_contains({noise}, w)), ' ')"


def shortest(x: str) -> str:
    return rf"regexp_replace(CAST(CAST({x} AS DECIMAL(18,6)) AS VARCHAR), '\.?0+$', '')"


def canonical_key(category_: str, brand: str, core_: str, vol: str, abv: str, pack: str) -> str:
    return (f"concat_ws('|', coalesce(nullif({category_}, ''), 'khac'), coalesce(nullif({brand}, ''), 'unknown-brand'), nullif({core_}, ''), "
            f"CASE WHEN {vol} <> 0 THEN CAST({vol} AS VARCHAR) || 'ml' END, CASE WHEN {abv} <> 0 THEN {shortest(abv)} || 'pct' END, "
            f"CASE WHEN {pack} <> 0 THEN 'pack' || CAST({pack} AS VARCHAR) END)")


def features() -> str:
    """CTE body with the canonical features of the products table."""
    return f"""SELECT *, {canonical_key('category', 'brand', 'name_core', 'volume_ml', 'abv_percent', 'pack_size')} AS canonical_key FROM (
        SELECT product_id, category, brand, t AS normalized_name, {core('t', 'brand')} AS name_core, {folded_volume('t')} AS volume_ml,
               {folded_abv('t')} AS abv_percent, {folded_pack('t')} AS pack_size
        FROM (SELECT product_id, {fold('category')} AS category, {fold('brand')} AS brand, {fold('product_name')} AS t FROM products))"""


def sha16(*parts: str) -> str:
    return "substr(sha1(concat_ws('|', " + ", ".join(f"nullif({clean(p)}, '')" for p in parts) + ")), 1, 16)"


def float_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def authority(x: str) -> str:
    return rf"regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1)"


def path(x: str) -> str:
    return rf"regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)', 1)"


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '^www\.', '')"


def lower_path(x: str) -> str:
    return f"regexp_replace({path('lower(' + clean(x) + ')')}, '/+$', '')"


def leaf_html(p: str) -> str:
    return rf"(regexp_matches({p}, '\.html?$') AND length({p}) - length(replace({p}, '/', '')) >= 3 AND NOT {any_of(p, K.PRODUCT_PATH_WORDS)})"


def title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '')"


def name_from_url(x: str) -> str:
    t = f"regexp_replace({clean(x)}, '[?#].*$', '')"
    t = f"string_split(regexp_replace({t}, '/+$', ''), '/')[-1]"
    t = rf"regexp_replace({t}, '(?i)\.(html?|php|aspx?)$', '')"
    t = f"regexp_replace({t}, '[-_]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)\b(sp|sku|id|vk)\d+\b', '', 'g')"
    return title(clean(t))


def page_class(kind: str, url: str) -> str:
    k, p = f"lower({clean(kind)})", lower_path(url)
    return (f"CASE WHEN contains(lower({clean(url)}), 'listcategory') THEN 'unknown' WHEN {any_of(p, K.STORE_PATH_WORDS)} THEN 'store_listing' "
            f"WHEN {any_of(p, K.LISTING_PATH_WORDS)} OR {leaf_html(p)} THEN 'listing' WHEN {any_of(k, K.LISTING_TYPE_WORDS)} THEN 'listing' "
            f"WHEN {any_of(k, K.DETAIL_TYPE_WORDS)} THEN 'product_detail' "
            rf"WHEN contains({p}, '/product/') OR regexp_matches({p}, '\.html?$') THEN 'product_detail' "
            f"WHEN regexp_matches({p}, '/(?:products|san-pham)(?:/[^/.]+)?$') THEN 'listing' ELSE 'unknown' END")


def target(kind: str, url: str) -> str:
    k, p = f"lower({clean(kind)})", lower_path(url)
    return (f"CASE WHEN {any_of(p, K.STORE_PATH_WORDS)} OR {any_of(k, K.STORE_TYPE_WORDS)} THEN 'stores' "
            f"WHEN {any_of(p, K.LISTING_PATH_WORDS)} OR {leaf_html(p)} THEN 'listing' WHEN {any_of(k, K.LISTING_TYPE_WORDS)} THEN 'listing' "
            f"WHEN {any_of(k, K.DETAIL_TYPE_WORDS)} THEN 'product_detail' "
            f"WHEN regexp_matches({p}, '/(?:products|san-pham)(?:/[^/.]+)?$') THEN 'listing' "
            rf"WHEN contains({p}, '/product/') OR regexp_matches({p}, '\.html?$') THEN 'product_detail' END")


HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>"


def unescape(x: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{sign}')"
    return x


def body(x: str) -> str:
    return f"regexp_replace({x}, '{HIDDEN}', ' ', 'g')"


def text_of(x: str) -> str:
    return clean(unescape(f"regexp_replace({body(x)}, '<[^>]*>', ' ', 'g')"))
