"""Pages x rules -> rows: one distributed pass over the HTML, everything after it in Catalyst.

The pass reads each page once and returns one output row per page (arrays of raw field values), so
no shuffle is needed to choose between rule rows, JSON-LD rows and fallbacks. Transforms, link
resolution, tier choice and provenance are column expressions.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as K
from ..functions import text as X
from ..functions.classify import extraction_target
from ..functions.ids import text_hash
from ..functions.urls import without_www
from ..session import broadcast_if_small
from .dom import Page, selector_gaps

FIELD = "struct<name:string,selector:string,attr:string,required:boolean,transform:string>"
SECTION = f"struct<item_selector:string,fields:array<{FIELD}>>"
STRUCTURE = f"struct<listing:{SECTION},product_detail:{SECTION},stores:{SECTION}>"
RAW_FIELD = "struct<name:string,selector:string,attr:string,transform:string,raw:string,link:string>"
RAW_ROWS = f"array<struct<row_no:int,fields:array<{RAW_FIELD}>>>"
RECORDS = "array<map<string,string>>"
CONTEXT = (
    "struct<jsonld_brand:string,node_brand:string,label_brand:string,jsonld_store:string,site_name:string,"
    "title:string,jsonld_url:string,canonical_url:string,jsonld_phone:string,tel:string,text_phone:string,"
    "jsonld_address:string,node_address:string>"
)
TARGETS = ["listing", "product_detail", "stores"]
_GENERIC = {t: {"item_selector": s, "fields": [dict(zip(("name", "selector", "attr", "transform"), f[:4])) for f in fields]}
            for t, s, fields in K.GENERIC_RULES}
_PHONE = re.compile(K.PHONE_PATTERN)
_LINK_FIELDS = frozenset(K.URL_ALIASES + K.IMAGE_ALIASES + K.STORE_URL_ALIASES)


def _joined(base: str, link) -> str | None:
    """Absolute form of a link, NULL where it is no address at all."""
    try:
        return urljoin(base, _text_of(link) or "")
    except ValueError:
        return None


def _raw_value(page: Page, scope: int, field: dict) -> str | None:
    node = page.first(field.get("selector") or "", scope)
    if node is None:
        return None
    attr = field.get("attr")
    if not attr:
        return page.text(node)
    value = page.attrs[node].get(attr)
    return page.attrs[node].get("src") if value is None and attr == "data-src" else value


def _read_field(page: Page, scope: int, field: dict) -> dict:
    """Raw value of a field, with its absolute form when the field holds a link."""
    name, attr, raw = field["name"].strip(), field.get("attr"), _raw_value(page, scope, field)
    link = raw is not None and (attr in ("href", "src") or name in _LINK_FIELDS)
    return {"name": name, "selector": field.get("selector"), "attr": attr, "transform": field.get("transform"),
            "raw": raw, "link": _joined(page.url, " ".join(raw.split())) if link else None}


def section_rows(page: Page, section: dict | None) -> list[dict]:
    """Raw field values per item of a rule section; the whole page is the item if none is named."""
    # Of fields with one name the last counts.
    fields = list({f["name"].strip(): f for f in (section or {}).get("fields") or [] if f and (f.get("name") or "").strip()}.values())
    if not fields:
        return []
    item = section.get("item_selector")
    scopes = page.select(item) if item else [0]
    return [{"row_no": i, "fields": [_read_field(page, scope, f) for f in fields]} for i, scope in enumerate(scopes)]


def _jsonld_nodes(page: Page) -> Iterator[dict]:
    """Objects of all JSON-LD scripts, walked through the linking keys, depth first."""
    for node in page.select("script[type='application/ld+json']"):
        try:
            stack = [json.loads(page.attrs[node].get("#code") or "{}")]
        except (ValueError, RecursionError):  # no JSON, or nested too deep to read
            continue
        while stack:
            value = stack.pop()
            if isinstance(value, list):
                stack.extend(reversed(value))
            elif isinstance(value, dict):
                yield value
                stack.extend(value.get(k) for k in ("hasOfferCatalog", "mainEntity", "itemListElement", "@graph"))


def _text_of(value) -> str | None:
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("url")
    return None if value is None else str(value)


def jsonld_records(page: Page) -> tuple[list[dict], list[dict]]:
    """Product and store records found in the page's JSON-LD."""
    products, stores = [], []
    for node in _jsonld_nodes(page):
        kinds = node.get("@type")
        kinds = {str(k or "").strip().lower() for k in (kinds if isinstance(kinds, list) else [kinds])}
        if "product" in kinds:
            offer = node.get("offers") if isinstance(node.get("offers"), dict) else {}
            price = offer.get("price") or node.get("price")
            number = isinstance(price, (int, float)) and not isinstance(price, bool)
            products.append({
                "product_name": _text_of(node.get("name")), "product_url": _joined(page.url, node.get("url")),
                "image_url": _text_of(node.get("image")), "price": None if price is None else str(price),
                "price_number": str(float(price)) if number else None,
                "currency": _text_of(offer.get("priceCurrency")), "brand": _text_of(node.get("brand"))})
        if kinds & {"localbusiness", "store", "organization"}:
            address = node.get("address")
            if isinstance(address, dict):
                parts = [address.get(k) for k in ("streetAddress", "addressLocality", "addressRegion")]
                address = ", ".join(" ".join(str(p).split()) for p in parts if p)
            stores.append({"store_name": _text_of(node.get("name")), "store_address": _text_of(address),
                           "store_phone": _text_of(node.get("telephone")), "store_url": _joined(page.url, node.get("url"))})
    return products, stores


def _labelled(page: Page, words: tuple[str, ...]) -> str | None:
    """Text of the value cell that follows a label cell holding one of the words."""
    for node in page.select("th, dt, .label, .attribute-label"):
        if any(w in page.text(node).lower() for w in words):
            after = page.last[node] + 1
            while after < len(page.tags) and page.parent[after] == page.parent[node]:
                if page.tags[after] in ("td", "dd", "span", "div"):
                    return page.text(after)
                after = page.last[after] + 1
    return None


def page_facts(page: Page, products: list[dict], stores: list[dict]) -> dict:
    """Candidate values for site-level fields, one per place they may stand."""
    def attr_of(selector, name):
        node = page.first(selector)
        return None if node is None else page.attrs[node].get(name)

    def text_of(selector):
        node = page.first(selector)
        return None if node is None else page.text(node)

    store = next((s for s in stores if s["store_name"] or s["store_address"] or s["store_phone"]), {})
    brand = page.first("[itemprop='brand'], meta[property='product:brand'], meta[name='brand']")
    site = next(filter(None, (attr_of(f"meta[property='{k}'], meta[name='{k}']", "content")
                              for k in ("og:site_name", "application-name"))), None)
    tel = page.first("a[href^='tel:'], [itemprop='telephone']")
    footer, canonical = page.first("footer"), attr_of("link[rel='canonical']", "href")
    phone = _PHONE.search(page.text(0 if footer is None else footer))
    return {
        "jsonld_brand": next((p["brand"] for p in products if p["brand"]), None),
        "node_brand": None if brand is None else page.attrs[brand].get("content") or page.text(brand),
        "label_brand": _labelled(page, ("thương hiệu", "brand")),
        "jsonld_store": store.get("store_name"), "site_name": site, "title": text_of("title"),
        "jsonld_url": store.get("store_url"), "canonical_url": None if canonical is None else _joined(page.url, canonical),
        "jsonld_phone": store.get("store_phone"),
        "tel": None if tel is None else re.sub("^tel:", "", page.attrs[tel].get("href", "")),
        "text_phone": phone.group(0) if phone else None,
        "jsonld_address": store.get("store_address"),
        "node_address": text_of("address, [itemprop='address'], .store-address, .contact-address, .address"),
    }


def _located_stores(page: Page, cards: dict | None) -> list[dict]:
    """Stores of a locator page: a card list, or addresses in a script, as the locator rule says."""
    found = []
    if not cards:
        return found
    for item in page.select(cards.get("item_selector") or ""):
        name = page.first(cards.get("name_selector") or "", item)
        lines = [page.text(n) for n in page.select(cards.get("line_selector") or "", item)]
        lines = [x for x in lines if x and x.lower() not in ("view map", "xem vị trí")]
        address = next((x for x in lines if not _PHONE.search(x)), "")
        if address:
            found.append({"store_name": (page.text(name) if name is not None else "") or cards.get("default_name"),
                          "store_address": entities.unescape(address),
                          "store_phone": next((x for x in lines if _PHONE.search(x)), ""), "store_url": page.url})
    if cards.get("script_pattern"):
        for address in re.findall(cards["script_pattern"], page.source):
            address = " ".join(entities.unescape(address).split())
            if address:
                found.append({"store_name": cards.get("default_name"), "store_address": address, "store_url": page.url})
    return found


LOCATOR = "struct<item_selector:string,name_selector:string,line_selector:string,script_pattern:string,default_name:string>"
# Locator rules of known chains, keyed by bare domain (fixed values).
KNOWN_LOCATORS = [
    ("gs25.com.vn", (".box-store-list .item", ".left span, .left", ".right p", None, "GS25")),
    ("circlek.com.vn", (None, None, None, r"(?i)setMarkers\([^)]*?,'([^']+)','<div", "Circle K")),
]
_OUTPUT = (
    f"listing {RAW_ROWS}, product_detail {RAW_ROWS}, stores {RAW_ROWS}, jsonld_products {RECORDS}, jsonld_stores {RECORDS}, "
    f"generic_listing {RAW_ROWS}, generic_detail {RAW_ROWS}, generic_stores {RAW_ROWS}, located_stores {RECORDS}, context {CONTEXT}, read_error string"
)


def rules_from_structures(rules: DataFrame) -> DataFrame:
    """Rules as (bare domain, structure, rule version, allowed targets), one per domain."""
    columns = rules.columns
    targets = F.array(*[F.lit(t) for t in TARGETS])
    return rules.select(
        without_www("domain").alias("rule_domain"), F.col("structure").cast(STRUCTURE).alias("structure"),
        (F.col("version") if "version" in columns else F.lit(None).cast("string")).alias("rule_version"),
        (F.col("allowed_targets") if "allowed_targets" in columns else targets).alias("allowed_targets"))


def _by_bytes(batch: pa.RecordBatch, most: int = 8 << 20, pages: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of HTML and at most so many pages, so that what a worker holds of rules and rows does not grow with the batch."""
    sizes = [len(v) if v is not None else 0 for v in (x.as_buffer() if x.is_valid else None for x in batch.column(batch.schema.get_field_index("html")))]
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most or i - start == pages):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def read_pages(pages: DataFrame, rules: DataFrame, generic: bool = True, locators: DataFrame | None = None, facts: bool = True) -> DataFrame:
    """Run each page's rule over its HTML. Needs raw_page_id, domain, url, page_type, html.

    Without ``facts`` only the rule's own sections are read, as trying a rule needs: JSON-LD is empty and the context NULL.

    Rules are a registry-sized table: they are broadcast only when their size estimate is under
    the limit; otherwise the join shuffles and AQE splits a hot domain.
    """
    spark = pages.sparkSession
    if locators is None:
        locators = spark.createDataFrame([(d, l) for d, l in KNOWN_LOCATORS], f"locator_domain string, locator {LOCATOR}")
    keep = [c for c in pages.columns if c != "html"]
    configured = F.filter(
        F.array(*[F.when(F.size(F.col("structure")[t]["fields"]) > 0, F.lit(t)) for t in TARGETS[:2]]), lambda t: t.isNotNull())
    # A page carries its rule as one text, which a worker parses once and not for every page.
    texts = rules_from_structures(rules).withColumns({"configured_targets": configured, "structure": F.to_json("structure")})
    prepared = (
        pages.withColumn("content_hash", text_hash(F.col("html")))
        .withColumn("rule_domain", without_www("domain"))
        .join(broadcast_if_small(texts), "rule_domain", "left")
        .join(broadcast_if_small(locators), F.col("rule_domain") == F.col("locator_domain"), "left")
        .withColumn("configured_targets", F.coalesce("configured_targets", F.array().cast("array<string>")))
    )
    kept = [*keep, "content_hash", "rule_version", "allowed_targets", "configured_targets"]
    prepared = prepared.select(*kept, "html", "structure", "locator")
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.select(*kept).schema)
    schema = f"{passed}, {_OUTPUT}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_bytes(whole)):
            found = [_read_one(*page, generic, facts) for page in zip(
                *[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("html", "url", "structure", "locator")])]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            columns += [pa.array([f[field.name] for f in found], field.type) for field in list(arrow)[len(kept):]]
            columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return prepared.mapInArrow(run, schema)


_NOTHING = {c: [] for c in ("listing", "product_detail", "stores", "jsonld_products", "jsonld_stores", "generic_listing", "generic_detail", "generic_stores", "located_stores")}


@lru_cache(maxsize=256)
def _parsed_rule(text: str | None) -> tuple[dict, list[str]]:
    """A rule's structure with the parts of its selectors that are not understood."""
    structure = json.loads(text) if text else {}
    return structure, _rule_gaps(structure)


def _read_one(html: str | None, url: str | None, rule: str | None, locator: dict | None, generic: bool, facts: bool = True) -> dict:
    """What one page gives; a page that cannot be read gives no rows and says why, and the others go on."""
    try:
        return _read_page(html, url, *_parsed_rule(rule), locator, generic, facts)
    except Exception as problem:  # noqa: BLE001  any page may be anything
        return {**_NOTHING, "context": None, "read_error": f"{type(problem).__name__}: {problem}"}


def _rule_gaps(structure: dict) -> list[str]:
    sections = [s for s in structure.values() if isinstance(s, dict)]
    selectors = [s.get("item_selector") for s in sections] + [f.get("selector") for s in sections for f in s.get("fields") or [] if f]
    return sorted({g for s in selectors for g in selector_gaps(s)})


def _read_page(html: str | None, url: str | None, structure: dict, gaps: list[str], locator: dict | None, generic: bool, facts: bool) -> dict:
    page = Page(html or "", url or "")
    problems = [p for p in (page.error, "unsupported selector: " + " , ".join(gaps) if gaps else None) if p]
    products, stores = jsonld_records(page) if facts and "application/ld+json" in (html or "") else ([], [])
    out = {t: section_rows(page, structure.get(t)) for t in TARGETS}
    as_map = lambda rows: [[(k, v) for k, v in r.items() if v is not None] for r in rows]
    out.update(
        jsonld_products=as_map(products), jsonld_stores=as_map(stores),
        generic_listing=section_rows(page, _GENERIC["listing"]) if generic else [],
        generic_detail=section_rows(page, _GENERIC["product_detail"]) if generic else [],
        generic_stores=section_rows(page, _GENERIC["stores"]) if generic else [],
        located_stores=as_map(_located_stores(page, locator)) if generic else [],
        context=page_facts(page, products, stores) if facts else None, read_error="; ".join(problems) or None)
    return out


# --- field transforms -----------------------------------------------------------------------

def price_digits(value: Column) -> Column:
    return X.clean_price(value).cast("decimal(38,0)").cast("string")


# Transform name -> builder of the transformed text of a cleaned value.
TRANSFORMS = {
    "text_content": lambda v: v,
    "clean_price": price_digits,
    "extract_percentage": X.percentage,
    "extract_volume_ml": lambda v: X.volume_ml(v).cast("string"),
    "check_for_sold_out_indicator": X.stock_status,
    "extract_rating_from_html_attributes_or_classes": lambda v: X.float_text(X.rating_number(v)),
    "extract_review_count_from_html_attributes_or_classes": lambda v: X.review_count(v).cast("string"),
}


def field_value(field: Column) -> Column:
    """Value of one raw field: links as resolved, prices to digits, named transforms applied."""
    name, transform = (F.coalesce(field[n], F.lit("")) for n in ("name", "transform"))
    value = X.clean_text(F.coalesce(field["link"], field["raw"]))
    out = F.when((transform == "clean_price") | name.isin(*K.PRICE_ALIASES, *K.OLD_PRICE_ALIASES), price_digits(value))
    for key, build in TRANSFORMS.items():
        if key not in ("clean_price", "text_content"):
            out = out.when(transform == key, build(value))
    return F.when(field["raw"].isNotNull(), out.otherwise(value))


DETAIL = "struct<source:string,selector:string,attr:string,transform:string,raw_value:string,normalized_value:string>"


def finished_rows(rows: Column) -> Column:
    """Raw rows to structs of (row_no, record map, details map); rows with no value are dropped."""
    def finish(row: Column) -> Column:
        valued = F.filter(
            F.transform(row["fields"], lambda f: F.struct(
                f["name"].alias("name"), X.blank_to_null(field_value(f)).alias("value"), f["selector"].alias("selector"),
                f["attr"].alias("attr"), f["transform"].alias("transform"), X.clean_text(f["raw"]).alias("raw"))),
            lambda f: f["value"].isNotNull())
        return F.struct(row["row_no"].alias("row_no"), valued.alias("fields"))

    def shape(row: Column) -> Column:
        fields = row["fields"]
        details = F.transform(fields, lambda f: F.struct(f["name"], F.struct(
            F.lit("selector").alias("source"), f["selector"].alias("selector"), f["attr"].alias("attr"),
            f["transform"].alias("transform"), f["raw"].alias("raw_value"), f["value"].alias("normalized_value"))))
        return F.struct(
            row["row_no"].alias("row_no"),
            F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], f["value"]))).alias("record"),
            F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], F.lit("selector")))).alias("sources"),
            F.map_from_entries(details).alias("details"))

    return F.transform(F.filter(F.transform(rows, finish), lambda r: F.size(r["fields"]) > 0), shape)


def finished_records(rows: Column) -> Column:
    """The record maps of :func:`finished_rows` alone, where nothing else of the rows is wanted."""
    def record(row: Column) -> Column:
        values = F.transform(row["fields"], lambda f: F.struct(f["name"].alias("name"), X.blank_to_null(field_value(f)).alias("value")))
        return F.map_from_entries(F.filter(values, lambda f: f["value"].isNotNull()))

    return F.filter(F.transform(rows, record), lambda r: F.size(r) > 0)


ROWS = f"array<struct<row_no:int,record:map<string,string>,sources:map<string,string>,details:map<string,{DETAIL}>>>"


def record_rows(records: Column, source: str) -> Column:
    """Plain records (JSON-LD, locator, page metadata) in the same shape as rule rows."""
    return F.transform(records, lambda r, i: F.struct(
        i.cast("int").alias("row_no"), r.alias("record"), F.transform_values(r, lambda k, v: F.lit(source)).alias("sources"),
        F.lit(None).cast(f"map<string,{DETAIL}>").alias("details")))


def with_context(read: DataFrame) -> DataFrame:
    """Replace the candidate struct by site-level fields: JSON-LD, then marked nodes, then text."""
    c = F.col("context")
    pick = lambda *names: F.coalesce(*[X.blank_to_null(X.clean_text(c[n])) for n in names])
    root = r"^([a-zA-Z]+://[^/?#]+)"
    read = read.withColumns({
        "_root": F.concat(F.coalesce(X.blank_to_null(F.regexp_extract("url", root, 1)), F.concat(F.lit("https://"), F.col("domain"))), F.lit("/")),
        "_link": pick("jsonld_url", "canonical_url")})
    deep = ~F.regexp_extract("_link", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).isin("", "/")
    title = F.regexp_extract(X.clean_text(c["title"]), r"^(.*?)(?:\s+[|\-–]\s+.*)?$", 1)
    return read.withColumn("context", F.struct(
        pick("jsonld_brand", "node_brand", "label_brand").alias("brand"),
        F.coalesce(pick("jsonld_store", "site_name"), X.blank_to_null(title), F.col("domain")).alias("store_name"),
        F.coalesce(F.when(deep, F.col("_root")), F.col("_link"), F.col("_root")).alias("store_url"),
        F.coalesce(pick("jsonld_address", "node_address"), F.lit("")).alias("store_address"),
        F.coalesce(pick("jsonld_phone", "tel", "text_phone"), F.lit("")).alias("store_phone"))).drop("_root", "_link")


def choose_rows(read: DataFrame, generic: bool = True) -> DataFrame:
    """Per page, keep the rows of the first tier that has any and back-fill the brand.

    Adds product_rows and store_rows (arrays of row_no, record, sources, details) and context.
    """
    target = F.col("page_target")
    nothing = F.array().cast(ROWS)
    raw_columns = ["listing", "product_detail", "stores"]
    records = {"jsonld_products": "jsonld", "jsonld_stores": "jsonld"}
    if generic:
        raw_columns += ["generic_listing", "generic_detail", "generic_stores"]
        records["located_stores"] = "selector"
    df = with_context(read.withColumn("page_target", extraction_target("page_type", "url")))
    df = df.withColumns({
        **{c: finished_rows(F.col(c)) for c in raw_columns}, **{c: record_rows(F.col(c), s) for c, s in records.items()},
        "selected": F.filter("configured_targets", lambda t: F.array_contains(F.coalesce("allowed_targets", "configured_targets"), t)
                             & F.coalesce(target == t, F.lit(True)))})
    taken = [F.when(F.array_contains("selected", t), F.col(t)).otherwise(nothing) for t in TARGETS[:2]]
    df = df.withColumns({
        "product_rows": F.concat(*taken, F.when(F.size("selected") > 0, F.col("jsonld_products")).otherwise(nothing)),
        "store_rows": F.concat("stores", "jsonld_stores")})
    if generic:
        site = F.array(F.map_from_arrays(
            F.array(*[F.lit(n) for n in K.STORE_FIELDS]), F.array(*[F.col("context")[n] for n in K.STORE_FIELDS])))
        df = df.withColumn("site_rows", record_rows(site, "page_metadata"))
        first = lambda *options: F.coalesce(*[F.when(ok & (F.size(c) > 0), F.col(c)) for ok, c in options], nothing)
        yes, not_detail, not_listing = F.lit(True), F.coalesce(target != "product_detail", F.lit(True)), F.coalesce(target != "listing", F.lit(True))
        df = df.withColumns({
            "product_rows": first((yes, "product_rows"), (not_detail, "generic_listing"), (not_listing, "generic_detail")),
            "store_rows": first((yes, "store_rows"), (yes, "located_stores"), (yes, "generic_stores"), (yes, "site_rows"))}).drop("site_rows")
    brand = F.col("context")["brand"]

    def with_brand(row: Column) -> Column:
        fill = brand.isNotNull() & X.blank_to_null(F.try_element_at(row["record"], F.lit("brand"))).isNull()
        extra = lambda m, v: F.when(fill, F.map_concat(F.map_filter(m, lambda k, _: k != "brand"), F.create_map(F.lit("brand"), v))).otherwise(m)
        return F.struct(row["row_no"].alias("row_no"), extra(row["record"], brand).alias("record"),
                        extra(row["sources"], F.lit("page_metadata")).alias("sources"), row["details"].alias("details"))

    return df.withColumn("product_rows", F.transform("product_rows", with_brand)).drop(
        "listing", "product_detail", "stores", "jsonld_products", "jsonld_stores", "generic_listing", "generic_detail",
        "generic_stores", "located_stores", "selected")


class RuleRows:
    """Table function: one row per item and field of a rule section (JSON text) on a page. A section is parsed once, not for every page."""

    def __init__(self):
        self._text = self._section = None

    def eval(self, html: str, url: str, section: str):
        if html and section:
            if section != self._text:
                self._text, self._section = section, json.loads(section)
            for row in section_rows(Page(html, url or ""), self._section):
                for field in row["fields"]:
                    yield row["row_no"], field["name"], field["raw"], field["link"]


def register_rule_function(spark, name: str = "rule_rows") -> None:
    """Make ``LATERAL rule_rows(html, url, section_json)`` available to SQL."""
    spark.udtf.register(name, udtf(RuleRows, returnType="row_no int, name string, raw string, link string"))
