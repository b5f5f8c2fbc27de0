"""Queries over entity resolution and stored model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as J
from ..functions.ids import text_hash
from ..operators import payloads as D
from ..operators import resolution as R
from ..operators.components import connected_components
from ..operators.similarity import match_ratio
from ..session import cut_lineage
from . import ansi as A
from .registry import query


def _when(text):
    return F.lit(text).cast("timestamp")


# --- canonical products ---------------------------------------------------------------------

@query("i3_canonical_features", f"SELECT product_id, category, brand, normalized_name, name_core, volume_ml, abv_percent, coalesce(pack_size, -1) AS pack_size, canonical_key FROM ({A.features()})")
def _(t):
    f = R.canonical_features(t.products)
    return f.select("product_id", "category", "brand", "normalized_name", "name_core", "volume_ml", "abv_percent", F.coalesce("pack_size", F.lit(-1)).alias("pack_size"), "canonical_key")


@query("d23_similarity")
def _(t):
    n = t.products.select("pk", "product_name")
    pairs = n.join(n.select((F.col("pk") - 1).alias("pk"), F.col("product_name").alias("other")), "pk")
    return pairs.select("pk", F.round(match_ratio("product_name", "other"), 4).alias("ratio"))


_SCORES = f"""WITH f AS (SELECT *, CAST(substr(product_id, 2) AS BIGINT) AS pk FROM ({A.features()})), p AS (SELECT l.pk, l.pk % 101 / 100.0::DOUBLE AS ratio, l.category AS lc, r.category AS rc, l.brand AS lb, r.brand AS rb, l.volume_ml AS lv, r.volume_ml AS rv, l.abv_percent AS la, r.abv_percent AS ra, l.pack_size AS lp, r.pack_size AS rp FROM f l JOIN f r ON r.pk = l.pk + 25)
    SELECT pk, CASE WHEN (lc <> '' AND rc <> '' AND lc <> rc) OR coalesce(lv <> rv, false) OR coalesce(lp <> rp, false) OR coalesce(abs(la - ra) > 0.25, false) THEN 0.0 ELSE round(least(ratio * 0.6 + CASE WHEN lb <> '' AND lb = rb THEN 0.15 ELSE 0 END + CASE WHEN lv = rv AND lv <> 0 THEN 0.1 ELSE 0 END
      + CASE WHEN abs(la - ra) <= 0.25 THEN 0.05 ELSE 0 END + CASE WHEN lp = rp AND lp <> 0 THEN 0.05 ELSE 0 END + CASE WHEN lc <> '' AND lc = rc THEN 0.05 ELSE 0 END, 1.0), 3) END AS score FROM p"""


@query("i4_match_scores", _SCORES)
def _(t):
    f = R.canonical_features(t.products).withColumn("pk", F.substring("product_id", 2, 20).cast("long"))
    names = ["category", "brand", "volume_ml", "abv_percent", "pack_size"]
    side = lambda s, d: f.select((F.col("pk") - d).alias("pk"), *[F.col(n).alias(f"{s}_{n}") for n in names])
    ratio = (F.col("pk") % 101) / 100.0
    return side("left", 0).join(side("right", 25), "pk").select("pk", R.match_score(ratio).alias("score"))


_EDGES = """(SELECT p_partkey AS x, min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_size) AS y FROM part UNION SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type, p_retailprice) FROM part)"""


@query("i5_components", f"""WITH RECURSIVE e AS (SELECT x, y FROM {_EDGES} WHERE x <> y), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), reach AS (SELECT x AS a, x AS z FROM b UNION SELECT r.a, b.y FROM reach r JOIN b ON r.z = b.x)
    SELECT a AS node, min(z) AS component FROM reach GROUP BY a""")
def _(t):
    part = t.part.select("p_partkey", "p_brand", "p_name", "p_size", "p_type", "p_retailprice")

    def star(*keys):
        low = part.groupBy(*keys).agg(F.min("p_partkey").alias("low"))
        return part.join(low, list(keys)).select(F.col("p_partkey").alias("a"), F.col("low").alias("b"))

    return connected_components(star("p_brand", "p_name", "p_size").union(star("p_type", "p_retailprice")), "a", "b")


@query("i5_canonical_products")
def _(t):
    return R.canonicalize(t.products)


@query("i6_match_counts")
def _(t):
    return R.match_counts(t.products)


@query("g10_fuzzy_edges")
def _(t):
    return R.fuzzy_edges(R.profiles(R.canonical_features(t.products)))


@query("h7_representatives", f"SELECT brand, min(struct_pack(canonical_key := canonical_key, product_id := product_id)).product_id AS product_id FROM ({A.features()}) GROUP BY brand")
def _(t):
    return R.canonical_features(t.products).groupBy("brand").agg(F.min(F.struct("canonical_key", "product_id"))["product_id"].alias("product_id"))


_CANONICAL: dict = {}


def canonical(t):
    """The canonical groups of the priced products by equal keys, written once a session and folder. The fuzzy groups have no SQL form."""
    run = (t.spark.sparkContext.applicationId, t.folder)
    if run not in _CANONICAL:
        _CANONICAL[run] = cut_lineage(R.canonicalize(t.products.filter("price_numeric IS NOT NULL"), min_score=None))
    return _CANONICAL[run]


#: The same groups in SQL: an id is made of the key.
CANONICAL = f"(SELECT product_id, canonical_key, 'cp_' || substr(sha1(canonical_key), 1, 20) AS canonical_product_id FROM ({A.features()}) WHERE product_id IN (SELECT product_id FROM products WHERE price_numeric IS NOT NULL))"


@query("i7_propagation", f"SELECT p.product_id, canonical_product_id, canonical_key, CASE WHEN canonical_key IS NOT NULL THEN 1.0 END AS score FROM products p LEFT JOIN {CANONICAL} c USING (product_id)")
def _(t):
    return R.propagate(t.products, canonical(t), _when("2024-06-01")).select("product_id", "canonical_product_id", "canonical_key", F.col("canonical_match_score").alias("score"))


@query("g6_offer_propagation", f"SELECT o.product_id, canonical_product_id, count(*) AS offers FROM offers o LEFT JOIN {CANONICAL} c ON o.product_id = c.product_id GROUP BY 1, 2")
def _(t):
    return R.propagate(t.offers, canonical(t), _when("2024-06-01")).groupBy("product_id", "canonical_product_id").agg(F.count("*").alias("offers"))


@query("i6_run_counters", f"""SELECT (SELECT count(*) FROM {CANONICAL}) AS products_scanned, (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT count(*) AS n FROM {CANONICAL} GROUP BY canonical_key)) AS candidate_matches,
    (SELECT count(DISTINCT canonical_product_id) FROM {CANONICAL}) AS canonical_groups, (SELECT count(*) FROM {CANONICAL}) AS products_updated, (SELECT count(*) FROM offers JOIN {CANONICAL} USING (product_id)) AS offers_updated""")
def _(t):
    priced = t.products.filter("price_numeric IS NOT NULL")
    as_of = _when("2024-06-01")
    return R.run_counters(canonical(t), R.match_counts(priced, min_score=None), ("products", R.propagate(t.products, canonical(t), as_of)), ("offers", R.propagate(t.offers, canonical(t), as_of)))


# --- duplicate queue ------------------------------------------------------------------------

_LIST = "(SELECT domain || ':' || product_url AS listing, domain AS source, product_url AS url, trim(lower(category || ' ' || regexp_replace(brand, '[^a-zA-Z0-9]+', ' ', 'g'))) AS k FROM products)"


@query("i1_same_names", f"SELECT substr(sha1(least(listing, head) || '|' || greatest(listing, head)), 1, 12) AS candidate_id, 0.96::DOUBLE AS confidence, 'normalized_name' AS reasons FROM (SELECT listing, min(listing) OVER (PARTITION BY k) AS head FROM {_LIST}) WHERE listing <> head")
def _(t):
    listings = t.products.select(F.col("domain").alias("source"), F.col("product_url").alias("url"), F.concat_ws(" ", "category", "brand").alias("name"))
    return R.duplicate_pairs(listings, 1.01).select("candidate_id", F.col("confidence").cast("double").alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


def _page_listings(t):
    from ..operators.pages import page_facts
    return page_facts(t.raw_pages).select(F.col("domain").alias("source"), "url", F.col("h1").alias("name"))


@query("i1_duplicate_pairs")
def _(t):
    pairs = R.duplicate_pairs(_page_listings(t))
    return pairs.select("candidate_id", "confidence", F.array_join("reasons", ",").alias("reasons"))


def _queue(t, half):
    product = F.struct(F.col("domain").alias("name"))
    return t.candidates.filter(half).select("candidate_id", F.col("score").alias("confidence"), F.array("status").alias("reasons"), product.alias("left_product"), product.alias("right_product"))


@query("i2_queue_refresh", """SELECT candidate_id, CASE WHEN ok % 2 = 0 THEN score ELSE 0.5 END AS confidence, CASE WHEN ok % 3 = 0 THEN 'approved' ELSE 'pending' END AS status, year(CASE WHEN ok % 3 = 0 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-06-01' END) AS created
    FROM (SELECT *, CAST(substr(version, 2) AS BIGINT) AS ok FROM candidates) WHERE ok % 2 = 0 OR ok % 3 = 0""")
def _(t):
    number = "CAST(substr(version, 2) AS BIGINT)"
    queue = _queue(t, f"{number} % 3 = 0").withColumns({"confidence": F.lit(0.5).cast("double"), "status": F.lit("approved"), "note": F.lit("n"), "created_at": _when("2020-01-01"), "updated_at": _when("2020-01-01")})
    out = R.refresh_queue(queue, _queue(t, f"{number} % 2 = 0"), _when("2024-06-01"))
    return out.select("candidate_id", "confidence", "status", F.year("created_at").cast("long").alias("created"))


@query("i2_decisions", "SELECT candidate_id, CASE WHEN domain = 'd7.vn' THEN 'merged' ELSE status END AS status FROM candidates")
def _(t):
    queue = t.candidates.select("candidate_id", "status", F.lit(None).cast("string").alias("note"), "updated_at")
    made = t.candidates.filter("domain = 'd7.vn'").select("candidate_id", F.lit("merged").alias("status"), F.lit("same").alias("note"), F.lit("editor").alias("role"))
    return R.decide(queue, made, "candidate_id", _when("2024-06-01")).select("candidate_id", "status")


# --- model responses ------------------------------------------------------------------------

def _item(t):
    kind = F.when(F.col("pk") % 4 == 0, "Store").when(F.col("pk") % 4 == 1, "thing").otherwise(" product ")
    fields = F.struct(kind.alias("entity_type"), F.concat(F.lit(" "), "product_name").alias("name"), F.col("product_url").alias("url"), F.col("price_text").alias("price"), F.col("brand").alias("brand"),
                      F.col("store_name").alias("store_name"), F.col("store_phone").alias("phone"), F.when(F.col("pk") % 3 > 0, (F.col("pk") % 5) / 2.0).alias("confidence"))
    return F.to_json(F.struct(F.col("domain"), F.array(fields).alias("items")))


def _responses(t):
    """Stored responses with one item per product, in the shapes models return them."""
    body, n = _item(t), F.col("pk") % 5
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    quoted = F.regexp_extract(F.to_json(F.struct(body.alias("v"))), r'^\{"v":(.*)\}$', 1)
    text = (F.when(n == 0, body).when(n == 1, fence).when(n == 2, F.concat(body, F.lit('\n{"items":[]} and so on'))).when(n == 3, F.concat(F.lit("Here it is: "), body, F.lit(" [done]"))).otherwise(quoted))
    return t.products.select("pk", "domain", F.col("store_url").alias("url"), "raw_page_id", text.alias("raw_text"))


def _items(t, default=0.0):
    parsed = _responses(t).withColumn("json", J.json_text("raw_text"))
    return parsed.select("pk", "domain", "url", "raw_page_id", F.posexplode(J.response_items("json", default)).alias("place", "item"))


@query("d34_first_json", "SELECT pk, ' ' || product_name AS name FROM products")
def _(t):
    return _responses(t).select("pk", F.get_json_object(J.json_text("raw_text"), "$.items[0].name").alias("name"))


@query("d36_response_items", "SELECT pk, CASE WHEN pk % 4 = 0 THEN 'store' ELSE 'product' END AS entity_type, product_name AS name, price_text AS price, 'VND' AS currency, CASE WHEN pk % 3 > 0 THEN least(pk % 5 / 2.0, 1.0) ELSE 0.5 END::DOUBLE AS confidence, 'needs_review' AS review_status FROM products")
def _(t):
    return _items(t, 0.5).select("pk", *[F.col("item")[n].alias(n) for n in ("entity_type", "name", "price", "currency", "confidence", "review_status")])


@query("d35_rule_draft", "SELECT pk, CASE WHEN pk % 2 = 0 THEN '.a' ELSE '.b' END AS item_selector, 'clean_price' AS transform, 2 AS fields, 'unknown' AS page_type FROM products")
def _(t):
    section = lambda s: f'{{"item_selector":"{s}","fields":[{{"name":"price","selector":".p","transform":"clean_price"}},{{"name":"x","selector":".x","transform":"made_up"}},{{"selector":"none"}}]}}'
    text = F.when(F.col("pk") % 2 == 0, F.lit('{"listing":' + section(".a") + "}")).otherwise(F.lit('{"output_shape":{"listing":' + section(".b") + "}}"))
    draft = t.products.select("pk", J.rule_draft(F.concat(text, F.lit(""))).alias("d"))
    fields = F.col("d")["listing"]["fields"]
    return draft.select("pk", F.col("d")["listing"]["item_selector"].alias("item_selector"), F.concat_ws(",", F.transform(fields, lambda f: f["transform"])).alias("transform"), F.size(fields).alias("fields"), F.col("d")["page_type"].alias("page_type"))


@query("d37_synthetic_rows", "SELECT pk, CASE WHEN pk % 3 = 0 THEN 'short' ELSE product_name || ',' END AS first_row FROM products")
def _(t):
    row = F.to_json(F.struct(F.col("product_name").alias("name")))
    two = F.concat(F.lit("["), row, F.lit(","), row, F.lit(","), row, F.lit("]"))
    text = F.when(F.col("pk") % 3 == 0, F.concat(F.lit("["), row, F.lit("]"))).when(F.col("pk") % 3 == 1, two).otherwise(F.concat(F.lit('{"rows":'), two, F.lit("}")))
    columns = F.array(F.lit("name"), F.lit("missing"))
    rows = t.products.select("pk", J.synthetic_rows(text, columns, F.lit(2)).alias("r"))
    first = F.concat_ws(",", *[F.try_element_at(F.get("r", 0), F.lit(n)) for n in ("name", "missing")])
    return rows.select("pk", F.when(F.col("r").isNotNull(), first).otherwise("short").alias("first_row"))


def _records(t):
    names = ["entity_type", "name", "url", "price", "brand", "store_name", "currency"]
    item = F.col("item")
    record = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[item[n] for n in names]))
    return _items(t, 0.5).select("domain", F.col("url"), "raw_page_id", item["entity_type"].alias("entity_type"), record.alias("record"), item["confidence"].alias("confidence"))


@query("c17_record_routing", f"SELECT {A.sha16('domain', 'product_url')} AS product_id, product_name, brand, 'ai_extracted' AS data_origin FROM products WHERE pk % 4 <> 0")
def _(t):
    chosen = D.attach_store_config(D.records_as_pages(_records(t)), None)
    return D.products_of_pages(chosen, _when("2024-06-01"), "ai_extracted").select("product_id", "product_name", "brand", "data_origin")


@query("c18_review_publish", f"SELECT {A.sha16('domain', 'product_url')} AS product_id, price_numeric, 'ai_review' AS extraction_method FROM products WHERE pk % 4 <> 0 AND pk % 2 = 0")
def _(t):
    even = F.col("raw_page_id").cast("long") % 2 == 0
    reviews = _records(t).withColumns({"status": F.when(even, "approved").otherwise("needs_review"), "model": F.lit("m1"), "source_id": F.lit(None).cast("string")})
    return D.publishable_reviews(reviews, _when("2024-06-01")).select("product_id", "price_numeric", "extraction_method")


@query("c21_review_totals", "SELECT domain, count(*) AS total, count(*) AS needs_review, count(*) AS ids FROM products GROUP BY domain")
def _(t):
    rows = D.review_rows(_items(t))
    return rows.groupBy("domain").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.countDistinct("review_id").alias("ids"))


@query("d30_rule_hash", "SELECT source_id, substr(sha256('{\"domain\":\"' || domain || '\",\"fields\":' || CAST(sk % 3 AS VARCHAR) || '}'), 1, 16) AS version FROM sources")
def _(t):
    return t.sources.select("source_id", text_hash(F.to_json(F.struct("domain", (F.col("sk") % 3).alias("fields")))).alias("version"))
