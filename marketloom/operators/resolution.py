"""Entity resolution: canonical products and the duplicate queue."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import canonical_key, full_part_id, pair_id
from ..session import cut_lineage
from .common import side_by_side
from .components import connected_components
from .similarity import match_ratio, similar_pairs

PROFILE = ["canonical_key", "category", "brand", "label", "volume_ml", "abv_percent", "pack_size"]
BRAND, VOLUME, STRENGTH, PACK, CATEGORY, NAME = 0.15, 0.10, 0.05, 0.05, 0.05, 0.60
WEIGHTS = {"brand": BRAND, "volume_ml": VOLUME, "abv_percent": STRENGTH, "pack_size": PACK, "category": CATEGORY}
#: Scores are rounded to three places, so half a step below still counts.
HALF_STEP = 0.0005


def canonical_features(products: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """Matching features of each product: folded name, core name, measures and canonical key.

    Needs product_id, product_name, brand, category; raw_data (map) is used when present.
    """
    columns = products.columns
    raw = (lambda n: F.try_element_at("raw_data", F.lit(n))) if "raw_data" in columns else (lambda n: F.lit(None).cast("string"))
    name = F.coalesce(F.col("product_name"), F.col("canonical_name")) if "canonical_name" in columns else F.col("product_name")
    label = F.coalesce(X.blank_to_null("normalized_category"), F.col("category")) if "normalized_category" in columns else F.col("category")
    fold = lambda c: X.fold_text(c, decimal_comma)
    rows = products.filter(F.coalesce("product_id", F.lit("")) != "").select(
        "product_id", F.coalesce(name, F.lit("")).alias("product_name"), fold(label).alias("category"),
        fold(F.coalesce(X.blank_to_null("brand"), raw("brand"))).alias("brand"),
        raw("volume").alias("_volume"), raw("volume_ml").alias("_volume_ml"), raw("percentage").alias("_percentage"),
        raw("abv_percent").alias("_abv"), raw("pack_size").alias("_pack"))
    n = F.col("product_name")
    rows = rows.select(
        "product_id", "product_name", "category", "brand", fold(n).alias("normalized_name"),
        X.name_core(n, "brand", decimal_comma).alias("name_core"),
        X.canonical_volume_ml(n, F.col("_volume"), F.col("_volume_ml"), decimal_comma=decimal_comma).alias("volume_ml"),
        X.canonical_abv(n, F.col("_percentage"), F.col("_abv"), decimal_comma=decimal_comma).alias("abv_percent"),
        X.canonical_pack_size(n, F.col("_pack"), decimal_comma=decimal_comma).alias("pack_size"))
    return rows.withColumn("canonical_key", canonical_key(*[F.col(c) for c in (
        "category", "brand", "name_core", "volume_ml", "abv_percent", "pack_size")]))


def _both(name: str, test) -> Column:
    left, right = F.col(f"left_{name}"), F.col(f"right_{name}")
    empty = F.lit("") if name in ("category", "brand") else F.lit(0)
    present = F.coalesce((left != empty) & (right != empty), F.lit(False))
    return present & test(left, right)


def vetoed() -> Column:
    """Pairs that can never match: known but different category, volume, strength or pack."""
    differ = lambda a, b: a != b
    return (_both("category", differ) | _both("volume_ml", differ) | _both("pack_size", differ)
            | _both("abv_percent", lambda a, b: F.abs(a - b) > 0.25))


def bonus() -> Column:
    """Score a pair earns from everything but the name."""
    same = lambda a, b: a == b
    part = lambda name, weight, test=same: F.when(_both(name, test), weight).otherwise(0.0)
    return (part("brand", BRAND) + part("volume_ml", VOLUME) + part("abv_percent", STRENGTH, lambda a, b: F.abs(a - b) <= 0.25)
            + part("pack_size", PACK) + part("category", CATEGORY))


def match_score(ratio: Column) -> Column:
    return F.when(vetoed(), 0.0).otherwise(F.round(F.least(ratio * NAME + bonus(), F.lit(1.0)), 3))


def profiles(features: DataFrame) -> DataFrame:
    """Distinct feature sets with their product counts; copies collapse before any pairing."""
    label = F.coalesce(X.blank_to_null("name_core"), F.col("normalized_name"))
    return features.withColumn("label", label).groupBy(*PROFILE).agg(F.count("*").alias("products")).withColumn(
        "profile", full_part_id(*PROFILE))


def _sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    keep = ["profile", *PROFILE, "products"]
    side = lambda s: table.select(*[F.col(c).alias(f"{s}_{c}") for c in keep])
    return pairs.join(side("left"), "left_profile").join(side("right"), "right_profile")


def _edges_in_block(table: DataFrame, block: Column, most: float, min_score: float) -> DataFrame:
    """Matching profile pairs inside one kind of block, where bonuses add up to ``most`` at best."""
    rows = table.withColumn("block", block).filter("block IS NOT NULL")
    labels = rows.select("block", "label").distinct().withColumn("item", F.col("label"))
    near = similar_pairs(labels, "item", "label", (min_score - HALF_STEP - most) / NAME, ["block"])
    near = near.select("block", "left_text", "right_text", "ratio").union(
        labels.select("block", "label", "label", F.lit(1.0)))
    side = lambda s: rows.select("block", *[
        F.col(c).alias(f"{s}_text" if c == "label" else f"{s}_{c}") for c in ["profile", *PROFILE, "products"]])
    pairs = near.join(side("left"), ["block", "left_text"]).join(side("right"), ["block", "right_text"]).filter(
        (F.col("left_canonical_key") != F.col("right_canonical_key"))
        & ((F.col("left_text") != F.col("right_text")) | (F.col("left_profile") < F.col("right_profile"))))
    return pairs.withColumn("score", match_score(F.col("ratio"))).filter(F.col("score") >= min_score)


def lossless_blocks(min_score: float) -> list[tuple[tuple[str, ...], list[tuple[str, ...]], float]]:
    """Blocks in which every pair of ``min_score`` is found: (fields that are equal, blocks before it, highest bonus).

    A pair earns its name's share and the weights of the fields it agrees on. The smallest sets of fields with which
    a full name share reaches the score are the blocks; strength, which agrees within a tolerance, is left out of
    their keys. A pair belongs to the first block whose fields it shares, so a later block needs to look only at what
    is left of the bonuses.
    """
    weight = lambda fields: sum(WEIGHTS[f] for f in fields)
    sets = [frozenset(s) for n in range(len(WEIGHTS) + 1) for s in combinations(WEIGHTS, n)]
    enough = [s for s in sets if NAME + weight(s) >= min_score - HALF_STEP - 1e-9]
    keys = {s - {"abv_percent"} for s in enough}
    smallest = sorted((k for k in keys if not any(o < k for o in keys)), key=lambda k: (-round(weight(k), 6), "volume_ml" not in k, sorted(k)))
    blocks = []
    for i, key in enumerate(smallest):
        most = max(weight(s) for s in enough if key <= s and not any(o <= s for o in smallest[:i]))
        blocks.append((tuple(sorted(key)), [tuple(sorted(o)) for o in smallest[:i]], most))
    return blocks


def fuzzy_edges(table: DataFrame, min_score: float = 0.88) -> DataFrame:
    """Profile pairs whose score reaches ``min_score`` though their keys differ, sought in :func:`lossless_blocks`.

    At 0.88 these are (brand, volume) and (brand, category, pack). The lower the score, the wider the blocks: from
    0.6 down nothing needs to be shared but the name. Where other fields alone reach the score, which they do
    up to 0.4, every pair of a block would match whatever its names are; that is refused.
    """
    if min_score - HALF_STEP <= sum(WEIGHTS.values()):
        raise ValueError("names must count: min_score has to be above 0.4005")
    fields = ["left_profile", "right_profile", "left_products", "right_products", "score"]
    found = [table.select(F.col("profile").alias(fields[0]), F.col("profile").alias(fields[1]), F.col("products").alias(fields[2]),
                          F.col("products").alias(fields[3]), F.lit(0.0).alias(fields[4])).limit(0)]
    shared = lambda names: reduce(lambda a, b: a & b, [_both(n, lambda x, y: x == y) for n in names], F.lit(True))
    for key, earlier, most in lossless_blocks(min_score):
        known = reduce(lambda a, b: a & b, [F.col(n) != (F.lit("") if n in ("category", "brand") else F.lit(0)) for n in key], F.lit(True))
        block = F.when(known, F.to_json(F.struct(F.lit(0).alias("_"), *key)))
        pairs = _edges_in_block(table, block, most, min_score)
        found.append(reduce(lambda df, other: df.filter(~shared(other)), earlier, pairs).select(*fields))
    return reduce(lambda a, b: a.union(b), found)


def key_edges(table: DataFrame) -> DataFrame:
    """Profiles of one canonical key, each tied to the smallest of them: a star, not all pairs."""
    lowest = table.groupBy("canonical_key").agg(F.min("profile").alias("left_profile"))
    return table.join(lowest, "canonical_key").select("left_profile", F.col("profile").alias("right_profile"))


def canonicalize(products: DataFrame, min_score: float | None = 0.88, decimal_comma: bool = False) -> DataFrame:
    """(product_id, canonical_product_id, canonical_key, canonical_match_score) for every product. With no ``min_score`` only equal keys meet."""
    # Both tables are read many times below: write them once, so no round starts from the raw text.
    features = cut_lineage(canonical_features(products, decimal_comma))
    table = cut_lineage(profiles(features))
    edges = key_edges(table)
    if min_score is not None:
        edges = edges.union(fuzzy_edges(table, min_score).select("left_profile", "right_profile"))
    groups = connected_components(edges, "left_profile", "right_profile")
    placed = table.join(groups, table["profile"] == groups["node"], "left").withColumn(
        "component", F.coalesce("component", "profile"))
    # The representative of a group: its smallest (canonical key, product id).
    by_profile = features.withColumn("label", F.coalesce(X.blank_to_null("name_core"), F.col("normalized_name"))).withColumn(
        "profile", full_part_id(*PROFILE))
    first_product = by_profile.groupBy("profile").agg(F.min("product_id").alias("product_id"))
    heads = placed.join(first_product, "profile").groupBy("component").agg(
        F.min(F.struct("canonical_key", "product_id", *[F.col(c) for c in PROFILE[1:]])).alias("head"))
    left = placed.join(heads, "component").select(
        "profile", F.col("head")["product_id"].alias("head_id"), F.col("head")["canonical_key"].alias("head_key"),
        *[F.col(c).alias(f"left_{c}") for c in PROFILE], *[F.col("head")[c].alias(f"right_{c}") for c in PROFILE])
    # Scores are per profile, so the ratio runs once per distinct feature set.
    scored = left.withColumn("score", F.greatest(
        match_score(match_ratio("left_label", "right_label")),
        F.when(F.col("left_canonical_key") == F.col("head_key"), 1.0).otherwise(0.0)))
    return by_profile.join(scored, "profile").select(
        "product_id", F.concat(F.lit("cp_"), full_part_id("head_key")).alias("canonical_product_id"), "canonical_key",
        F.when(F.col("product_id") == F.col("head_id"), 1.0).otherwise(F.col("score")).alias("canonical_match_score"))


def match_counts(products: DataFrame, min_score: float | None = 0.88) -> DataFrame:
    """Scanned products and matching pairs, the pairs counted without building them."""
    table = cut_lineage(profiles(canonical_features(products)))
    by_key = table.groupBy("canonical_key").agg(F.sum("products").alias("n")).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("key_pairs"), F.sum("n").alias("products_scanned"))
    if min_score is None:
        return by_key.select("products_scanned", F.col("key_pairs").alias("candidate_matches"))
    fuzzy = fuzzy_edges(table, min_score).agg(
        F.coalesce(F.sum(F.col("left_products") * F.col("right_products")), F.lit(0)).alias("fuzzy_pairs"))
    return side_by_side(by_key, fuzzy).select("products_scanned", (F.col("key_pairs") + F.col("fuzzy_pairs")).alias("candidate_matches"))


def run_counters(canonical: DataFrame, counts: DataFrame, *targets: tuple[str, DataFrame]) -> DataFrame:
    """One row about a run: products scanned, canonical groups, candidate matches, and of each target (name, propagated rows) how many carry an id."""
    groups = canonical.select("canonical_product_id").distinct().agg(F.count("*").alias("canonical_groups"))
    marked = [rows.agg(F.count("canonical_product_id").alias(f"{name}_updated")) for name, rows in targets]
    return side_by_side(counts.select("products_scanned", "candidate_matches"), groups, *marked)


def propagate(target: DataFrame, canonical: DataFrame, as_of: Column) -> DataFrame:
    """Write canonical ids onto products or offers by product_id; other rows keep theirs."""
    fields = ["canonical_product_id", "canonical_key", "canonical_match_score"]
    found = canonical.select("product_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = target.join(found, "product_id", "left")
    hit = F.col("new_canonical_product_id").isNotNull()
    old = lambda c: F.col(c) if c in target.columns else F.lit(None)
    return joined.withColumns({
        **{c: F.when(hit, F.col(f"new_{c}")).otherwise(old(c)) for c in fields},
        "canonicalized_at": F.when(hit, as_of).otherwise(old("canonicalized_at"))}).drop(*[f"new_{c}" for c in fields])


# --- duplicate queue ------------------------------------------------------------------------

def duplicate_pairs(listings: DataFrame, min_ratio: float = 0.78) -> DataFrame:
    """Listing pairs that share a URL or a name, or whose names are alike, one row per pair id.

    Needs name, source and url. Works on distinct (source, url, name) listings; pairs on a shared
    URL or name come as links to the group's first listing, so a group of n copies gives n-1 rows
    rather than all its pairs; the fuzzy part pairs distinct names by their first listing.
    """
    rows = listings.select("source", "url", "name").distinct().withColumn("name_key", X.product_name_key("name")).filter("name_key <> ''")
    rows = rows.withColumns({"key": F.coalesce(X.blank_to_null("url"), F.col("name"))})
    # Five aggregates and joins below read the listings: write them once, so none starts from the pages.
    rows = cut_lineage(rows.withColumn("listing", F.concat_ws(":", "source", "key")))
    fields = ["listing", "source", "key", "url", "name", "name_key"]
    head = lambda group: rows.groupBy(group).agg(F.min(F.struct(*fields)).alias("head"))
    linked = lambda group: rows.filter(F.coalesce(F.col(group), F.lit("")) != "").join(head(group), group).filter(
        F.col("listing") != F.col("head")["listing"]).select(
        *[F.col("head")[c].alias(f"left_{c}") for c in fields], *[F.col(c).alias(f"right_{c}") for c in fields])
    names = head("name_key").select("name_key", "head")
    alike = similar_pairs(names.withColumn("item", F.col("name_key")), "item", "name_key", min_ratio, [])
    side = lambda s: names.select(F.col("name_key").alias(f"{s}_item"), *[F.col("head")[c].alias(f"{s}_{c}") for c in fields])
    fuzzy = alike.select("left_item", "right_item", "ratio").join(side("left"), "left_item").join(side("right"), "right_item")
    # The n-1 links of a URL are scored; those of a name have ratio 1.
    pairs = (linked("url").withColumn("ratio", match_ratio("left_name_key", "right_name_key"))
             .unionByName(linked("name_key").withColumn("ratio", F.lit(None).cast("double")))
             .unionByName(fuzzy.drop("left_item", "right_item")))
    same_url = F.coalesce((F.col("left_url") != "") & (F.col("left_url") == F.col("right_url")), F.lit(False))
    same_name = F.col("left_name_key") == F.col("right_name_key")
    pairs = pairs.withColumns({
        "candidate_id": pair_id(F.col("left_source"), F.col("left_key"), F.col("right_source"), F.col("right_key")),
        "ratio": F.coalesce("ratio", F.when(same_name, 1.0)), "same_url": same_url, "same_name": same_name})
    merged = pairs.groupBy("candidate_id").agg(
        F.bool_or("same_url").alias("same_url"), F.bool_or("same_name").alias("same_name"), F.max("ratio").alias("ratio"),
        F.min(F.struct(*[f"left_{c}" for c in fields], *[f"right_{c}" for c in fields])).alias("pair"))
    url, name = F.col("same_url"), F.col("same_name")
    return merged.select(
        "candidate_id", F.when(url, 0.99).when(name, 0.96).otherwise(F.round("ratio", 2)).alias("confidence"),
        F.array_compact(F.array(F.when(name, "normalized_name"), F.when(url, "product_url"),
                                F.when(~name & (F.col("ratio") >= min_ratio), "name_similarity"))).alias("reasons"),
        *[F.struct(*[F.col("pair")[f"{s}_{c}"].alias(c) for c in ("source", "url", "name")]).alias(f"{s}_product") for s in ("left", "right")])


def refresh_queue(queue: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """Merge found pairs into the queue: new ones pending, known ones keep status, note and age."""
    new = found.select("candidate_id", *[F.col(c).alias(f"new_{c}") for c in ("confidence", "reasons", "left_product", "right_product")])
    both = queue.join(new, "candidate_id", "full_outer")
    seen = F.col("new_confidence").isNotNull()
    return both.select(
        "candidate_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("confidence", "reasons", "left_product", "right_product")],
        F.coalesce("status", F.lit("pending")).alias("status"), "note", F.coalesce("created_at", as_of).alias("created_at"),
        F.when(seen, as_of).otherwise(F.col("updated_at")).alias("updated_at"))


def decide(queue: DataFrame, decisions: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Apply human decisions (key, status, note, role) to a queue."""
    new = decisions.select(key, F.col("status").alias("new_status"), F.col("note").alias("new_note"), F.col("role").alias("new_role"))
    hit = F.col("new_status").isNotNull()
    return queue.join(new, key, "left").withColumns({
        "status": F.coalesce("new_status", "status"), "note": F.when(hit, F.col("new_note")).otherwise(F.col("note")),
        "updated_by_role": F.when(hit, F.col("new_role")).otherwise(F.col("updated_by_role") if "updated_by_role" in queue.columns else F.lit(None)),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}).drop("new_status", "new_note", "new_role")
