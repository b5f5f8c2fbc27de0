"""Metrics, quality gate, drift, rule validation and synthetic-row checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.classify import page_class
from ..functions.urls import is_http
from ..functions.validity import row_checks, valid_store
from .common import first_seen, join_null_safe, previous_row, top_per_group

METRICS = ["valid_products", "required_coverage", "brand_coverage", "duplicate_ratio", "median_price"]


def metric_columns(median: bool = True) -> list[Column]:
    """The metrics bundle as aggregate columns, for groups the size of a page or a batch.

    The median here keeps a group's distinct prices in one buffer; :func:`page_metrics` leaves it out
    and finds it by :func:`grouped_upper_median`, which suits groups of any size.
    """
    whole = F.col("product_name").isNotNull() & (F.col("product_name") != "") & (F.coalesce("product_url", F.lit("")) != "") & F.coalesce(F.col("price_numeric") > 0, F.lit(False))
    share = lambda test: F.round(F.try_divide(F.count_if(test), F.count("*")), 3)
    bundle = [
        F.count("*").alias("valid_products"), share(whole).alias("required_coverage"),
        share(F.coalesce("brand", F.lit("")) != "").alias("brand_coverage"),
        F.round(1 - F.try_divide(F.countDistinct("product_id"), F.count("product_id")), 3).alias("duplicate_ratio"),
    ]
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN price_numeric > 0 THEN price_numeric END DESC)")
    return bundle + [middle.alias("median_price")] if median else bundle


def _at_rank(level: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The step of each (group, wanted place) that holds the place, by running counts; ``_rank`` becomes the place inside the step."""
    running = Window.partitionBy(*keys, "_at").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    level = level.withColumn("_upto", F.sum("_held").over(running))
    before = F.col("_upto") - F.col("_held")
    return level.filter((F.col("_rank") >= before) & (F.col("_rank") < F.col("_upto"))).withColumn("_rank", F.col("_rank") - before)


def grouped_order_statistics(rows: DataFrame, keys: list[str], places: Callable[[Column], list[Column]], value: str = "price_numeric") -> DataFrame:
    """(keys, _at, value): the positive values of each group at the places (from 0) that ``places`` makes of the group's size.

    No group is gathered or put in order. Values are counted first. Counts per logarithmic bucket tell which bucket holds a
    place; counts per bucket a thousand times finer inside it, which step; only the values of that step are put in order. So
    a window sees some thousand rows whatever the size of a group, also where all rows are one group.
    """
    log = F.log(F.col(value))
    counts = rows.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_held")).withColumns({
        "_coarse": F.floor(log * 32), "_fine": F.floor(log * 32768)})
    coarse = counts.groupBy(*keys, "_coarse").agg(F.sum("_held").alias("_held"))
    coarse = coarse.withColumn("_total", F.sum("_held").over(Window.partitionBy(*keys)))
    coarse = coarse.withColumn("_at", F.explode(F.array_distinct(F.array(*places(F.col("_total"))))))
    found = _at_rank(coarse.withColumn("_rank", F.col("_at")), keys, "_coarse").select(*keys, "_coarse", "_at", "_rank")
    fine = join_null_safe(counts, found, [*keys, "_coarse"]).groupBy(*keys, "_at", "_rank", "_fine").agg(F.sum("_held").alias("_held"))
    found = _at_rank(fine, keys, "_fine").select(*keys, "_fine", "_at", "_rank")
    return _at_rank(join_null_safe(counts, found, [*keys, "_fine"]), keys, value).select(*keys, "_at", value)


def grouped_upper_median(rows: DataFrame, keys: list[str], value: str = "price_numeric") -> DataFrame:
    """Exact upper median of the positive values per group, without gathering any group."""
    found = grouped_order_statistics(rows, keys, lambda n: [F.floor(n / 2)], value)
    return found.select(*keys, F.col(value).alias("median_price"))


def grouped_median(rows: DataFrame, keys: list[str], value: str = "price_numeric") -> DataFrame:
    """Exact median of the positive values per group: the mean of the two middle values where their number is even."""
    found = grouped_order_statistics(rows, keys, lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)], value)
    return found.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median_price"))


def page_metrics(products: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics bundle per page, batch, source or any other grouping."""
    return join_null_safe(products.groupBy(*keys).agg(*metric_columns(median=False)), grouped_upper_median(products, keys), keys, "left")


def source_metrics(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Product-weighted means of page metrics; the median is the last one present."""
    weighted = lambda n: F.round(F.coalesce(F.try_divide(F.sum(F.col(n) * F.col("valid_products")), F.sum("valid_products")), F.lit(0.0)), 3)
    last = F.max(F.when(F.col("median_price").isNotNull(), F.struct(order, "median_price")))["median_price"]
    return pages.groupBy(*keys).agg(
        F.sum("valid_products").alias("valid_products"), *[weighted(n).alias(n) for n in METRICS[1:4]],
        F.when(F.sum("valid_products") > 0, last).alias("median_price"))


def gate_reasons(now: Column, before: Column) -> Column:
    """Why a batch must not be written, most basic reason first; empty when it may."""
    old, new = F.coalesce(before["valid_products"], F.lit(0)), F.coalesce(now["valid_products"], F.lit(0))
    moved = F.abs(now["median_price"] - before["median_price"]) / F.nullif(before["median_price"], F.lit(0.0))
    return F.array_compact(F.array(
        F.when(F.coalesce(now["required_coverage"], F.lit(0.0)) < 0.65, "required coverage below 65%"),
        F.when((old >= 5) & (new < old * 0.3), F.concat(
            F.lit("product count dropped more than 70% ("), old.cast("string"), F.lit(" -> "), new.cast("string"), F.lit(")"))),
        F.when((now["median_price"] != 0) & (moved > 0.8), "median price changed more than 80%")))


def drift_warnings(now: Column, before: Column) -> Column:
    """How a batch differs from the one before; empty when there is none before."""
    old, new = F.coalesce(before["valid_products"], F.lit(0)), F.coalesce(now["valid_products"], F.lit(0))
    two = lambda v: v.cast("decimal(18,2)").cast("string")

    def fell(name: str) -> Column:
        was, is_now = F.coalesce(before[name], F.lit(0.0)), F.coalesce(now[name], F.lit(0.0))
        return F.when((was >= 0.5) & (is_now < was - 0.3), F.concat(F.lit(f"{name} dropped from "), two(was), F.lit(" to "), two(is_now)))

    moved = F.abs(now["median_price"] - before["median_price"]) / F.nullif(before["median_price"], F.lit(0.0))
    found = F.array_compact(F.array(
        F.when((old >= 5) & (new < old * 0.5), F.concat(F.lit("product count dropped from "), old.cast("string"), F.lit(" to "), new.cast("string"))),
        fell("required_coverage"), fell("brand_coverage"),
        F.when((now["median_price"] != 0) & (moved > 0.6), "median price changed by more than 60%"),
        F.when(F.coalesce(now["duplicate_ratio"], F.lit(0.0)) > 0.5, "duplicate ratio exceeded 50%")))
    return F.when(before.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def metric_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{m}").alias(m) for m in METRICS])


def with_previous_metrics(runs: DataFrame, key: str, order: str, bucket: Column) -> DataFrame:
    """Metrics of each run beside those of the source's run before it."""
    return previous_row(runs, key, order, METRICS, bucket)


def route_gate(products: DataFrame, metrics: DataFrame, previous: DataFrame, key: str, group: list[str], sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split product rows into (written, quarantined) by the gate verdict of their batch. NULL keys are batches too.

    ``sources`` (key, quality_gate_enabled) may switch the gate off for a source; without a setting it is on.
    """
    before = previous.select(key, metric_struct().alias("previous_metrics"))
    judged = join_null_safe(metrics, before, [key], "left").withColumn("metrics", metric_struct())
    if sources is None:
        judged = judged.withColumn("_on", F.lit(True))
    else:
        gates = sources.groupBy(key).agg(F.bool_and(F.coalesce("quality_gate_enabled", F.lit(True))).alias("_on"))
        judged = join_null_safe(judged, gates, [key], "left")
    judged = judged.withColumn("reasons", F.when(F.coalesce("_on", F.lit(True)), gate_reasons(F.col("metrics"), F.col("previous_metrics"))).otherwise(F.array().cast("array<string>")))
    keys = list(dict.fromkeys([*group, key]))
    rows = join_null_safe(products, judged.select(*keys, "metrics", "previous_metrics", "reasons"), keys)
    held = F.size("reasons") > 0
    written = rows.filter(~held).drop("metrics", "previous_metrics", "reasons")
    return written, rows.filter(held).withColumn("reason", F.get("reasons", 0)).drop("reasons")


def baseline(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Source metrics of accepted pages only: what was quarantined never becomes the baseline."""
    return source_metrics(pages.filter("NOT quarantined"), keys, order)


# --- rule validation ------------------------------------------------------------------------

def validation_samples(pages: DataFrame, order: list[Column]) -> DataFrame:
    """Up to 3 store, 3 listing and 5 detail pages per domain; unknown pages fill listing up to 2
    and then detail up to 3. Adds class and the class it is sampled as.
    """
    ranked = top_per_group(pages.withColumn("class", page_class("page_type", "url")), ["domain", "class"], order, 5)
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("domain", "class").orderBy(*order)))
    per_domain = Window.partitionBy("domain")
    have = lambda c, most: F.least(F.count_if(F.col("class") == c).over(per_domain), F.lit(most))
    ranked = ranked.withColumns({"_listing_gap": F.greatest(2 - have("listing", 3), F.lit(0)), "_detail_gap": F.greatest(3 - have("product_detail", 5), F.lit(0))})
    place, cls = F.col("place"), F.col("class")
    role = (F.when((cls == "store_listing") & (place <= 3), "store_listing").when((cls == "listing") & (place <= 3), "listing")
            .when((cls == "product_detail") & (place <= 5), "product_detail")
            .when((cls == "unknown") & (place <= F.col("_listing_gap")), "listing")
            .when((cls == "unknown") & (place <= F.col("_listing_gap") + F.col("_detail_gap")), "product_detail"))
    return ranked.withColumn("sampled_as", role).filter("sampled_as IS NOT NULL").drop("_listing_gap", "_detail_gap")


_RULE_COLUMNS = ("product_name", "price", "product_url", "old_price", "category", "volume_ml", *K.STORE_FIELDS)


def sample_targets(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """The pages on which each section of a rule is tried: (domain, raw_page_id, target, class).

    ``samples``: domain, raw_page_id, class; ``targets``: domain, target, one per section with fields. A section is tried on
    the pages of its class. A product section without any is tried on the pages of unknown class, and so is a store section
    if its rule has no product section. A section left without pages has one row with no page.
    """
    product = F.col("target") != "stores"
    wanted = F.when(product, F.col("target")).otherwise("store_listing")
    rules = targets.groupBy("domain").agg(F.bool_or(product).alias("_products"))
    classes = samples.groupBy("domain", "class").agg(F.count("*").alias("_pages"))
    tried = targets.select("domain", "target").distinct().join(rules, "domain").withColumn("class", wanted).join(classes, ["domain", "class"], "left")
    use = F.when(F.col("_pages").isNotNull(), F.col("class")).when(product | ~F.col("_products"), "unknown")
    tried = tried.select("domain", "target", use.alias("class"))
    return tried.join(samples.select("domain", "class", "raw_page_id"), ["domain", "class"], "left").select("domain", "raw_page_id", "target", "class")


def checked_rows(rows: DataFrame) -> DataFrame:
    """Rule rows (domain, raw_page_id, target, record) with ``passes`` of the ``needed`` checks, ``valid`` and the ``item`` they name.

    The figures below check rows that are not checked yet; where several of them are wanted, check once and write the rows.
    """
    if "checks" in rows.columns:
        return rows
    entry = {n: F.try_element_at("record", F.lit(n)) for n in _RULE_COLUMNS}
    rows = rows.withColumn("checks", row_checks(entry, F.col("domain"), F.col("target")))
    c, listing, store = F.col("checks"), F.col("target") == "listing", F.col("target") == "stores"
    passes = c["product_name"].cast("int") + c["price"].cast("int") + F.when(listing, c["product_url"].cast("int")).otherwise(0)
    rows = rows.withColumns({"passes": F.when(store, valid_store(entry).cast("int")).otherwise(passes), "needed": F.when(store, 1).when(listing, 3).otherwise(2)})
    key_text = F.when(store, X.first_present(entry["store_address"], entry["store_url"], entry["store_name"])).otherwise(
        X.first_present(entry["product_url"], entry["product_name"]))
    return rows.withColumns({"valid": F.col("passes") == F.col("needed"), "item": F.lower(X.clean_text(key_text))})


def sample_results(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per page tried: rows found, valid rows and their share. ``samples`` as :func:`sample_targets` gives them."""
    found = checked_rows(rows).groupBy("domain", "target", "raw_page_id").agg(F.count("*").alias("row_count"), F.count_if("valid").alias("valid_rows"))
    tried = samples.filter("raw_page_id IS NOT NULL").join(found, ["domain", "target", "raw_page_id"], "left")
    n, good = F.coalesce("row_count", F.lit(0)), F.coalesce("valid_rows", F.lit(0))
    return tried.select("domain", "target", "raw_page_id", F.col("class").alias("page_type"), n.alias("row_count"), good.alias("valid_rows"),
                        F.coalesce(F.round(F.try_divide(good, n), 3), F.lit(0.0)).alias("coverage"))


def target_results(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per (domain, target) figures of a rule tried on its samples.

    ``rows``: domain, raw_page_id, target and a record map, one per extracted row. ``samples``:
    domain, raw_page_id, target and class, one per page tried (:func:`sample_targets`). Two-level: page, then target.
    """
    rows = checked_rows(rows)
    store = F.col("target") == "stores"
    has = {n: F.count_if(F.col("valid") & X.blank_to_null(F.try_element_at("record", F.lit(n))).isNotNull()).alias(f"has_{n}")
           for n in ("product_name", "price", "product_url", "brand", *K.STORE_FIELDS)}
    by_page = rows.groupBy("domain", "target", "raw_page_id").agg(
        F.count("*").alias("row_count"), F.count_if("valid").alias("valid_rows"), F.sum("passes").alias("passes"), F.sum("needed").alias("needed"), *has.values())
    unique = rows.filter("valid").groupBy("domain", "target").agg(F.countDistinct("item").alias("unique_items"))
    by_sample = samples.join(by_page, ["domain", "target", "raw_page_id"], "left")
    total = by_sample.groupBy("domain", "target").agg(
        F.count("raw_page_id").alias("sample_count"), F.count_if(F.col("class") == F.when(store, "store_listing").otherwise(F.col("target"))).alias("own_samples"),
        F.coalesce(F.sum("valid_rows"), F.lit(0)).alias("valid_rows"), F.coalesce(F.sum("passes"), F.lit(0)).alias("passes"),
        F.coalesce(F.sum("needed"), F.lit(0)).alias("needed"), F.count_if(F.col("valid_rows") > 0).alias("good_samples"),
        *[F.coalesce(F.sum(f"has_{n}"), F.lit(0)).alias(f"has_{n}") for n in has])
    total = total.join(unique, ["domain", "target"], "left").withColumn("unique_items", F.coalesce("unique_items", F.lit(0)))
    cover = lambda n: F.coalesce(F.round(F.try_divide(F.col(f"has_{n}"), F.col("valid_rows")), 3), F.lit(0.0))
    success = F.coalesce(F.try_divide(F.col("good_samples"), F.col("sample_count")), F.lit(0.0))
    total = total.withColumns({"sample_success": F.round(success, 3), **{f"cover_{n}": cover(n) for n in has}})
    least = F.when(F.col("target") == "listing", K.MIN_SAMPLES["listing"]).when(store, 1).otherwise(K.MIN_SAMPLES["product_detail"])
    covered = F.when(store, F.col("cover_store_address") >= 0.8).otherwise(
        (F.col("cover_product_name") >= 0.8) & (F.col("cover_price") >= 0.8) & ((F.col("target") != "listing") | (F.col("cover_product_url") >= 0.8)))
    return total.withColumn("minimum_samples", F.greatest(F.lit(1), F.least(least, F.when(store, 1).otherwise(F.col("own_samples"))))).withColumn(
        "passed", (F.col("sample_count") >= F.col("minimum_samples")) & (F.col("unique_items") >= F.when(F.col("target") == "listing", 2).otherwise(1))
        & (success >= 0.8) & covered).drop(*[f"has_{n}" for n in has])


def rule_metrics(rows: DataFrame) -> DataFrame:
    """Per domain, over the valid rows of a rule: products and stores, distinct ones of each, share with a brand, soundness of old prices, median price.

    An item that listing and detail pages both show counts once. The old price is sound in a domain without any.
    """
    rows = checked_rows(rows).select("domain", F.when(F.col("target") == "stores", "stores").otherwise("products").alias("kind"), "valid", "item", "record", "checks")
    entry = lambda n: X.blank_to_null(F.try_element_at("record", F.lit(n)))
    product = F.col("valid") & (F.col("kind") == "products")
    flat = rows.filter("valid").withColumn("price_numeric", F.when(product, X.clean_price(F.try_element_at("record", F.lit("price"))))).withColumn(
        "sound", F.when(product & entry("old_price").isNotNull(), F.col("checks")["old_price"].cast("double")))
    distinct = flat.filter("item <> ''").groupBy("domain", "kind", "item").agg(F.count("*").alias("_n")).groupBy("domain").agg(
        F.count_if(F.col("kind") == "products").alias("product_items"), F.count_if(F.col("kind") == "stores").alias("store_items"))
    figures = flat.groupBy("domain").agg(
        F.count_if(product).alias("valid_products"), F.count_if(~product).alias("valid_stores"),
        F.round(F.try_divide(F.count_if(product & entry("brand").isNotNull()), F.count_if(product)), 3).alias("brand_coverage"), F.avg("sound").alias("consistency"))
    return figures.join(distinct, "domain", "left").join(grouped_median(flat, ["domain"]), "domain", "left").select(
        "domain", "valid_products", "valid_stores", F.coalesce("product_items", F.lit(0)).alias("product_items"), F.coalesce("store_items", F.lit(0)).alias("store_items"),
        F.coalesce("brand_coverage", F.lit(0.0)).alias("brand_coverage"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"), "median_price")


def rule_score(coverage: Column, distinct_items: Column, consistency: Column) -> Column:
    diversity = F.least(F.lit(1.0), distinct_items / 5)
    return F.round(coverage * 0.65 + diversity * 0.25 + consistency * 0.10, 3)


def store_rule_score(address_coverage: Column, distinct_items: Column) -> Column:
    return F.round(address_coverage * 0.75 + F.least(F.lit(1.0), distinct_items / 5) * 0.25, 3)


def rule_verdicts(targets: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Score, acceptance and metrics per domain; a rule with store rows only is scored as a store rule.

    ``metrics`` as :func:`rule_metrics` gives them; without them items are counted per target and no old price is unsound.
    """
    product = F.col("target") != "stores"
    per = targets.groupBy("domain").agg(
        F.sum(F.when(product, F.col("passes"))).alias("passes"), F.sum(F.when(product, F.col("needed"))).alias("needed"),
        F.sum(F.when(product, F.col("valid_rows"))).alias("valid_products"), F.sum(F.when(~product, F.col("valid_rows"))).alias("valid_stores"),
        F.sum(F.when(product, F.col("unique_items"))).alias("product_items"), F.sum(F.when(~product, F.col("unique_items"))).alias("store_items"),
        F.bool_and(F.when(product, F.col("passed"))).alias("products_pass"), F.bool_and(F.when(~product, F.col("passed"))).alias("stores_pass"),
        F.max(F.when(~product, F.col("cover_store_address"))).alias("address_coverage"),
        F.collect_set(F.when(F.col("passed"), F.col("target"))).alias("passed_targets"))
    measured = ["product_items", "store_items", "brand_coverage", "consistency", "median_price"]
    if metrics is not None:
        per = per.drop("product_items", "store_items").join(metrics.select("domain", *measured), "domain", "left")
    else:
        per = per.withColumns({"brand_coverage": F.lit(0.0), "consistency": F.lit(1.0), "median_price": F.lit(None).cast("double")})
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    store_only = (zero("valid_stores") > 0) & (zero("valid_products") == 0)
    coverage = F.when(store_only, F.coalesce("address_coverage", F.lit(0.0))).otherwise(F.coalesce(F.try_divide(F.col("passes"), F.col("needed")), F.lit(0.0)))
    items = F.when(store_only, zero("store_items")).otherwise(zero("product_items"))
    score = F.when(store_only, store_rule_score(coverage, items)).otherwise(rule_score(coverage, items, F.coalesce("consistency", F.lit(1.0))))
    return per.withColumn("score", score).withColumn("accepted", F.coalesce(
        F.when(store_only, F.col("stores_pass")).otherwise(F.col("products_pass")) & (F.col("score") >= K.MIN_ACCEPT_SCORE), F.lit(False))).select(
        "domain", "score", "accepted", zero("valid_products").alias("valid_products"), zero("valid_stores").alias("valid_stores"),
        F.array_sort("passed_targets").alias("passed_targets"), F.round(coverage, 3).alias("required_coverage"),
        F.when(store_only, 0.0).otherwise(F.coalesce("brand_coverage", F.lit(0.0))).alias("brand_coverage"),
        F.round(1 - F.least(F.lit(1.0), items / 5), 3).alias("duplicate_ratio"), F.when(~store_only, F.col("median_price")).alias("median_price"))


def draft_results(previews: DataFrame) -> DataFrame:
    """Per (page, target) verdict on a drafted rule from its selector previews."""
    hit = F.col("matches") > 0
    wanted = reduce(lambda acc, t: acc.when(F.col("target") == t, F.array(*[F.lit(f) for f in K.RECOMMENDED_FIELDS[t]])),
                    ["product_detail", "stores"], F.when(F.col("target") == "listing", F.array(*[F.lit(f) for f in K.RECOMMENDED_FIELDS["listing"]])))
    return previews.groupBy("raw_page_id", "target").agg(
        F.coalesce(F.bool_and(F.when(F.col("required"), hit)), F.lit(False)).alias("required_pass"),
        F.round(F.try_divide(F.count_if(hit), F.count("*")), 2).alias("field_score"),
        F.collect_set(F.when(hit, F.col("name"))).alias("_names")).select(
        "raw_page_id", "target", "required_pass", "field_score",
        F.array_sort(F.array_except(wanted, "_names")).alias("missing_recommended"))


def draft_verdicts(results: DataFrame) -> DataFrame:
    """Per page: whether a drafted rule is accepted, how many targets pass, and what its targets lack, as warnings in order of target.

    A draft is accepted by a product target whose required fields all match; a store target alone does not do.
    """
    place = F.when(F.col("target") == "listing", 0).when(F.col("target") == "product_detail", 1).otherwise(2)
    warning = F.when(F.size("missing_recommended") > 0, F.struct(place.alias("place"), F.concat(
        "target", F.lit(": missing "), F.array_join("missing_recommended", ", ")).alias("text")))
    passed = F.col("required_pass")
    return results.groupBy("raw_page_id").agg(
        F.count_if(passed).alias("accepted_targets"), F.count_if(passed & (F.col("target") != "stores")).alias("accepted_product_targets"),
        F.array_sort(F.collect_list(warning)).alias("_w")).select(
        "raw_page_id", (F.col("accepted_product_targets") > 0).alias("accepted"), "accepted_targets", "accepted_product_targets",
        F.transform("_w", lambda w: w["text"]).alias("warnings"))


def enforce_contract(structure: Column) -> Column:
    """Rule with ``required`` set by target contract; store fields are never required."""
    def section(target: str) -> Column:
        names = K.REQUIRED_FIELDS.get(target, [])
        need = lambda f: f["name"].isin(names) if names else F.lit(False)
        fields = F.transform(structure[target]["fields"], lambda f: F.struct(
            f["name"].alias("name"), f["selector"].alias("selector"), f["attr"].alias("attr"), need(f).alias("required"), f["transform"].alias("transform")))
        return F.when(structure[target].isNotNull(), F.struct(structure[target]["item_selector"].alias("item_selector"), fields.alias("fields")))

    return F.struct(*[section(t).alias(t) for t in ("listing", "product_detail", "stores")])


def targets_present(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule targets that the batch has pages for; all of the rule's targets when it has none."""
    cls = page_class("page_type", "url")
    seen = pages.groupBy("domain").agg(F.collect_set(
        F.when(cls == "store_listing", "stores").when(cls.isin("listing", "product_detail"), cls)).alias("seen"))
    return rules.join(seen, "domain", "left").withColumn("targets", F.array_sort(F.when(
        F.size(F.coalesce("seen", F.array())) > 0, F.array_intersect("targets", "seen")).otherwise(F.col("targets")))).drop("seen")


# --- synthetic rows -------------------------------------------------------------------------

def check_synthetic(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Reasons against each synthetic row; later copies of (name, category, store) are duplicates.

    Needs batch_id, position and the text columns name, category, price, rating, url, source,
    store_name.
    """
    text = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    fold = lambda n: F.lower(text(n))
    marked = rows.withColumns({"_n": fold("name"), "_c": fold("category"), "_s": fold("store_name")})
    marked = first_seen(marked, ["batch_id", "_n", "_c", "_s"], "position").drop("_n", "_c", "_s")
    price = X.clean_price("price")
    rating_text = X.blank_to_null(F.col("rating"))
    rating = F.replace(rating_text, F.lit(","), F.lit(".")).try_cast("double")
    outside = (F.lower(text("category")).isin([a.lower() for a in allowed]) == F.lit(False)) if allowed else F.lit(False)
    bad_url = lambda n: (text(n) != "") & ~is_http(text(n))
    reasons = F.array_compact(F.array(
        F.when((F.length(text("name")) < 3) | fold("name").isin(K.GENERIC_SYNTHETIC_NAMES), "product name is missing or too generic"),
        F.when((text("category") == "") | outside, "category is outside requested product types"),
        F.when(price.isNull() | (price <= 0), "price must be a positive number").when(price > 10_000_000_000, "price exceeds the supported range"),
        F.when(rating_text.isNotNull() & rating.isNull(), "rating must be numeric").when(~rating.between(4.0, 5.0), "rating must be between 4.0 and 5.0"),
        F.when(bad_url("url"), "url must be an absolute HTTP URL"), F.when(bad_url("source"), "source must be an absolute HTTP URL"),
        F.when(~F.col("is_first"), "duplicate product row")))
    return marked.withColumn("reasons", reasons).drop("is_first")


def synthetic_summary(checked: DataFrame) -> DataFrame:
    """Valid and invalid rows per batch; a batch is accepted only as a whole."""
    ok = F.size("reasons") == 0
    return checked.groupBy("batch_id").agg(
        F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("invalid_rows"), F.bool_and(ok).alias("accepted"),
        F.when(F.bool_and(ok), "validated").otherwise("rejected").alias("status"))


def route_synthetic(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows); one bad row sends its whole batch to quarantine."""
    verdict = synthetic_summary(checked).select("batch_id", "accepted", F.col("status").alias("validation_status"))
    rows = checked.join(verdict, "batch_id").withColumns({
        "synthetic_id": F.concat("batch_id", F.lit("-"), F.col("position").cast("string")),
        "review_status": F.when(F.col("accepted"), "validated").otherwise("rejected")})
    return rows.filter("accepted").drop("accepted"), rows.filter("NOT accepted").drop("accepted")


def synthetic_batches(products: DataFrame, quarantine: DataFrame, limit: int | None = None) -> DataFrame:
    """One line per batch over both tables: rows, latest times and the status at the latest update."""
    rows = products.withColumn("collection", F.lit("sc_synthetic_products")).unionByName(
        quarantine.withColumn("collection", F.lit("sc_synthetic_quarantine")))
    newest = F.max(F.struct("updated_at", "synthetic_id", "review_status", "source_id", "collection"))
    out = rows.filter(F.coalesce("batch_id", F.lit("")) != "").groupBy("batch_id").agg(
        F.count("*").alias("rows"), newest.alias("n"), F.max("reviewed_at").alias("reviewed_at")).select(
        "batch_id", "rows", F.col("n")["source_id"].alias("source_id"), F.col("n")["review_status"].alias("review_status"),
        F.col("n")["collection"].alias("collection"), F.col("n")["updated_at"].alias("updated_at"), "reviewed_at").orderBy(F.desc("updated_at"), "batch_id")
    return out if limit is None else out.limit(limit)


def decide_batch(rows: DataFrame, source_id: str, batch_id: str, status: str, note: str | None, role: str, as_of: Column) -> DataFrame:
    """Record a review decision on all rows of a batch."""
    hit = (F.col("source_id") == source_id) & (F.col("batch_id") == batch_id)
    return rows.withColumns({
        "review_status": F.when(hit, status).otherwise(F.col("review_status")), "review_note": F.when(hit, F.lit(note)).otherwise(F.col("review_note")),
        "reviewed_by": F.when(hit, role).otherwise(F.col("reviewed_by")), "reviewed_at": F.when(hit, as_of).otherwise(F.col("reviewed_at")),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))})
