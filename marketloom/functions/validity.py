"""Plausibility of extracted rows: price bounds by category and the per-row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .classify import category_of, valid_product_name, valid_product_url
from .text import blank_to_null, clean_price, clean_text, joined_lower, let, package_count_of, volume_ml


def _limit(label: Column, position: int) -> Column:
    names = [name for name in K.PRICE_LIMITS if name != K.DEFAULT_CATEGORY]
    cases = reduce(lambda acc, n: acc.when(label == n, K.PRICE_LIMITS[n][position]), names[1:],
                   F.when(label == names[0], K.PRICE_LIMITS[names[0]][position]))
    return cases.otherwise(K.PRICE_LIMITS[K.DEFAULT_CATEGORY][position]).cast("double")


def price_bounds(name: Column, row_category: Column, url: Column, domain: Column,
                 volume: Column | None = None, raw: Column | None = None) -> Column:
    """Lowest and highest plausible price, scaled by pack count and by volume.

    The texts are joined once each: inside ``let`` Spark computes an expression again wherever it stands.
    """
    empty = F.lit(None).cast("string")
    texts = F.struct(joined_lower(row_category, name, url, domain).alias("words"),
                     joined_lower(name, raw if raw is not None else empty).alias("pack"),
                     joined_lower(name, volume if volume is not None else empty).alias("size"))
    facts = let(texts, lambda t: F.struct(
        category_of(t["words"]).alias("label"), package_count_of(t["pack"]).cast("double").alias("count"),
        volume_ml(t["size"]).cast("double").alias("ml")))

    def bounds(f: Column) -> Column:
        label, ml = f["label"], f["ml"]
        scale = (
            F.when(ml.isNull() | (ml == 0), 1.0)
            .when(label.isin("Rượu", "Bia"), F.greatest(F.lit(0.15), F.least(ml / 750, F.lit(4.0))))
            .when(label == "Sữa", F.greatest(F.lit(0.1), F.least(ml / 1000, F.lit(10.0))))
            .otherwise(1.0))
        return F.struct((_limit(label, 0) * f["count"] * scale).cast("long").alias("low"),
                        (_limit(label, 1) * f["count"] * scale).cast("long").alias("high"))

    return let(facts, bounds)


def row_checks(row: dict[str, Column], domain: Column, target: Column | str) -> Column:
    """Struct of booleans: product_name, price, product_url, old_price."""
    target = F.lit(target) if isinstance(target, str) else target
    bounds = price_bounds(F.coalesce(blank_to_null(row["product_name"]), row.get("name", row["product_name"])),
                          row["category"], row["product_url"], domain, row.get("volume_ml"))
    facts = F.struct(clean_price(row["price"]).alias("price"), clean_price(row["old_price"]).alias("old"), bounds.alias("b"))
    prices = let(facts, lambda f: F.struct(
        F.coalesce((f["price"] > 0) & f["price"].between(f["b"]["low"], f["b"]["high"]), F.lit(False)).alias("price"),
        (f["old"].isNull() | f["price"].isNull() | (f["old"] >= f["price"])).alias("old_price")))
    return let(prices, lambda p: F.struct(
        valid_product_name(row["product_name"]).alias("product_name"), p["price"].alias("price"),
        ((target == "product_detail") | F.coalesce(valid_product_url(row["product_url"], domain), F.lit(False))).alias("product_url"),
        p["old_price"].alias("old_price")))


def valid_store(row: dict[str, Column]) -> Column:
    named = reduce(lambda a, b: a | b, [clean_text(row[n]) != "" for n in ("store_name", "store_url", "store_phone")])
    return (clean_text(row["store_address"]) != "") & named
