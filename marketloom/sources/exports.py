"""Exports: registry and price-list CSV, batch tables as text, and the dataset bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.analytics import product_master


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(value, F.lit(default)).alias(name)


def source_csv_rows(sources: DataFrame) -> DataFrame:
    return sources.select(*[_text(sources, c) for c in K.SOURCE_CSV_COLUMNS])


def product_csv_rows(products: DataFrame) -> DataFrame:
    """Price list rows of a product view: 23 text columns, NULL as empty, currency VND by default."""
    return products.select(*[_text(products, c, "VND" if c == "currency" else "") for c in K.PRODUCT_CSV_COLUMNS])


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("quoteAll", False).csv(folder)


def with_bom(rows: DataFrame) -> DataFrame:
    """Rows whose first column name starts with a byte-order mark, for spreadsheet programs."""
    return rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])


def _csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _markdown_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def batch_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """CSV and Markdown text of each batch (batch_id, position, columns). A batch is one small
    document by its nature, so it is built as one value."""
    csv = F.concat_ws(",", *[_csv_cell(F.col(c)) for c in columns])
    mark = F.concat(F.lit("| "), F.concat_ws(" | ", *[_markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))
    lines = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("position", csv.alias("csv"), mark.alias("mark")))).alias("l"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    body = lambda field, end: F.array_join(F.transform("l", lambda x: x[field]), end)
    return lines.select("batch_id", F.concat(F.lit(",".join(columns) + "\n"), body("csv", "\n")).alias("csv"),
                        F.concat(F.lit(head + "\n"), body("mark", "\n")).alias("markdown"))


def dataset_bundle(products: DataFrame, offers: DataFrame, observations: DataFrame, sources: DataFrame,
                   pages: DataFrame) -> dict[str, DataFrame]:
    """The six export tables. ``products`` carries canonical ids and matching features."""
    listings = offers.join(products.select("product_id", "canonical_product_id", "brand", "category"), "product_id", "left")
    places = observations.join(products.select("product_id", "store_name", "store_address"), "product_id", "left").withColumns({
        "city": F.trim(F.element_at(F.split("store_address", ","), -1)), "month": F.date_format("observed_at", "yyyy-MM")})
    attributes = products.select("product_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")) for n in ("volume_ml", "abv_percent", "pack_size")])).alias("a")).select(
        "product_id", "a.attribute", "a.value").filter("value IS NOT NULL")
    queued = pages.groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "pending").alias("pending"), F.max("captured_at").alias("latest_data_at"))
    return {
        "products": product_master(products),
        "listings": listings.select("offer_id", "product_id", "canonical_product_id", "brand", "category", "domain", "store_name", "store_address", "price_numeric"),
        "price_history": observations.select("observation_id", "product_id", "domain", "observed_at", "price_numeric"),
        "space_time_observations": places.select("observation_id", "product_id", "city", "store_name", "month", "observed_at", "price_numeric"),
        "product_attributes": attributes,
        "sources_status": sources.join(queued, "domain", "left").select(
            "source_id", "name", "domain", "category", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("pending", F.lit(0)).alias("pending"), "latest_data_at"),
    }
