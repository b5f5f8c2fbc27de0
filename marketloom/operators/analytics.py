"""Search, views, price statistics and counts over product, offer and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.classify import category_of, job_bucket, job_label, source_group
from ..functions.urls import is_url_like, name_from_url, without_www
from .common import eq_filters, side_by_side, skip_all


# --- search and views -----------------------------------------------------------------------

def search_products(products: DataFrame, text: str | None = None, category_name: str | None = None,
                    source: str | None = None, store: str | None = None, limit: int | None = 80) -> DataFrame:
    """Newest products matching all given filters. The filters reach the scan; the limit is a top-k."""
    df = eq_filters(products, domain=source)
    if not skip_all(category_name):
        df = df.filter((F.col("category") == category_name) | (F.col("normalized_category") == category_name))
    for words, names in ((store, ("store_name", "store_url", "store_address")), (text, ("product_name", "canonical_name", "product_url"))):
        if words:
            hits = [F.col(n).ilike(f"%{words}%") for n in names]
            df = df.filter(hits[0] | hits[1] | hits[2])
    df = df.orderBy(F.desc("updated_at"), "product_id")
    return df if limit is None else df.limit(limit)


def product_view(products: DataFrame, rules: list | None = None) -> DataFrame:
    """Display view of products: repaired names, positive prices, category by keyword."""
    have = lambda n: F.col(n) if n in products.columns else F.lit(None).cast("string")
    raw = lambda n: F.try_element_at("raw_data", F.lit(n)) if "raw_data" in products.columns else F.lit(None).cast("string")
    df = products.withColumns({
        "_price": F.when(F.coalesce(F.col("price_numeric"), F.lit(0.0)) > 0, F.col("price_numeric")),
        "_name": X.first_present(have("product_name"), have("name"), have("canonical_name"))})
    df = df.withColumn("_url", F.coalesce(X.blank_to_null(have("product_url")), F.when(is_url_like("_name"), F.col("_name"))))
    df = df.withColumn("_name", F.when(is_url_like("_name"), name_from_url("_name")).when(
        F.col("_name").isNull(), name_from_url("_url")).otherwise(F.col("_name")))
    either = lambda n: F.coalesce(X.blank_to_null(have(n)), X.blank_to_null(raw(n)))
    df = df.withColumn("_words", X.joined_lower(
        F.coalesce(X.blank_to_null(have("category")), have("normalized_category")), F.col("_name"), F.col("_url"), F.col("domain")))
    label = category_of(F.col("_words"), rules)
    plain = ["brand", "image_url", "data_origin", "rule_version", "extraction_method", "canonical_product_id", "canonical_key"]
    numbers = ["validation_score", "canonical_match_score"]
    return df.select(
        "product_id", F.col("_name").alias("name"), F.col("_price").alias("price"), F.col("_price").alias("price_numeric"),
        F.coalesce(X.blank_to_null(have("price_status")), F.when(F.col("_price") > 0, "FOUND").otherwise("MISSING")).alias("price_status"),
        (F.col("old_price") if "old_price" in products.columns else F.lit(None).cast("double")).alias("original_price"),
        F.coalesce(have("currency"), F.lit("VND")).alias("currency"), F.col("_url").alias("url"), F.col("domain").alias("source"),
        label.alias("category"), *[F.coalesce(either(n), F.lit("")).alias(n) for n in ("store_name", "store_url", "store_phone")],
        either("store_address").alias("store_address"), either("store_channel").alias("store_channel"),
        F.coalesce(either("address_status"), F.lit("MISSING")).alias("address_status"),
        *[have(n).alias(n) for n in plain],
        *[(F.col(n) if n in products.columns else F.lit(None).cast("double")).alias(n) for n in numbers], "updated_at")


def raw_page_view(pages: DataFrame) -> DataFrame:
    """Listing view of stored pages with a display status; falls back to the page id as task id."""
    return pages.select(
        F.col("raw_page_id").alias("id"),
        F.concat("raw_page_id", F.lit("."), F.coalesce("content_type", F.lit("mhtml"))).alias("filename"),
        F.concat(F.lit("pg://sc_raw_pages/"), "raw_page_id").alias("path"),
        F.coalesce(X.blank_to_null("domain"), F.lit("unknown")).alias("domain"),
        F.coalesce(X.blank_to_null("task_id"), "raw_page_id").alias("task_id"), "url",
        F.coalesce("page_type", F.lit("unknown")).alias("page_type"), F.col("content_length").alias("size"),
        F.col("captured_at").alias("updated_at"), job_label("status").alias("status"))


def job_view(pages: DataFrame, limit: int | None = 50) -> DataFrame:
    view = raw_page_view(pages).select(
        F.col("task_id").alias("id"), "filename", F.col("domain").alias("source"), "status", F.col("updated_at").alias("timestamp"))
    view = view.orderBy(F.desc("timestamp"), "id")
    return view if limit is None else view.limit(limit)


def source_view(sources: DataFrame) -> DataFrame:
    """Source registry with defaults filled in, newest first."""
    return sources.select(
        F.col("source_id").alias("id"), "name", F.coalesce(X.blank_to_null("url"), "base_url").alias("url"), "type", "category", "note",
        "domain", F.coalesce("store_scope", F.lit("site")).alias("store_scope"), "store_name", "store_url", "store_address",
        "store_phone", F.coalesce("store_channel", F.lit("online")).alias("store_channel"),
        F.coalesce("auto_promote_rules", F.lit(True)).alias("auto_promote_rules"),
        F.coalesce("quality_gate_enabled", F.lit(True)).alias("quality_gate_enabled"),
        F.coalesce("important", F.lit(False)).alias("important"), "updated_at").orderBy(F.desc("updated_at"))


def list_rows(df: DataFrame, order: list[Column], limit: int | None, **wanted: str | None) -> DataFrame:
    """Filtered, ordered, limited listing of candidates, reviews or runs."""
    out = eq_filters(df, **wanted).orderBy(*order)
    return out if limit is None else out.limit(limit)


def dedup_queue_list(queue: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Pending pairs first, then by falling confidence."""
    return list_rows(queue, [(F.col("status") != "pending").asc(), F.desc("confidence"), F.asc("candidate_id")], limit, status=status)


def text_filter(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return df.filter(joined.contains(query.lower()))


STATUS_CLASSES = {"running": ["running", "queued"], "warning": ["blocked", "failed"]}


def pipeline_filter(pipelines: DataFrame, state: str = "all", keyword: str = "") -> DataFrame:
    """Pipelines by status class (running, warning, off) and keyword in name, mode or entry URLs."""
    df = pipelines
    if state in STATUS_CLASSES:
        df = df.filter(F.col("last_run_status").isin(STATUS_CLASSES[state]))
    elif state == "off":
        df = df.filter(~F.col("enabled"))
    word = keyword.strip().lower()
    if word:
        fields = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(word) for c in ("name", "description", "mode")]
        in_urls = F.exists("entry_urls", lambda u: F.lower(u).contains(word))
        df = df.filter(fields[0] | fields[1] | fields[2] | F.coalesce(in_urls, F.lit(False)))
    return df


def job_filter(jobs: DataFrame, state: str = "all", query: str = "", source: str = "") -> DataFrame:
    states = {"running": ~F.col("status").isin("Completed", "Failed"), "error": F.col("status") == "Failed", "done": F.col("status") == "Completed"}
    df = jobs.filter(states[state]) if state in states else jobs
    if query:
        hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower()) for c in ("id", "source", "filename")]
        df = df.filter(hits[0] | hits[1] | hits[2])
    return df.filter(F.col("source") == source) if source else df


PIPELINE_DATA = (
    "struct<description:string,mode:string,source_ids:array<string>,entry_urls:array<string>,page_budget:int,max_depth:int,"
    "schedule_type:string,region:string,last_run_id:string,last_run_status:string>"
)


def pipeline_view(pipelines: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Pipelines with their JSON data flattened under the columns; ``latest`` adds run facts."""
    data = F.from_json("data", PIPELINE_DATA)
    df = pipelines.withColumn("_d", data)
    if latest is not None:
        df = df.join(latest, "pipeline_id", "left")
    else:
        df = df.withColumns({"run_id": F.lit(None).cast("string"), "run_status": F.lit(None).cast("string"), "run_count": F.lit(0).cast("long")})
    d = F.col("_d")
    return df.select(
        "pipeline_id", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), d["description"].alias("description"),
        F.coalesce(d["mode"], F.lit("hybrid")).alias("mode"), d["source_ids"].alias("source_ids"), d["entry_urls"].alias("entry_urls"),
        F.coalesce(d["page_budget"], F.lit(100)).alias("page_budget"), F.coalesce(d["max_depth"], F.lit(2)).alias("max_depth"),
        F.coalesce(d["schedule_type"], F.lit("manual")).alias("schedule_type"), F.coalesce(d["region"], F.lit("VN")).alias("region"),
        F.coalesce(F.size(d["source_ids"]), F.lit(0)).alias("source_count"), F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.coalesce(d["last_run_id"], "run_id").alias("last_run_id"), F.coalesce(d["last_run_status"], "run_status").alias("last_run_status"))


def merge_patch(documents: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Map documents with patch maps laid over them; later keys win, ``status`` mirrored to its column."""
    new = patches.select(key, F.col("data").alias("_patch"))
    merged = F.map_concat(F.map_filter("data", lambda k, v: ~F.coalesce(F.map_contains_key("_patch", k), F.lit(False))),
                          F.coalesce("_patch", F.map_filter("data", lambda k, v: F.lit(False))))
    return documents.join(new, key, "left").withColumn("data", merged).withColumn(
        "status", F.coalesce(F.try_element_at("data", F.lit("status")), "status")).drop("_patch")


# --- statistics -----------------------------------------------------------------------------

def product_stats(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("total"), F.countDistinct("domain").alias("sources"))


def product_sources(products: DataFrame) -> DataFrame:
    """Distinct domains in order with ``all`` in front."""
    found = products.filter(F.coalesce("domain", F.lit("")) != "").select(F.col("domain").alias("source")).distinct()
    first = products.sparkSession.range(1).select(F.lit("all").alias("source"), F.lit(0).alias("place"))
    return first.unionByName(found.withColumn("place", F.lit(1))).orderBy("place", "source").select("source")


def monthly_price_history(offers: DataFrame, as_of: Column, lookback_days: int = 400) -> DataFrame:
    """Average positive offer price and offer count per month within the look-back."""
    kept = offers.filter((F.col("price_numeric") > 0) & (F.col("updated_at") >= F.timestamp_add("DAY", F.lit(-lookback_days), as_of)))
    return kept.groupBy(F.date_format("updated_at", "yyyy-MM").alias("month")).agg(
        F.round(F.avg("price_numeric"), 0).alias("avg_price"), F.count("*").alias("count"))


def monthly_change(history: DataFrame) -> DataFrame:
    """History with the change against the month before, in percent. One row per month: tiny."""
    before = Window.orderBy("month")
    return history.withColumns({"prev_month": F.lag("month").over(before), "prev_avg_price": F.lag("avg_price").over(before)}).withColumn(
        "change_pct", F.round((F.col("avg_price") - F.col("prev_avg_price")) / F.nullif("prev_avg_price", F.lit(0.0)) * 100, 1))


def market_stats(products: DataFrame, offers: DataFrame, as_of: Column) -> DataFrame:
    """Mean positive price and the trend between the last two months of offers."""
    last = monthly_change(monthly_price_history(offers, as_of)).agg(F.max(F.struct("month", "prev_month", "change_pct")).alias("m"))
    change = F.col("m")["change_pct"]
    trend = F.coalesce(F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("decimal(18,1)").cast("string"), F.lit("% ("),
                                F.col("m")["prev_month"], F.lit(" -> "), F.col("m")["month"], F.lit(")")), F.lit("N/A"))
    price = products.agg(F.coalesce(F.round(F.avg(F.when(F.col("price_numeric") > 0, F.col("price_numeric"))), 0), F.lit(0.0)).alias("avg_price"))
    return side_by_side(price, last).select("avg_price", F.lit("VND").alias("currency"), trend.alias("trend"))


def source_price_comparison(products: DataFrame) -> DataFrame:
    return products.filter((F.col("price_numeric") > 0) & (F.coalesce("source", F.lit("")) != "")).groupBy("source").agg(
        F.round(F.avg("price_numeric"), 0).alias("avg_price"), F.count("*").alias("count")).orderBy("source")


def job_counts(tasks: DataFrame) -> DataFrame:
    """Task counts in the four buckets, all always present; aliased statuses add up."""
    bucket = job_bucket("status")
    return tasks.agg(*[F.count_if(bucket == s).alias(s) for s in ("pending", "processing", "completed", "failed")])


def domain_counts(products: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Products and quarantined rows per domain, one pass over the union of both tables."""
    both = products.select("domain", F.lit(1).alias("p"), F.lit(0).alias("q")).unionAll(
        quarantine.select("domain", F.lit(0).alias("p"), F.lit(1).alias("q")))
    return both.groupBy("domain").agg(F.sum("p").alias("products"), F.sum("q").alias("quarantined"))


def pipeline_overview(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    return side_by_side(pipelines.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled")),
                        runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "running").alias("running")))


def status_totals(df: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """One row with a count per status tab plus ``all``."""
    return df.agg(F.count("*").alias("all"), *[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def success_share(pipelines: DataFrame) -> DataFrame:
    """Completed share of finished last runs in percent; partial runs count as finished."""
    status = F.col("last_run_status")
    finished = F.count_if(status.isin("completed", "failed", "blocked", "partial"))
    return pipelines.agg(F.count_if(status.isin("running", "queued")).alias("running"), F.count_if(status == "completed").alias("completed"),
                         finished.alias("finished"), F.round(F.try_divide(F.count_if(status == "completed") * 100.0, finished), 1).alias("success_pct"))


def source_totals(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count_if("has_raw_data").alias("captured_sources"), F.sum("product_count").alias("total_products"),
                        F.sum("quarantine_count").alias("quarantined"))


def dashboard(products: DataFrame, offers: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """Product, task and market figures in one row."""
    return side_by_side(product_stats(products), job_counts(tasks), market_stats(products, offers, as_of))


def product_master(products: DataFrame) -> DataFrame:
    """One row per canonical product: name, brand, category, listings and price range."""
    first = F.min(F.struct("product_id", "product_name", "brand", "category"))
    return products.groupBy("canonical_product_id").agg(
        first.alias("f"), F.count("*").alias("listing_count"), F.min("price_numeric").alias("min_price"), F.max("price_numeric").alias("max_price")
    ).select("canonical_product_id", F.col("f")["product_name"].alias("canonical_name"), F.col("f")["brand"].alias("brand"),
             F.col("f")["category"].alias("category"), "listing_count", "min_price", "max_price")


# --- joins over the registry ----------------------------------------------------------------

def source_registry(sources: DataFrame, pages: DataFrame, products: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Sources with group, stored-page flag and counts; ``www.`` and bare domains are one site.

    The facts are reduced to one row per bare domain before they meet the registry.
    """
    bare = lambda df: df.withColumn("site", without_www("domain"))
    counts = domain_counts(bare(products).select(F.col("site").alias("domain")), bare(quarantine).select(F.col("site").alias("domain")))
    saved = bare(pages).select("site").distinct().withColumn("has_raw_data", F.lit(True))
    return (bare(sources).join(saved, "site", "left").join(counts.withColumnRenamed("domain", "site"), "site", "left")
            .select(F.col("source_id").alias("id"), "name", "url", "type", "category", source_group("category").alias("group"), "store_channel",
                    F.coalesce("has_raw_data", F.lit(False)).alias("has_raw_data"), F.coalesce("products", F.lit(0)).alias("product_count"),
                    F.coalesce("quarantined", F.lit(0)).alias("quarantine_count")))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run and full run count per pipeline, in one aggregate."""
    return runs.groupBy("pipeline_id").agg(
        F.max(F.struct("created_at", "run_id", "status")).alias("r"), F.count("*").alias("run_count")).select(
        "pipeline_id", F.col("r")["run_id"].alias("run_id"), F.col("r")["status"].alias("run_status"),
        F.col("r")["created_at"].alias("run_at"), "run_count")


def runs_with_names(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    return runs.join(pipelines.select("pipeline_id", F.col("name").alias("pipeline_name")), "pipeline_id", "left")


def apply_store_config(rows: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Overwrite store fields from single-store sources that have any store setting."""
    fields = ["store_name", "store_url", "store_address", "store_phone", "store_channel"]
    ready = sources.filter((F.lower(F.coalesce(X.blank_to_null("store_scope"), F.lit("site"))) == "site")
                           & F.coalesce(*[X.blank_to_null(f) for f in fields]).isNotNull())
    config = ready.select("source_id", F.struct(*fields).alias("_c"))
    c, hit = F.col("_c"), F.col("_c").isNotNull()
    updates = {f: F.when(hit, c[f]).otherwise(F.col(f)) for f in fields if f in rows.columns}
    if "address_status" in rows.columns:
        updates["address_status"] = F.when(hit, F.when(F.coalesce(c["store_address"], F.lit("")) != "", "FOUND").when(
            c["store_channel"] == "online", "NOT_APPLICABLE").otherwise("MISSING")).otherwise(F.col("address_status"))
    updates["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return rows.join(config, "source_id", "left").withColumns(updates).drop("_c")


def find_by_either_key(rows: DataFrame, wanted: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose first or second key is wanted, each once, by equality semi joins instead of one OR join."""
    keys = wanted.select(F.col("job_id").alias("_wanted"))
    by_first = rows.join(keys, F.col(first) == F.col("_wanted"), "left_semi")
    rest = rows.join(keys, F.col(first) == F.col("_wanted"), "left_anti")
    return by_first.unionByName(rest.join(keys, F.col(second) == F.col("_wanted"), "left_semi"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counters and final status per run from its per-source outcomes."""
    outcome = F.col("outcome")
    every = lambda s: F.count_if(outcome == s) == F.count("*")
    return results.groupBy("run_id").agg(
        F.count("*").alias("processed_sources"), F.sum("products").alias("products_written"), F.sum("offers").alias("offers_written"),
        F.count_if(outcome == "failed").alias("failed_sources"), F.count_if(outcome == "blocked").alias("blocked_sources"),
        F.when(every("failed"), "failed").when(every("blocked"), "blocked")
        .when(F.count_if(outcome.isin("failed", "blocked")) > 0, "partial").otherwise("completed").alias("status"))
