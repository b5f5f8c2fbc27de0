"""Rule versions, candidates and attempts, and upkeep of pages, observations and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.keyed import KeyedTable
from .common import latest_by_map_safe, top_per_group

RULE = ["structure", "version", "score", "candidate_id"]


def candidate_rows(drafts: DataFrame, as_of: Column) -> DataFrame:
    """Candidates of judged drafts: id from domain, content and version; status by acceptance."""
    cid = F.concat_ws(":", "domain", X.blank_to_null("content_hash"), "version")
    return drafts.withColumns({"candidate_id": cid, "status": F.when(F.col("accepted"), "validated").otherwise("rejected"),
                               "score": F.coalesce("score", F.lit(0.0)), "updated_at": as_of})


def needs_generation(work: DataFrame, candidates: DataFrame, attempts: DataFrame, as_of: Column, rejected_ttl: int | None = None) -> DataFrame:
    """Work items (domain, content_hash, model) not judged yet and not cooling down.

    A rejection counts for ``rejected_ttl`` seconds only; any other status counts for good.
    """
    judged = candidates
    if rejected_ttl is not None:
        judged = judged.filter((F.col("status") != "rejected") | (F.col("updated_at") >= F.timestamp_add("SECOND", F.lit(-rejected_ttl), as_of)))
    cooling = attempts.filter(F.col("retry_after") > as_of)
    keys = ["domain", "content_hash", "model"]
    return work.join(judged.select(*keys), keys, "left_anti").join(cooling.select(*keys), keys, "left_anti")


def attempt_log(events: DataFrame, cooldown: Column) -> DataFrame:
    """Attempt state per (domain, content_hash): count, last outcome and earliest retry."""
    last = F.max(F.struct("attempted_at", "status", "model", "error"))
    state = events.groupBy("domain", "content_hash").agg(F.count("*").alias("attempt_count"), last.alias("l")).select(
        "domain", "content_hash", "attempt_count", F.col("l")["attempted_at"].alias("updated_at"),
        *[F.col("l")[c].alias(c) for c in ("status", "model", "error")])
    return state.withColumn("retry_after", F.when(F.col("status") == "failed", F.timestamp_add("SECOND", cooldown, F.col("updated_at"))))


def promote(active: DataFrame, candidates: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new active rules, retired versions, outcomes) after the best candidate per domain.

    ``active``: domain, structure, version, score, candidate_id. ``candidates`` adds status and
    expected_version. A higher active score or an unexpected active version blocks promotion.
    """
    best = candidates.filter("status = 'validated'").groupBy("domain").agg(
        F.max_by(F.struct("candidate_id", "structure", "version", "score", "expected_version"), F.struct("score", "candidate_id")).alias("c"))
    both = active.withColumn("_held", F.lit(True)).join(best, "domain", "full_outer")
    held = F.coalesce("_held", F.lit(False))
    c = F.col("c")
    conflict = held & (F.coalesce(c["expected_version"], F.lit("")) != "") & (c["expected_version"] != F.col("version"))
    lower = held & (F.coalesce("score", F.lit(0.0)) > c["score"])
    both = both.withColumn("outcome", F.when(c.isNull(), "kept").when(conflict, "conflict").when(lower, "candidate_score_lower").otherwise("promoted"))
    take = F.col("outcome") == "promoted"
    pick = lambda n: F.when(take, c[n]).otherwise(F.col(n)).alias(n)
    now = both.filter(held | take).select("domain", *[pick(n) for n in RULE])
    retired = both.filter(take & held).select("domain", "structure", "version", "score", F.lit("retired").alias("status"), as_of.alias("created_at"))
    outcomes = both.filter(c.isNotNull()).select("domain", c["candidate_id"].alias("candidate_id"), "outcome", F.when(take, c["version"]).otherwise(F.col("version")).alias("version"))
    return now, retired, outcomes


def rollback(active: DataFrame, history: DataFrame, as_of: Column, versions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(active rules, retired versions) after going back to the newest, or a given, old version."""
    past = history if versions is None else history.join(versions.select("domain", "version"), ["domain", "version"], "left_semi")
    last = past.groupBy("domain").agg(F.max_by(F.struct("structure", "version", "score"), F.struct("created_at", "version")).alias("h"))
    both = active.join(last, "domain", "left")
    back = F.col("h").isNotNull()
    now = both.select("domain", *[F.when(back, F.col("h")[n]).otherwise(F.col(n)).alias(n) for n in ("structure", "version", "score")])
    retired = both.filter(back).select("domain", "structure", "version", "score", F.lit("retired").alias("status"), as_of.alias("created_at"))
    return now, retired


def save_rules(active: DataFrame, edits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active rules, retired versions, conflicts) after edits (domain, structure, version, expected_version).

    An edit is refused when the active version is not the expected one. History gains a row only
    when the version really changes.
    """
    new = edits.select("domain", F.struct("structure", "version", "expected_version").alias("e"))
    both = active.withColumn("_held", F.lit(True)).join(new, "domain", "full_outer")
    held, e = F.coalesce("_held", F.lit(False)), F.col("e")
    refused = e.isNotNull() & (F.coalesce(e["expected_version"], F.lit("")) != "") & F.coalesce(e["expected_version"] != F.col("version"), F.lit(True))
    both = both.withColumn("_refused", F.coalesce(refused, F.lit(False)))
    take = e.isNotNull() & ~F.col("_refused")
    now = both.filter(held | take).select("domain", *[F.when(take, e[n]).otherwise(F.col(n)).alias(n) for n in ("structure", "version")])
    retired = both.filter(take & held & (e["version"] != F.col("version"))).select(
        "domain", "structure", "version", F.lit("retired").alias("status"), as_of.alias("created_at"))
    return now, retired, both.filter("_refused").select("domain", "version")


def reused_rules(verdicts: DataFrame) -> DataFrame:
    """Active rules that still pass on the present samples, with the targets that passed."""
    return verdicts.filter("accepted").select("domain", "score", F.col("passed_targets").alias("allowed_targets"))


def rule_summaries(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets, field count and stored pages per rule domain."""
    fields = {t: F.coalesce(F.size(F.col("structure")[t]["fields"]), F.lit(0)) for t in ("listing", "product_detail", "stores")}
    counts = pages.groupBy("domain").agg(F.count("*").alias("raw_page_count"))
    return rules.join(counts, "domain", "left").select(
        "domain", F.array_compact(F.array(*[F.when(n > 0, t) for t, n in fields.items()])).alias("targets"),
        sum(fields.values(), F.lit(0)).alias("field_count"), "version", F.coalesce("raw_page_count", F.lit(0)).alias("raw_page_count"),
        (F.coalesce("raw_page_count", F.lit(0)) > 0).alias("has_raw_page"))


def next_versions(prompts: DataFrame, new: DataFrame) -> DataFrame:
    """New prompt texts (key, content, position) numbered after the highest version of their key.

    Texts are few per key and are edited by hand.
    """
    from pyspark.sql import Window
    top = prompts.groupBy("key").agg(F.max("version").alias("top"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("position"))
    return new.withColumn("_place", place).join(top, "key", "left").select(
        "key", (F.coalesce("top", F.lit(0)) + F.col("_place")).alias("version"), "content")


def latest_prompts(prompts: DataFrame) -> DataFrame:
    return latest_by_map_safe(prompts, ["key"], ["version"])


# --- upkeep ---------------------------------------------------------------------------------

def retained_pages(pages: DataFrame, as_of: Column, days: int = 14, per_domain: int = 100) -> DataFrame:
    """Pages to keep: those not older than the limit, then the newest per domain.

    A page without a capture time is of no known age and stays; like a page without a domain it is in no top list.
    """
    young = pages.filter(F.coalesce(F.col("captured_at") >= F.timestamp_add("DAY", F.lit(-days), as_of), F.lit(True)))
    if per_domain <= 0:
        return young
    placed = F.col("captured_at").isNotNull() & F.col("domain").isNotNull()
    return young.filter(~placed).unionByName(top_per_group(young.filter(placed), ["domain"], [F.desc("captured_at"), F.col("raw_page_id")], per_domain))


#: A day of one product, in figures that can be added to those of other observations of that day.
DAY_SUMMARY = ("product_id string, date date, price_sum double, observation_count long, min_price double, max_price double, "
               "last struct<observed_at:timestamp,observation_id:string,price_numeric:double,domain:string,source_id:string,currency:string>")


def day_summaries(observations: DataFrame, before: Column | None = None) -> DataFrame:
    """:data:`DAY_SUMMARY` rows of observations before a cutoff. Prices that are not positive count for the latest only."""
    rows = observations.filter(F.col("product_id").isNotNull() & F.col("observed_at").isNotNull())
    if before is not None:
        rows = rows.filter(F.col("observed_at") < before)
    number = F.col("price_numeric").cast("double")
    price = F.when(number > 0, number)
    last = F.struct(F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("observation_id").cast("string").alias("observation_id"),
                    number.alias("price_numeric"), "domain", "source_id", "currency")
    return rows.groupBy("product_id", F.to_date("observed_at").alias("date")).agg(
        F.coalesce(F.sum(price), F.lit(0.0)).alias("price_sum"), F.count(price).alias("observation_count"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.max(last).alias("last"))


def merge_summaries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored days with fresh ones added: sums and counts add up, extremes and the latest observation compare."""
    return stored.unionByName(fresh.select(*stored.columns)).groupBy("product_id", "date").agg(
        *[F.sum(c).alias(c) for c in ("price_sum", "observation_count")], F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"), F.max("last").alias("last"))


def as_daily(summaries: DataFrame) -> DataFrame:
    """Daily rows of the days that have a positive price."""
    last = F.col("last")
    return summaries.filter("observation_count > 0").select(
        "product_id", "date", last["domain"].alias("domain"), last["source_id"].alias("source_id"), F.coalesce(last["currency"], F.lit("VND")).alias("currency"),
        "min_price", "max_price", F.round(F.col("price_sum") / F.col("observation_count"), 2).alias("avg_price"), last["price_numeric"].alias("latest_price"), "observation_count")


def daily_prices(observations: DataFrame, before: Column | None = None) -> DataFrame:
    """Daily low, high, mean, latest and count per product, of positive prices before a cutoff."""
    return as_daily(day_summaries(observations, before))


def compact_observations(observations: DataFrame, as_of: Column, retention_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(daily rows of what is older than the retention, observations that stay); one without a time stays."""
    cutoff = F.timestamp_add("DAY", F.lit(-max(1, retention_days)), as_of)
    return daily_prices(observations, cutoff), observations.filter(F.coalesce(F.col("observed_at") >= cutoff, F.lit(True)))


def compact_into(table: KeyedTable, observations: DataFrame, as_of: Column, run: int, retention_days: int = 90) -> DataFrame:
    """Add what is older than the retention to a table of :data:`DAY_SUMMARY` rows keyed by product; returns the observations that stay.

    A day that is there already takes late observations in. ``run`` numbers the compactions: one that is started again
    after it was published, before its observations were removed, adds nothing twice.
    """
    cutoff = F.timestamp_add("DAY", F.lit(-max(1, retention_days)), as_of)
    table.merge(day_summaries(observations, cutoff), "compaction", run, merge_summaries)
    return observations.filter(F.coalesce(F.col("observed_at") >= cutoff, F.lit(True)))


def backfill_schema(products: DataFrame, as_of: Column) -> DataFrame:
    """Bring legacy product rows to the present schema; rows already there stay as they are."""
    legacy_store = F.coalesce(F.map_contains_key("raw_data", F.lit("store_id")), F.lit(False)) | (
        F.col("store_id").isNotNull() if "store_id" in products.columns else F.lit(False))
    hit = legacy_store | (F.col("store_address") == "Online") | F.col("data_origin").isNull() | F.col("field_sources").isNull() | F.col("address_status").isNull()
    hit = F.coalesce(hit, F.lit(False))
    out = products.withColumn("_hit", hit).withColumns({
        "data_origin": F.when(F.col("_hit"), "legacy").otherwise(F.col("data_origin")),
        "field_sources": F.when(F.col("_hit"), F.create_map().cast("map<string,string>")).otherwise(F.col("field_sources")),
        "address_status": F.when(F.col("_hit"), "NOT_APPLICABLE").otherwise(F.col("address_status")),
        "store_channel": F.when(F.col("_hit"), "online").otherwise(F.col("store_channel")),
        "store_address": F.when(F.col("store_address") != "Online", F.col("store_address")),
        "raw_data": F.map_filter("raw_data", lambda k, v: k != "store_id"),
        "schema_migrated_at": F.when(F.col("_hit"), as_of)})
    return out.drop("_hit", "store_id")
