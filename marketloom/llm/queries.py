"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import alignment, decontaminate, hard_negatives, language, licenses, minhash, mixing, quality_model, quality_rules, sharding, suffixes, url_lists, warc
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, folder: ship_package(spark) or build(spark, folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


#: The driver has no lists and no fetch times, so both are derived from all pages: a fetch time from the id, a log of
#: three entries for every host, every site (last three labels) and every address that was captured more than once.
FETCHED = "SELECT page_id, url, 1704067200 + (page_id * 7919) % 31536000 AS fetched_s FROM pages"
NAMED = """
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
           regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://', '') AS address FROM pages"""
LISTED = """
    SELECT CASE WHEN sum(page_id) % 2 = 0 THEN 'malware' ELSE 'adult' END AS list, 'host' AS kind, host AS key, sum(page_id) AS ids, count(*) AS n FROM named GROUP BY host
    UNION ALL
    SELECT 'tracking' AS list, 'domain' AS kind, key, sum(page_id) AS ids, count(*) AS n
    FROM (SELECT page_id, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS key FROM named) AS sites GROUP BY key HAVING sum(page_id) % 3 = 0
    UNION ALL
    SELECT 'reported' AS list, 'url' AS kind, address AS key, sum(page_id) AS ids, count(*) AS n FROM named GROUP BY address HAVING count(*) > 1"""
LOG = " UNION ALL ".join(
    f"SELECT list, kind, key, '{action}' AS action, 1704067200 + 86400 * (ids % 170 + {days}) AS at_s FROM listed"
    for action, days in (("add", "0"), ("remove", "20 + n % 50"), ("add", "110 + n % 40")))


@query("op10_url_lists", sql=f"""
    WITH named AS ({NAMED}), listed AS ({LISTED}), log AS ({LOG}), fetched AS ({FETCHED}),
    keyed AS (
        SELECT f.page_id, f.url, f.fetched_s, 'host' AS kind, n.host AS key FROM fetched f JOIN named n USING (page_id)
        UNION ALL SELECT f.page_id, f.url, f.fetched_s, 'url', n.address FROM fetched f JOIN named n USING (page_id)
        UNION ALL SELECT f.page_id, f.url, f.fetched_s, 'domain', regexp_extract(n.host, '([^.]+[.][^.]+[.][^.]+)$', 1) FROM fetched f JOIN named n USING (page_id)),
    last AS (SELECT page_id, list, kind, arg_max(action, at_s) AS action FROM keyed JOIN log USING (kind, key) WHERE at_s <= fetched_s GROUP BY page_id, list, kind, key)
    SELECT f.page_id, f.fetched_s, count(DISTINCT l.list) AS n_lists, coalesce(string_agg(DISTINCT l.list, ',' ORDER BY l.list), '') AS lists,
           CASE min(CASE l.kind WHEN 'url' THEN 1 WHEN 'prefix' THEN 2 WHEN 'host' THEN 3 WHEN 'domain' THEN 4 END) WHEN 1 THEN 'url' WHEN 3 THEN 'host' WHEN 4 THEN 'domain' END AS matched,
           count(l.list) = 0 AS kept
    FROM fetched f LEFT JOIN (SELECT * FROM last WHERE action = 'add') l ON f.page_id = l.page_id GROUP BY f.page_id, f.fetched_s""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against the lists in force when it was fetched."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    fetched = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 31536000))
    log = spark.sql(f"WITH named AS ({NAMED.replace('FROM pages', 'FROM {pages}')}), listed AS ({LISTED}) {LOG}", pages=pages).withColumn("at", F.timestamp_seconds("at_s"))
    found = url_lists.lists_at_fetch(fetched, log)
    lists = F.coalesce("active.lists", F.array().cast("array<string>"))
    return found.select("page_id", F.unix_timestamp("fetched_at").alias("fetched_s"), F.size(lists).cast("long").alias("n_lists"), F.array_join(lists, ",").alias("lists"), F.col("active.kind").alias("matched"), (F.size(lists) == 0).alias("kept"))


@query("op6_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and place. The law is ``key``, so equal texts go where their ids send them."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.sharded(sized, size="size").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op8_mixing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    rows = mixing.mixed_documents(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rows.select(F.col("k0").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's counts and verdict; cutoffs per language from all labelled documents."""
    measured = quality_rules.measured_documents(table(spark, folder, "documents"))
    limits = quality_rules.cutoffs(measured, table(spark, folder, "labels"), "lang")
    m = F.col("m")
    return quality_rules.judged(measured, limits, "lang").select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), quality_rules.base_failed(m).alias("base_failed"), "kept")


@query("op4_quality_model")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's chance of label 1."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weights = quality_model.learn(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_model.score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_model.CUTOFF).cast("int"))


@query("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language by the shortest code."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    trees = language.learn(docs)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), language.predict(F.col("text"), trees).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every benchmark item found in a document, with its place in bytes."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op3_minhash", sql=f"""
    WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's group of near copies."""
    groups = minhash.grouped(table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


@query("op1_licenses")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every paragraph that speaks of a licence: its family, or unknown."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op7_suffixes")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """What every document keeps once its repeated strings are taken out."""
    return suffixes.digests(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_warc", sql="""
    WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    sized AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM bodies),
    tops AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest, payload_bytes)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
    FROM sized LEFT JOIN tops USING (payload_digest, payload_bytes)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as the archives give it back."""
    return warc.archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_hard_negatives", sql="""
    WITH q AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) <= 5""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest rows of other labels, for every hundredth id and each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), label=label, anchor=F.col("vec_id") % 100 == 0)


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens of two tokenizers, aligned by bytes, with corpus-wide counts of the id pairs."""
    return alignment.aligned(table(spark, folder, "documents").select("doc_id", "text"))
