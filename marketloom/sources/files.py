"""Reading and writing files: stored pages, archives, registries, rule files, job and output files."""

from __future__ import annotations

import email
import quopri
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..operators.common import latest_by_map_safe
from ..operators.extraction import STRUCTURE
from .upsert import upsert

RAW_PAGE = ("raw_page_id string, url string, domain string, page_type string, task_id string, captured_at timestamp, content_type string, "
            "content_length long, status string, content string, metadata map<string,string>")


# --- stored pages ---------------------------------------------------------------------------

def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page lake: parquet partitioned by domain, so a domain filter prunes folders."""
    return spark.read.parquet(folder)


def prepared_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """Pages ready to store: defaults for id, domain, type, length and time. A missing id is made of URL and time, so a task that runs again writes the same."""
    return pages.withColumns({
        "raw_page_id": F.coalesce(X.blank_to_null("raw_page_id"), F.sha1(F.concat_ws("|", "url", F.coalesce("captured_at", as_of).cast("string")).cast("binary"))),
        "domain": F.coalesce(X.blank_to_null("domain"), F.lit("unknown")), "content_type": F.coalesce("content_type", F.lit("mhtml")),
        "content_length": F.octet_length("content").cast("long"), "status": F.coalesce("status", F.lit("pending")),
        "captured_at": F.coalesce("captured_at", as_of)})


def append_pages(pages: DataFrame, folder: str) -> None:
    """Append to the lake. Rebalancing on the domain keeps files large; AQE splits a hot domain."""
    pages.hint("rebalance", "domain").write.mode("append").partitionBy("domain").parquet(folder)


def merged_pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pages with new versions laid over them by id."""
    newest = latest_by_map_safe(new, ["raw_page_id"], ["captured_at"])
    return upsert(stored, newest, ["raw_page_id"], insert_only=["captured_at"])


def decode_text(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes to text: UTF-8 where valid, else the fallback charset."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, fallback))


def resolve_payloads(pages: DataFrame, objects: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """HTML of each page from the first place that has it: inline, object key, file name.

    ``objects`` and ``files`` are binaryFile scans; they join on their path's last part.
    """
    df = pages.withColumn("_body", F.col("content"))
    for key, scan in (("object_key", objects), ("filename", files)):
        if scan is not None:
            found = scan.select(F.regexp_extract("path", r"([^/]+)$", 1).alias(key), decode_text(F.col("content")).alias("_found"))
            df = df.join(found, key, "left").withColumn("_body", F.coalesce("_body", "_found")).drop("_found")
    return df.withColumn("html", F.col("_body")).drop("_body")


def _html_of_archive(payload: bytes | None) -> str | None:
    """First HTML part of a saved web archive, quoted-printable left-overs undone."""
    def text(data: bytes | None) -> str:
        try:
            return (data or b"").decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    if not payload:
        return None
    message = email.message_from_bytes(payload)
    parts = (p for p in message.walk() if p.get_content_type() == "text/html") if message.is_multipart() else iter([message])
    body = next((d for d in (p.get_payload(decode=True) for p in parts) if d), None)
    html = None if body is None else text(body)
    return text(quopri.decodestring(html.encode("utf-8"))) if html and "=3D" in html else html


def decode_archives(files: DataFrame) -> DataFrame:
    """HTML of web-archive files from a binaryFile scan: (path, html)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "html": [_html_of_archive(c) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, html string")


# --- registries and rules -------------------------------------------------------------------

def read_source_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a source registry file; blank rows are skipped.

    A file without the required columns is an error before any row is read.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    return split_source_rows(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]))


def split_source_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = [c for c in K.SOURCE_CSV_REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing CSV columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    keys = [c for c in raw.columns if c not in K.SOURCE_CSV_COLUMNS]
    rows = raw.select(*keys, *[text(c).alias(c) for c in K.SOURCE_CSV_COLUMNS])
    rows = rows.filter(F.concat(*K.SOURCE_CSV_COLUMNS) != "")
    whole = (F.col("name") != "") & (F.col("url") != "") & (F.col("type") != "") & (F.col("category") != "")
    return rows.filter(whole), rows.filter(~whole)


def import_counts(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    return valid.select(F.lit(1).alias("ok")).unionAll(rejected.select(F.lit(0).alias("ok"))).agg(
        F.count("*").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).alias("imported"),
        F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("failed"))


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """Rule files, one JSON each: domain from the rule or else the file name; malformed files skipped. A container selector stands in for a missing item selector."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    sections = STRUCTURE.replace("item_selector:string", "item_selector:string,container_selector:string")
    parsed = text.filter(F.try_parse_json("value").isNotNull()).withColumn("rule", F.from_json("value", f"struct<domain:string,{sections[len('struct<'):]}"))

    def section(name: str) -> Column:
        s = F.col("rule")[name]
        item = F.coalesce(X.blank_to_null(s["item_selector"]), X.blank_to_null(s["container_selector"]))
        return F.when(s.isNotNull(), F.struct(item.alias("item_selector"), s["fields"].alias("fields")))

    return parsed.select(
        F.lower(F.coalesce(X.blank_to_null(F.col("rule")["domain"]), F.regexp_replace("file", r"\.json$", ""))).alias("domain"),
        F.struct(*[section(t).alias(t) for t in ("listing", "product_detail", "stores")]).alias("structure"),
        F.substring(F.sha2(F.to_json("rule").cast("binary"), 256), 1, 16).alias("version"))


def category_rules(rules: DataFrame) -> DataFrame:
    """Keywords of the active category rules as (category, keyword, priority); the built-in ones when there are none."""
    active = rules.filter("is_active").select("category", F.explode("keywords").alias("keyword"), "priority").withColumn("keyword", F.lower("keyword"))
    if not active.isEmpty():
        return active
    rows = [(name, word, -place) for place, (name, words) in enumerate(K.CATEGORY_KEYWORDS) for word in words]
    return rules.sparkSession.createDataFrame(rows, "category string, keyword string, priority int")


# --- output and job files -------------------------------------------------------------------

OUTPUT = ("source_site string, products array<struct<name:string,product_name:string,price:string,price_numeric:string,url:string,product_url:string,"
          "brand:string,category:string>>")


def read_output_files(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """Products of output files, newest file first; the source defaults to the file name's start.

    ``multi_line=False`` reads files of one JSON document per line, which Spark can split.
    """
    files = spark.read.schema(OUTPUT).json(path, multiLine=multi_line).select("*", "_metadata.file_name", "_metadata.file_modification_time")
    p = F.col("p")
    rows = files.select("source_site", "file_name", "file_modification_time", F.explode("products").alias("p")).select(
        X.first_present(p["name"], p["product_name"]).alias("name"),
        F.coalesce(X.blank_to_null("source_site"), F.regexp_extract("file_name", r"^([^_.]+)", 1)).alias("source"),
        F.coalesce(p["price"], p["price_numeric"]).alias("price"), X.first_present(p["url"], p["product_url"]).alias("url"),
        p["brand"].alias("brand"), F.coalesce(p["category"], F.lit(K.DEFAULT_CATEGORY)).alias("category"),
        F.col("file_modification_time").alias("updated_at")).filter("name IS NOT NULL")
    rows = rows.orderBy(F.desc("updated_at"), "source", "name")
    return rows if limit is None else rows.limit(limit)


def job_files(metas: DataFrame, outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """Job status from file names: (job_id, source, modified_at) with existence joins.

    ``outputs`` and ``errors`` hold job_id; an error outranks an output.
    """
    done = outputs.select("job_id").distinct().withColumn("done", F.lit(True))
    failed = errors.select("job_id").distinct().withColumn("failed", F.lit(True))
    return metas.join(done, "job_id", "left").join(failed, "job_id", "left").select(
        F.col("job_id").alias("id"), F.col("job_id").alias("filename"), "source",
        F.when(F.col("failed"), "Failed").when(F.col("done"), "Completed").otherwise("Pending").alias("status"),
        F.col("modified_at").alias("timestamp"))


def scan_jobs(spark: SparkSession, raw: str, outputs: str | None = None, limit: int | None = None) -> DataFrame:
    """Jobs of a folder tree of ``<id>.meta.json`` files, newest first with a ``limit``.

    The source is the ``domain`` a meta file names or else its folder; a meta file that is no JSON object is no job. A job has failed
    if ``<id>.error`` lies beside its meta file, and is complete if the name of an output file holds its id anywhere.
    Only meta files are opened; the other files are known by the listing. ``outputs`` defaults to ``raw``.
    """
    decoded = lambda c: F.url_decode(F.replace(F.regexp_replace(c, "^file:/+", "/"), F.lit("+"), F.lit("%2B"))).alias("path")
    tree = lambda reader, pattern: reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    # A scan leaves out empty files, which an error mark may be, so the names come from Spark's own index of the folder.
    listed = lambda folder, pattern: spark.createDataFrame(
        [(name,) for name in tree(spark.read.format("binaryFile"), pattern).load(folder).inputFiles()], "path string").select(decoded("path"))
    stem = lambda suffix: F.regexp_replace("file", suffix, "")
    named = lambda df: df.withColumns({"file": F.regexp_extract("path", r"([^/]+)$", 1), "folder": F.regexp_extract("path", r"^(.*)/[^/]+$", 1)})
    metas = tree(spark.read, "*.meta.json").text(raw, wholetext=True).select(
        "value", decoded("_metadata.file_path"), F.col("_metadata.file_modification_time").alias("modified_at"))
    domain = F.get_json_object("value", "$.domain")
    metas = named(metas.filter(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))).select(
        stem(r"\.meta\.json$").alias("job_id"), "folder", F.coalesce(domain, F.regexp_extract("folder", r"([^/]+)$", 1)).alias("source"), "modified_at")
    errors = named(listed(raw, "*.error")).select(stem(r"\.error$").alias("job_id"), "folder").distinct().withColumn("failed", F.lit(True))
    # An id inside a name: the name's pieces of the lengths that ids have, which file systems keep under 256.
    lengths = sorted(r[0] for r in metas.select(F.length("job_id")).distinct().collect())
    files = named(listed(outputs or raw, "*.json")).filter(~F.col("file").endswith(".meta.json")).select("file").distinct()
    none = F.array().cast("array<string>")

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("file") - (n - 1))
        return F.when(F.length("file") >= n, F.transform(starts, lambda i: F.substr(F.col("file"), i, F.lit(n)))).otherwise(none)

    done = files.select(F.explode(F.flatten(F.array(none, *[pieces(n) for n in lengths]))).alias("job_id")).distinct().withColumn("done", F.lit(True))
    jobs = metas.join(errors, ["job_id", "folder"], "left").join(done, "job_id", "left").select(
        F.col("job_id").alias("id"), F.col("job_id").alias("filename"), "source",
        F.when(F.col("failed"), "Failed").when(F.col("done"), "Completed").otherwise("Pending").alias("status"), F.col("modified_at").alias("timestamp"))
    return jobs if limit is None else jobs.orderBy(F.desc("timestamp"), "id").limit(limit)


def write_named_files(files: DataFrame, folder: str) -> None:
    """Write one file per row (path below ``folder``, text), in the tasks; a task that runs again writes the same files."""
    base = folder if "://" in folder or not folder.startswith("file:") else folder[len("file:"):]

    def run(rows) -> None:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        for row in rows:
            store.create_dir(f"{root}/{row.path}".rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{root}/{row.path}") as out:
                out.write(row.text.encode())

    files.select("path", "text").foreachPartition(run)


def write_json_lines(results: DataFrame, folder: str) -> None:
    results.write.mode("overwrite").json(folder)


def append_rows(rows: DataFrame, folder: str) -> None:
    """Append-only sink for events and quarantine."""
    rows.write.mode("append").parquet(folder)
