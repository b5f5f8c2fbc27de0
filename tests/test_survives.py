"""Malformed pages do not end a job, NULL keys are not lost, a table outlives a broken swap."""

from datetime import datetime

from marketloom.functions import responses
from marketloom.operators import analytics, common, extraction, lifecycle, quality
from marketloom.operators.dom import selector_gaps
from marketloom.operators.pages import evidence_excerpt, keyword_category, selector_previews
from marketloom.sources.files import prepared_pages
from marketloom.sources.upsert import recover_table, upsert
from pyspark.sql import functions as F

FIELD = "struct<name:string,selector:string,attr:string,required:boolean,transform:string>"
RULES = f"domain string, structure struct<listing:struct<item_selector:string,fields:array<{FIELD}>>,product_detail:struct<item_selector:string,fields:array<{FIELD}>>,stores:struct<item_selector:string,fields:array<{FIELD}>>>"


def test_any_page_gives_the_others_their_rows(spark):
    deep = "[" * 20000 + "]" * 20000
    script = lambda body: f"<script type='application/ld+json'>{body}</script>"
    bad = ["<a class=x href='http://[abc'>x</a>", script('{"@type":"Product","name":"n","url":["http://[a","b"],"offers":{"priceCurrency":["VND"]}}'), script(deep), "<![foo bar]><h1>after</h1>", None]
    pages = [(str(i), "a.vn", "https://a.vn/p", "product_detail", html) for i, html in enumerate(bad)] + [("good", "a.vn", "https://a.vn/p", "product_detail", "<h1>Bia</h1><a class=x href=/y>y</a>")]
    fields = [("product_name", "h1", None, True, None), ("product_url", ".x", "href", False, None), ("product_name", "h1:first-child, h1", None, True, None)]
    rules = spark.createDataFrame([("a.vn", (None, (None, fields), None))], RULES)
    read = extraction.choose_rows(extraction.read_pages(spark.createDataFrame(pages, "raw_page_id string, domain string, url string, page_type string, html string"), rules)).collect()
    rows = {r.raw_page_id: r for r in read}
    assert len(rows) == len(pages)
    assert rows["good"].product_rows[0].record["product_name"] == "Bia" and rows["good"].product_rows[0].record["product_url"] == "https://a.vn/y"
    assert rows["3"].product_rows[0].record["product_name"] == "after" and "markup" in rows["3"].read_error
    assert "h1:first-child" in rows["good"].read_error
    assert selector_gaps(".a:first-child, .price") == [".a:first-child"]


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, p long")
    assert sorted((r.k, r.p, r.is_first) for r in common.first_seen(rows, ["k"], "p").collect() if r.k is None) == [(None, 1, True), (None, 2, False)]
    before = {r.p: r.previous for r in common.previous_row(rows, "k", "p", ["p"], F.lit(0)).collect()}
    assert before[1] is None and before[2].p == 1 and before[3] is None


def test_gate_keeps_null_domains_and_obeys_the_source(spark):
    products = spark.createDataFrame([(None, "p1"), ("a", "p2"), ("b", "p3")], "domain string, product_id string")
    kind = "domain string, valid_products long, required_coverage double, brand_coverage double, duplicate_ratio double, median_price double"
    metrics = spark.createDataFrame([(None, 1, 0.1, 0.1, 0.0, 1.0), ("a", 1, 0.9, 0.1, 0.0, 1.0), ("b", 1, 0.1, 0.1, 0.0, 1.0)], kind)
    off = spark.createDataFrame([("b", False), ("a", None)], "domain string, quality_gate_enabled boolean")
    written, held = quality.route_gate(products, metrics, metrics.limit(0), "domain", ["domain"], off)
    assert {r.product_id for r in written.collect()} == {"p2", "p3"} and {r.product_id for r in held.collect()} == {"p1"}


def test_rows_without_a_time_stay(spark):
    at = datetime(2024, 6, 1)
    pages = spark.createDataFrame([("1", "a", None), ("2", "a", at), ("3", "a", datetime(2020, 1, 1)), ("4", None, at)], "raw_page_id string, domain string, captured_at timestamp")
    assert {r.raw_page_id for r in lifecycle.retained_pages(pages, F.lit(at), per_domain=1).collect()} == {"1", "2", "4"}
    kind = "observation_id string, product_id string, observed_at timestamp, price_numeric double, domain string, source_id string, currency string"
    _, left = lifecycle.compact_observations(spark.createDataFrame([("o", "p", None, 1.0, "d", "s", None)], kind), F.lit(at))
    assert left.count() == 1


def test_a_row_matching_both_keys_comes_once(spark):
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("z", "x"), ("q", "r")], "a string, b string")
    wanted = spark.createDataFrame([("x",), ("x",), ("y",)], "job_id string")
    assert sorted(map(tuple, analytics.find_by_either_key(rows, wanted, "a", "b").collect())) == [("x", "x"), ("x", "y"), ("z", "x")]


def test_stray_elements_do_not_empty_items(spark):
    row = spark.createDataFrame([('{"items":[{"name":"a"},"oops",3,null,{"name":"b"}]}',), ('{"items":"no"}',)], "t string")
    got = [[i["name"] for i in r.v] for r in row.select(responses.response_items("t").alias("v")).collect()]
    assert got == [["a", "b"], []]


def test_upsert_takes_the_last_of_several_and_ids_are_repeatable(spark):
    stored = spark.createDataFrame([("k", 1, 0)], "id string, v int, t int")
    new = spark.createDataFrame([("k", 7, 2), ("k", 5, 3), ("n", 1, 1), ("n", 2, 1)], "id string, v int, t int")
    assert sorted((r.id, r.v) for r in upsert(stored, new, ["id"], order=["t"]).collect())[0] == ("k", 5)
    assert upsert(stored, new, ["id"], order=["t"]).count() == 2
    kind = "raw_page_id string, url string, domain string, content_type string, content string, status string, captured_at timestamp"
    pages = spark.createDataFrame([(None, "u", None, None, "c", None, None)], kind)
    ids = [prepared_pages(pages, F.lit(datetime(2024, 1, 1))).first().raw_page_id for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 40


def test_a_table_moved_aside_comes_back(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t__old"))
    recover_table(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_keyword_rules_equal_a_plain_search(spark):
    texts = [(1, "Bia lon 330"), (2, "vang ĐỎ"), (3, ""), (4, None), (None, "bia"), (5, "xyz")]
    rules = [("beer", "bia", 5), ("wine", "vang đỏ", 9), ("can", "lon", 5), ("x", "z", 1), ("none", None, 99)]
    found = keyword_category(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(rules, "category string, keyword string, priority int"))
    assert {r.k: r.category for r in found.collect()} == {1: "can", 2: "wine", 3: None, 4: None, None: None, 5: "x"}


def test_keyword_rules_in_long_texts_and_without_texts_sent_to_all_tasks(spark, monkeypatch):
    import time

    from marketloom.operators import pages

    long = "a b " * 100_000 + "𝄞Vang"
    texts = spark.createDataFrame([(1, long), (2, "xx Lon"), (2, "bia"), (3, "x"), (4, None)], "k long, t string")
    rules = spark.createDataFrame([("wine", "𝄞vang", 1), ("can", "lon", 5), ("beer", "bia", 5), ("any", "", 0), ("old", "bia", 1)], "category string, keyword string, priority int")
    for limit in (pages.DIRECT_KEYWORDS, 0):
        monkeypatch.setattr(pages, "DIRECT_KEYWORDS", limit)
        for ties, second in ((False, "can"), (True, "beer")):
            start = time.monotonic()
            found = keyword_category(texts, "k", "t", rules, first_of_ties=ties)
            got = sorted((r.k, r.category) for r in found.collect())
            assert got == [(1, "wine"), (2, second), (2, second), (3, "any"), (4, None)] and time.monotonic() - start < 40
            joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]
            assert not [line for line in joins if "_key" in line]


def test_previews_name_what_a_selector_lacks(spark):
    pages = spark.createDataFrame([("1", "www.a.vn", "<h1>Bia</h1><p class=x>9</p>"), ("2", "a.vn", None)], "raw_page_id string, domain string, html string")
    fields = [("listing", "name", "h1", None, True), ("listing", "price", ".x:first-child", None, False)]
    rules = spark.createDataFrame([("a.vn", fields)], "domain string, fields array<struct<target:string,name:string,selector:string,attr:string,required:boolean>>")
    got = {(r.raw_page_id, r.name): (r.matches, r.sample, r.gaps) for r in selector_previews(pages, rules).collect()}
    assert got[("1", "name")] == (1, "Bia", []) and got[("2", "name")] == (0, None, [])
    assert got[("1", "price")] == (0, None, [".x:first-child"])
    assert evidence_excerpt(pages.select("raw_page_id", "html")).count() == 2


def test_rule_sections_of_several_rows(spark):
    extraction.register_rule_function(spark)
    section = '{"fields":[{"name":"n","selector":"%s"}]}'
    spark.createDataFrame([("1", "<h1>a</h1><b>c</b>", section % "h1"), ("2", "<h1>a</h1><b>c</b>", section % "b"), ("3", "<h1>d</h1>", section % "h1"), ("4", "<h1>d</h1>", None)], "k string, html string, section string").coalesce(1).createOrReplaceTempView("sectioned")
    got = spark.sql("SELECT k, r.raw FROM sectioned, LATERAL rule_rows(html, '', section) AS r").collect()
    assert {r.k: r.raw for r in got} == {"1": "a", "2": "c", "3": "d"}
