import pytest
from pyspark.sql import functions as F

from marketloom.operators import extraction as E
from marketloom.operators import pages as P
from marketloom.operators import payloads as D
from marketloom.operators import quality as Q
from marketloom.operators.dom import Page

PAGES = "raw_page_id string, domain string, url string, page_type string, html string"
RULES = f"domain string, version string, structure {E.STRUCTURE}"


def section(item, **fields):
    return {"item_selector": item, "fields": [{"name": n, "selector": s[0], "attr": s[1], "required": True, "transform": s[2]} for n, s in fields.items()]}


LISTING = section(".card", product_name=("h3 a", None, None), product_url=("h3 a", "href", None), price=(".p", None, "clean_price"))
DETAIL = section(None, product_name=("h1", None, None), price=(".price", None, None), abv=(".abv", None, "extract_percentage"), stock=(".stock", None, "check_for_sold_out_indicator"))
STORES = section(".store", store_name=("b", None, None), store_address=("i", None, None), store_phone=("u", None, None))


def test_selectors():
    page = Page("<div id=a class='x y'><ul><li>1<li class=on>2</ul><p>t<b>u<p>v</div><img data-src=i><!-- <p>no --><script>'<p>'</script>")
    texts = lambda s: [page.text(n) for n in page.select(s)]
    assert texts("li") == ["1", "2"] and texts("#a > ul > li.on") == ["2"] and texts("div.x.y p") == ["t u", "v"]
    assert texts("li.on, b") == ["2", "u"] and texts("[class*='o']") == ["2"] and texts("[class^='x'] li:hover") == []
    assert page.attrs[page.first("img[data-src]")]["data-src"] == "i"


def test_a_selector_tries_only_nodes_of_its_tag_or_attribute(monkeypatch):
    page, tried, fits = Page("<div class=x><p>t</p></div>" * 300 + "<h1 id=q>u</h1><i class='x on'>v</i>"), [], Page._fits
    monkeypatch.setattr(Page, "_fits", lambda self, node, chain: tried.append(node) or fits(self, node, chain))
    assert [page.text(n) for n in page.select("h1, #q, .on, nope")] == ["u", "v"]
    assert page.first("h1") == page.first("[id]") and list(page.select("*", page.first("div"))) == [2]
    assert len(set(tried)) < 310


def test_a_rule_is_read_once_and_its_gaps_named():
    rule = '{"listing":{"item_selector":".a:hover","fields":[{"name":"n","selector":"b"}]}}'
    assert E._parsed_rule(rule) is E._parsed_rule(str(rule)) and E._parsed_rule(rule)[1] == [".a:hover"]
    assert E._parsed_rule(None) == ({}, [])


def test_rules_are_tried_without_facts_of_the_page(spark):
    pages = spark.createDataFrame([("1", "a.vn", "https://a.vn/p", "unknown", "<title>S</title><h1>Vang</h1><b class=price>9</b>")], PAGES)
    rules = spark.createDataFrame([("a.vn", "v1", {"listing": None, "product_detail": DETAIL, "stores": None})], RULES)
    whole, bare = (E.read_pages(pages, rules, generic=False, facts=f).first() for f in (True, False))
    assert whole["context"]["title"] == "S" and bare["context"] is None and bare["jsonld_products"] == []
    assert bare["product_detail"] == whole["product_detail"] and len(bare["product_detail"][0]["fields"]) == 4
    both = E.read_pages(pages, rules, generic=False, facts=False).select(E.finished_rows(F.col("product_detail")).alias("r"), E.finished_records(F.col("product_detail")).alias("m")).first()
    assert both["m"] == [r["record"] for r in both["r"]] == [{"product_name": "Vang", "price": "9"}]
    assert bare["configured_targets"] == whole["configured_targets"] == ["product_detail"] and bare["read_error"] is None


@pytest.fixture(scope="module")
def products(spark):
    jsonld = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"J","url":"/j","brand":{"name":"BB"},"offers":{"price":"100.000"}},{"@type":"Store","name":"Kho","address":{"streetAddress":"1 A","addressLocality":"HN"},"telephone":"0901234567"}]}</script>'
    cards = "<div class=card><h3><a href='/a'>Rượu A</a></h3><i class=p>100.000 đ</i></div><div class=card><h3><a href='b?x=1'>Bia B</a></h3></div><div class=card></div>"
    rows = [
        ("1", "www.a.vn", "https://www.a.vn/danh-muc/x", "listing", jsonld + cards),
        ("2", "a.vn", "https://a.vn/product/y", "unknown", "<h1>Vang đỏ</h1><b class=price>Liên hệ</b><i class=abv>14,5%</i><i class=stock>Còn hàng</i><footer>0987 654 321</footer>"),
        ("3", "b.vn", "https://b.vn/zz", "unknown", "<title>Shop B | Trang chủ</title><h1>Sữa T</h1><span class=price>5.000</span>"),
        ("4", "a.vn", "https://a.vn/stores", "store_listing", "<div class=store><b>S1</b><i>2 B</i><u>0911 222 333</u></div><div class=store><b>S2</b></div>"),
    ]
    rules = spark.createDataFrame([("a.vn", "v1", {"listing": LISTING, "product_detail": DETAIL, "stores": STORES})], RULES)
    chosen = D.attach_store_config(E.choose_rows(E.read_pages(spark.createDataFrame(rows, PAGES), rules)), None).cache()
    return chosen, D.products_of_pages(chosen, F.lit("2024-01-01").cast("timestamp")).cache()


def test_listing_rows_and_jsonld(products):
    got = {r["product_name"]: r for r in products[1].filter("raw_page_id = '1'").collect()}
    assert set(got) == {"Rượu A", "Bia B", "J"}
    a = got["Rượu A"]
    assert (a["product_url"], a["price_numeric"], a["price_status"], a["category"], a["brand"]) == ("https://www.a.vn/a", 100000.0, "FOUND", "Rượu", "BB")
    assert a["field_sources"]["product_name"] == "selector" and a["field_sources"]["brand"] == "page_metadata"
    assert a["field_details"]["price"]["raw_value"] == "100.000 đ"
    assert (a["store_name"], a["store_address"], a["store_phone"], a["address_status"]) == ("Kho", "1 A, HN", "0901234567", "FOUND")
    assert got["Bia B"]["product_url"] == "https://www.a.vn/danh-muc/b?x=1" and got["Bia B"]["price_status"] == "MISSING"
    assert got["J"]["price_numeric"] == 100000.0


def test_detail_transforms(products):
    row = products[1].filter("raw_page_id = '2'").first()
    assert row["price_status"] == "MISSING" or row["price_status"] == "CONTACT"
    assert row["raw_data"]["abv"] == "14.5%" and row["raw_data"]["stock"] == "IN_STOCK" and row["rule_version"] == "v1"


def test_generic_rule_when_none_is_set(products):
    row = products[1].filter("raw_page_id = '3'").first()
    assert (row["product_name"], row["price_numeric"], row["category"], row["rule_version"]) == ("Sữa T", 5000.0, "Sữa", None)


def test_stores_need_an_address(products):
    rows = D.stores_of_pages(products[0]).filter("raw_page_id = '4'").collect()
    assert [(r["store_name"], r["store_address"], r["store_phone"]) for r in rows] == [("S1", "2 B", "0911 222 333")]


def test_store_settings_outrank_page_stores(spark):
    source = spark.createDataFrame([("s1", "a.vn", "site", "Cấu hình", None, None, None, "online")], "source_id string, domain string, store_scope string, store_name string, store_url string, store_address string, store_phone string, store_channel string")
    page = spark.createDataFrame([("1", "www.a.vn", "https://www.a.vn/product/x", "", "<h1>Bia</h1><div class=store><b>S</b><i>1 A</i></div>")], PAGES)
    rules = spark.createDataFrame([("a.vn", "v1", {"product_detail": DETAIL, "stores": STORES})], RULES)
    chosen = D.attach_store_config(E.choose_rows(E.read_pages(page, rules)), source)
    row = D.products_of_pages(chosen, F.lit("2024-01-01").cast("timestamp")).first()
    assert (row["source_id"], row["store_name"], row["store_address"], row["address_status"]) == ("s1", "Cấu hình", None, "NOT_APPLICABLE")
    assert row["field_sources"]["store_name"] == "source_config"


def test_offers_and_observations_need_a_price(products):
    assert D.offers(products[1]).count() == 3 and D.price_observations(products[1]).count() == 3


def test_known_locators(spark):
    html = "x.setMarkers(map,'12 L&ecirc; Lợi','<div class=a>');setMarkers(map,'3 B','<div')"
    page = spark.createDataFrame([("1", "www.circlek.com.vn", "https://www.circlek.com.vn/stores", "", html)], PAGES)
    none = spark.createDataFrame([], RULES)
    rows = D.stores_of_pages(D.attach_store_config(E.choose_rows(E.read_pages(page, none)), None)).collect()
    assert sorted(r["store_address"] for r in rows) == ["12 Lê Lợi", "3 B"]


def test_capture_classes(spark):
    rows = [("1", "https://a.vn/x", 1, "<div class=product-card></div><div data-product></div>"), ("2", "https://a.vn/y", 1, '<script type="application/ld+json">{"@type" : "Product"}</script>'),
            ("3", "https://a.vn/", 0, ""), ("4", "https://a.vn/z", 2, ""), ("5", "https://a.vn/listcategory", 1, "<i data-product></i><i data-product></i>")]
    got = P.classify_captures(spark.createDataFrame(rows, "raw_page_id string, url string, depth int, html string")).collect()
    assert [r["page_type"] for r in sorted(got, key=lambda r: r["raw_page_id"])] == ["listing", "product_detail", "entry", "discovered", "discovered"]


def test_evidence_is_bounded_and_keeps_products(spark):
    block = "<div class='item'><a href='/p'><h3>Tên</h3></a><b>10.000 đ</b></div>"
    page = "<meta name='a' content='b'>" + "<p>x</p>" * 5000 + block
    row = P.evidence_excerpt(spark.createDataFrame([("1", page)], "raw_page_id string, html string"), 5000).first()
    assert len(row["excerpt"]) <= 5000 and "Tên" in row["products"] and row["excerpt"].startswith("[STRUCTURED_EVIDENCE]\n<meta name='a'")


def test_contract_and_rule_check(spark):
    rules = spark.createDataFrame([("a.vn", {"listing": section(None, product_name=("a", None, None), brand=("b", None, None)), "stores": STORES})], f"domain string, structure {E.STRUCTURE}")
    fixed = rules.select(Q.enforce_contract(F.col("structure")).alias("s")).first()["s"]
    assert [f["required"] for f in fixed["listing"]["fields"]] == [True, False] and not any(f["required"] for f in fixed["stores"]["fields"]) and fixed["product_detail"] is None
    good = {"product_name": "Vang A", "price": "250000", "product_url": "https://a.vn/p/1"}
    rows = [("a.vn", "1", "listing", good), ("a.vn", "1", "listing", {**good, "product_url": "https://a.vn/p/2"}), ("a.vn", "2", "listing", {**good, "product_name": "Menu", "product_url": "https://x.vn/p"})]
    samples = [("a.vn", p, "listing", "listing") for p in ("1", "2")]
    target = Q.target_results(spark.createDataFrame(rows, "domain string, raw_page_id string, target string, record map<string,string>"), spark.createDataFrame(samples, "domain string, raw_page_id string, target string, class string"))
    row = target.first()
    assert (row["valid_rows"], row["sample_count"], row["unique_items"], row["sample_success"], row["passed"]) == (2, 2, 2, 0.5, False)
    verdict = Q.rule_verdicts(target).first()
    assert verdict["score"] == pytest.approx(round(7 / 9 * 0.65 + 0.4 * 0.25 + 0.1, 3)) and not verdict["accepted"]


def test_a_worker_holds_few_pages_of_a_large_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"html": ["<p>x</p>", None] * 5000, "n": list(range(10000))})
    parts = list(E._by_bytes(batch))
    assert max(p.num_rows for p in parts) <= 256 and [n for p in parts for n in p.column(1).to_pylist()] == list(range(10000))
    large = pa.RecordBatch.from_pydict({"html": ["x" * (5 << 20)] * 4})
    assert [p.num_rows for p in E._by_bytes(large)] == [1, 1, 1, 1]
