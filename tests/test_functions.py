import hashlib
import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from marketloom.functions import classify as C
from marketloom.functions import ids as I
from marketloom.functions import responses as J
from marketloom.functions import text as X
from marketloom.functions import urls as U
from marketloom.functions import validity as V


def cells(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["v"] for r in rows.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]


def test_prices(spark):
    texts = ["29.000 đ", "Giá: 1,250,000 VND (cũ 2)", "12.50", "Liên hệ", "", None, "0"]
    assert cells(spark, texts, X.clean_price) == [29000.0, 1250000.0, 1250.0, None, None, None, 0.0]
    assert cells(spark, texts, X.positive_price)[-1] is None
    assert cells(spark, ["100000.00", "29.000"], X.plain_price) == [100000.0, 29000.0]


def test_clean_text_handles_all_spaces(spark):
    assert cells(spark, [" a  b\n\tc ", None, "　"], X.clean_text) == ["a b c", "", ""]


def test_measures(spark):
    assert cells(spark, ["Vang 0.75L", "Bia 330 ml", "1,5 lít", "x"], X.volume_ml) == [750, 330, 1500, None]
    assert cells(spark, ["14,5% vol", "no"], X.percentage) == ["14.5%", None]
    assert cells(spark, ["4.7 / 5"], X.rating_number) == [4.7]
    assert cells(spark, ["23 đánh giá"], X.review_count) == [23]
    assert cells(spark, ["Còn hàng", "TẠM HẾT", "?"], X.stock_status) == ["IN_STOCK", "OUT_OF_STOCK", None]
    assert cells(spark, ["thùng 24 lon", "6 lon", "x 900", "chai"], X.infer_package_count) == [24, 6, 500, 1]
    assert cells(spark, ["thung 24", "6 lon 330ml", "chai"], X.canonical_pack_size) == [24, 6, None]
    assert cells(spark, ["Gọi 0901 234 567 nhé"], X.phone) == ["0901 234 567"]


def test_fold_and_core(spark):
    assert cells(spark, ["Rượu Đỏ  Ngon, 14,5%"], X.fold_text) == ["ruou do ngon 14 5%"]
    assert cells(spark, ["14,5%"], lambda c: X.fold_text(c, decimal_comma=True)) == ["14.5%"]
    assert cells(spark, ["14,5%"], X.canonical_abv) == [5.0]
    assert cells(spark, ["14,5%"], lambda c: X.canonical_abv(c, decimal_comma=True)) == [14.5]
    assert cells(spark, ["Rượu Macallan 12 năm 700ml 40% hộp quà"], lambda c: X.name_core(c, F.lit("Macallan"))) == ["12 nam"]


def test_names_from_urls(spark):
    urls = ["https://a.vn/x/ruou-vodka-750ml-chai.html?p=1", "https://a.vn/o'neil_sku12/", "https://a.vn"]
    assert cells(spark, urls, U.name_from_url) == ["Ruou Vodka 750Ml Chai", "O'Neil", "A.Vn"]


@pytest.mark.parametrize("link", ["/a/b", "c.html?x=1#y", "../up", "./same", "../../..", "?q=1", "#f", "//cdn.vn/z", "https://o.vn/p", "mailto:a@b.vn", "a/../b", "/a/./b/../c/"])
def test_links_resolve_as_in_the_standard_library(one, link):
    base = "https://www.shop.vn/x/y/page.html?k=v"
    assert one(U.resolve_url(F.lit(link), F.lit(base))) == urljoin(base, link)


def test_domains(spark):
    assert cells(spark, ["https://WWW.Shop.vn/a", "www.shop.vn", "Shop.VN:80"], U.normalize_domain) == ["shop.vn", "shop.vn", "shop.vn:80"]
    assert cells(spark, ["shop.vn", "sh op", "a/b"], U.is_safe_domain) == [True, False, False]
    ok = lambda c: C.valid_product_url(c, F.lit("shop.vn"))
    assert cells(spark, ["https://www.shop.vn/p", "https://other.vn/p", "https://shop.vn/", "/p"], ok) == [True, False, False, False]


def test_categories(spark):
    words = ["vodka men", "lager lon", "cigar cuba", "sữa tươi", "bánh", "", "flash sale"]
    assert cells(spark, words, C.category) == ["Rượu", "Bia", "Thuốc lá", "Sữa", "Khác", "Khác", "Bia"]
    assert cells(spark, ["flash sale", "ale"], lambda c: C.category(c, whole_words=True)) == ["Khác", "Bia"]
    assert cells(spark, ["Rượu vang", "xì gà", "SỮA", None], C.source_group) == ["Rượu bia", "Thuốc lá", "Sữa", "Khác"]


def test_page_classes(spark):
    cases = {
        "https://a.vn/danh-muc/bia": "listing", "https://a.vn/products": "listing", "https://a.vn/store-locator": "store_listing",
        "https://a.vn/product/x": "product_detail", "https://a.vn/a/b/c.html": "listing", "https://a.vn/san-pham/a/c.html": "product_detail",
        "https://a.vn/listcategory/x": "unknown", "https://a.vn/tin": "unknown",
    }
    assert cells(spark, list(cases), lambda c: C.page_class(F.lit(None).cast("string"), c)) == list(cases.values())
    assert cells(spark, ["listing", "product_detail", "branch", ""], lambda c: C.extraction_target(c, F.lit("https://a.vn/"))) == ["listing", "product_detail", "stores", None]


def test_status_columns(spark):
    assert cells(spark, ["a", None], lambda c: C.address_status(c, F.lit("online"))) == ["FOUND", "NOT_APPLICABLE"]
    assert cells(spark, ["call us", "x"], lambda c: C.price_status(c, F.lit(None).cast("double"))) == ["CONTACT", "MISSING"]
    assert cells(spark, ["HTTP 429", "high demand", "x"], C.cooldown_seconds) == [1800, 600, 300]
    assert cells(spark, ["done", "running", "odd"], C.job_label) == ["Completed", "Processing", "Odd"]


def test_ids_match_their_definition(spark, one):
    sha = lambda s, n: hashlib.sha1(s.encode()).hexdigest()[:n]
    assert one(I.part_id(F.lit(" a  b "), F.lit(""), F.lit(None), F.lit("c"))) == sha("a b|c", 16)
    assert one(I.full_part_id(F.lit("a"), F.lit(None), F.lit("c"))) == sha("a||c", 20)
    assert one(I.pair_id(F.lit("s"), F.lit("b"), F.lit("s"), F.lit("a"))) == sha("s:a|s:b", 12)
    assert cells(spark, [29000.0, 12.5, 1e7], I.price_part, "double") == ["29000.0", "12.5", "10000000.0"]
    assert cells(spark, [40.0, 14.5, 100.0], X.general_number, "double") == ["40", "14.5", "100"]
    page = F.struct(F.lit("u").alias("url"), F.lit(None).cast("string").alias("page_type"), F.lit(" a \n b").alias("html"))
    want = hashlib.sha256(b"gemini-evidence-v2\0u\0\0a b\0").hexdigest()[:24]
    assert one(I.evidence_hash(F.array(page))) == want


def test_checks_join_their_texts_once(spark):
    """Inside a lambda Spark computes an expression again wherever it stands: one joined text for class, pack and volume each."""
    c = {n: F.col(n) for n in ("product_name", "category", "product_url", "volume_ml", "price", "old_price", "domain")}
    rows = spark.createDataFrame([("Vodka 750ml",) * 7], ", ".join(f"{n} string" for n in c))
    plan = rows.select(V.row_checks(c, c["domain"], "listing").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat_ws(") == 3


def test_price_bounds_scale_with_pack_and_volume(one):
    empty = F.lit(None).cast("string")
    bound = V.price_bounds(F.lit("Vodka thùng 6 1.5 lít"), empty, empty, F.lit("a.vn"))
    assert tuple(one(bound)) == (20000 * 6 * 2, 500_000_000 * 6 * 2)


def test_labels(spark):
    assert cells(spark, [1250000.0, 12.5, 0.0, None], X.price_label, "double") == ["1.250.000 VND", "12,5 VND", "N/A", "N/A"]
    assert cells(spark, ["a, b\na,, c "], X.clean_list) == [["a", "b", "c"]]


def test_model_responses(spark):
    body = '{"items": [{"name": "A", "confidence": 3, "entity_type": "STORE"}, {"name": "B"}]}'
    shapes = [body + "\nDone", body + body.replace("A", "Z"), f"```json\n{body}\n```\nnote", json.dumps(body), f"Here {body}"]
    got = cells(spark, shapes, lambda c: J.response_items(J.json_text(c)))
    for items in got:
        assert [(i["entity_type"], i["name"], i["confidence"], i["currency"]) for i in items] == [("store", "A", 1.0, "VND"), ("product", "B", 0.0, "VND")]
    assert cells(spark, ["no json at all"], J.json_text) == [None]
    rows = lambda c: J.synthetic_rows(J.json_text(c), F.array(F.lit("name"), F.lit("price")), F.lit(2))
    assert cells(spark, ['[{"name":"a"},{"name":"b","price":1},{"name":"c"}]', '{"rows":[{"name":"a"}]}'], rows) == [[{"name": "a", "price": ""}, {"name": "b", "price": "1"}], None]
