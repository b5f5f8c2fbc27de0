import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marketloom.operators import resolution as R
from marketloom.operators.components import connected_components
from marketloom.operators.similarity import similar_pairs


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold", [0.55, 0.62, 0.75, 0.78, 0.88])
def test_similarity_join_equals_brute_force(spark, threshold):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd ") for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 15]))).strip() for _ in range(150)}
    words |= {w[: len(w) // 2] + rng.choice("xyz") + w[len(w) // 2:] for w in rng.sample(sorted(words), 60)}
    words = sorted({w for w in words if w} | {"axbc", "abyc"})
    want = {(a, b) for a, b in itertools.combinations(words, 2) if ratio(a, b) >= threshold}
    got = similar_pairs(spark.createDataFrame([(w, w) for w in words], "item string, label string"), "item", "label", threshold, [])
    assert {(r["left_item"], r["right_item"]) for r in got.collect()} == want and want


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent}


PRODUCT = "product_id string, product_name string, brand string, category string"


def canonical(spark, rows, **options):
    return {r["product_id"]: r for r in R.canonicalize(spark.createDataFrame(rows, PRODUCT), **options).collect()}


def test_same_product_over_two_sites(spark):
    got = canonical(spark, [("1", "Rượu Chivas 12 năm 700ml 40% hộp quà", "Chivas", "Rượu"), ("2", "Chivas 12 năm 700 ml 40 độ", "Chivas", "Rượu"), ("3", "Macallan 10 năm", None, "Rượu"), ("4", "Macallan 18 năm", None, "Rượu")])
    assert got["1"]["canonical_product_id"] == got["2"]["canonical_product_id"] and got["1"]["canonical_key"]
    assert got["3"]["canonical_product_id"] != got["4"]["canonical_product_id"]


@pytest.mark.parametrize("least", [0.58, 0.70, 0.80, 0.88])
def test_groups_equal_all_pairs_scoring(spark, least):
    rng = random.Random(8)
    stems = ["grand reserve cabernet", "grand reserva cabernet", "golden lager", "golden lagers", "black label", "black labels x"]
    rows = [(f"p{i:03}", f"{rng.choice(stems)} {rng.choice(['750ml', '330ml', ''])} {rng.choice(['14%', '40%', ''])} {rng.choice(['6 lon', ''])}", rng.choice(["Aa", "Bb", None]), rng.choice(["Rượu", "Bia", ""])) for i in range(120)]
    df = spark.createDataFrame(rows, PRODUCT)
    items = [r.asDict() for r in R.canonical_features(df).collect()]

    def score(a, b):
        both = lambda k: a[k] and b[k]
        if any(both(k) and a[k] != b[k] for k in ("category", "volume_ml", "pack_size")) or (both("abv_percent") and abs(a["abv_percent"] - b["abv_percent"]) > 0.25):
            return 0.0
        s = 0.6 * ratio(a["name_core"] or a["normalized_name"], b["name_core"] or b["normalized_name"])
        weights = {"brand": 0.15, "volume_ml": 0.1, "abv_percent": 0.05, "pack_size": 0.05, "category": 0.05}
        s += sum(w for k, w in weights.items() if both(k) and (k == "abv_percent" or a[k] == b[k]))
        return round(min(s, 1.0), 3)

    parent = {i["product_id"]: i["product_id"] for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    matches = 0
    for a, b in itertools.combinations(items, 2):
        if a["canonical_key"] == b["canonical_key"] or score(a, b) >= least:
            matches += 1
            x, y = find(a["product_id"]), find(b["product_id"])
            parent[max(x, y)] = min(x, y)
    got = {r["product_id"]: r["canonical_product_id"] for r in R.canonicalize(df, min_score=least).collect()}
    for a, b in itertools.combinations(sorted(parent), 2):
        assert (find(a) == find(b)) == (got[a] == got[b]), (a, b)
    counts = R.match_counts(df, least).first()
    assert (counts["products_scanned"], counts["candidate_matches"]) == (120, matches)


def test_scores_that_names_cannot_decide_are_refused(spark):
    table = R.profiles(R.canonical_features(spark.createDataFrame([("1", "Bia", None, None)], PRODUCT)))
    assert R.lossless_blocks(1.1) == [] and R.fuzzy_edges(table, 1.1).count() == 0
    with pytest.raises(ValueError):
        R.fuzzy_edges(table, 0.4)


def test_duplicate_queue(spark):
    rows = [("a.vn", "https://a.vn/1", "Bia Sài Gòn"), ("b.vn", "https://b.vn/1", "bia  sài gòn!"), ("c.vn", "https://a.vn/1", "Khác hẳn"), ("d.vn", "https://d.vn/9", "Bia Sài Gòn 2"), ("e.vn", None, "Sữa")]
    got = {(r["left_product"]["source"], r["right_product"]["source"]): (r["confidence"], r["reasons"]) for r in R.duplicate_pairs(spark.createDataFrame(rows, "source string, url string, name string")).collect()}
    assert got[("a.vn", "b.vn")] == (0.96, ["normalized_name"]) and got[("a.vn", "c.vn")] == (0.99, ["product_url"])
    assert got[("a.vn", "d.vn")] == (0.92, ["name_similarity"]) and len(got) == 3


def test_queue_keeps_decisions(spark):
    empty = "struct<name:string>"
    queue = spark.createDataFrame([("x", 0.5, ["r"], ("a",), ("b",), "merged", "n", None, None)], f"candidate_id string, confidence double, reasons array<string>, left_product {empty}, right_product {empty}, status string, note string, created_at timestamp, updated_at timestamp")
    found = spark.createDataFrame([("x", 0.9, ["s"], ("a",), ("b",)), ("y", 0.8, ["s"], ("a",), ("c",))], f"candidate_id string, confidence double, reasons array<string>, left_product {empty}, right_product {empty}")
    got = {r["candidate_id"]: r for r in R.refresh_queue(queue, found, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert (got["x"]["status"], got["x"]["note"], got["x"]["confidence"]) == ("merged", "n", 0.9) and got["y"]["status"] == "pending"


def test_pairs_on_one_url_also_name_their_likeness(spark):
    rows = [("a", "https://x/1", "Bia Hanoi lon 330"), ("b", "https://x/1", "Bia Hanoi lon 33"), ("c", "https://x/1", "Sua tuoi")]
    found = R.duplicate_pairs(spark.createDataFrame(rows, "source string, url string, name string")).collect()
    assert sorted(tuple(r["reasons"]) for r in found) == [("product_url",), ("product_url", "name_similarity")]


def _written(spark):
    """Bytes of all shuffles of the session so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_similarity_join_moves_texts_and_not_pairs(spark):
    rng = random.Random(8)
    syllables = ["the", "an", "on", "er", "in", "ed", "th", " "]
    words = sorted({"".join(rng.choice(syllables) for _ in range(24))[:45] for _ in range(700)})
    rows = spark.createDataFrame([(w, w) for w in words], "item string, label string")
    before = _written(spark)
    got = similar_pairs(rows, "item", "label", 0.78, []).collect()
    assert _written(spark) - before < 4 * sum(map(len, words))
    assert {(r["left_item"], r["right_item"]) for r in got} == {(a, b) for a, b in itertools.combinations(words, 2) if ratio(a, b) >= 0.78}


def test_similarity_of_long_texts_over_strips_and_blocks(spark, monkeypatch):
    from marketloom.operators import similarity as S

    monkeypatch.setattr(S, "STRIP_ROWS", 16)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdé漢 ") for _ in range(n)) for n in [0, 1, 40, 63, 64, 65, 66, 90, 128, 129, 180, 300] for _ in range(5)]
    texts += [t[:k] + "x" + t[k + 3:] for t in texts for k in (len(t) // 2,)]
    rows = sorted({(b, t) for t in texts for b in "pq" if t and (b == "p" or len(t) % 2)})
    got = similar_pairs(spark.createDataFrame(rows, "block string, item string").withColumn("label", F.col("item")), "item", "label", 0.7, ["block"])
    want = {(b, x, y) for b in "pq" for x, y in itertools.combinations([t for k, t in rows if k == b], 2) if ratio(x, y) >= 0.7}
    assert {(r["block"], r["left_text"], r["right_text"]) for r in got.collect()} == want and len(want) > 40
