import json
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.operators import analytics as O
from marketloom.operators import common as M
from marketloom.operators import lifecycle as L
from marketloom.operators import pages as P
from marketloom.operators import quality as Q
from marketloom.sources import exports as X
from marketloom.sources import files as S
from marketloom.sources import upsert as U
from marketloom.sources.keyed import KeyedTable
from marketloom.streaming import jobs as T
from marketloom.streaming.run import drain, in_batches

NOW = "2024-06-01"


def when(text=NOW):
    return F.lit(text).cast("timestamp")


def test_upsert_rules(spark):
    old = spark.sql("SELECT * FROM VALUES ('a', 1, 'x', 'old'), ('b', 2, 'y', 'old') AS t(k, n, s, created_at)")
    new = spark.sql("SELECT * FROM VALUES ('b', CAST(NULL AS INT), 'new', 9), ('c', 3, 'new', 9) AS t(k, n, created_at, unknown)")
    rows = {r["k"]: tuple(r) for r in U.upsert(old, new, ["k"]).collect()}
    assert rows == {"a": ("a", 1, "x", "old"), "b": ("b", None, "y", "old"), "c": ("c", 3, None, "new")}


def test_replace_table_swaps_versions(spark, tmp_path):
    place = str(tmp_path / "table")
    for n in (3, 5):
        U.replace_table(spark.range(n), place)
        assert spark.read.parquet(place).count() == n
    U.replace_table(spark.read.parquet(place).filter("id > 1"), place)
    assert spark.read.parquet(place).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_source_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("﻿name,url,type,category,note\nA,https://a.vn,Web,Bia,n\n,,,,\nB,https://b.vn,,Bia,\n", encoding="utf-8")
    good, bad = S.read_source_csv(spark, str(path))
    assert [r["name"] for r in good.collect()] == ["A"] and [r["name"] for r in bad.collect()] == ["B"]
    assert tuple(S.import_counts(good, bad).first()) == (2, 1, 1)
    path.write_text("name,url\nA,b\n")
    with pytest.raises(ValueError, match="type, category"):
        S.read_source_csv(spark, str(path))


def test_csv_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, "Web")], "name string, note string, type string")
    X.write_csv(X.source_csv_rows(rows), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns[:3] == ["name", "url", "type"] and back.first()["name"] == "A"


def test_archives_and_page_payloads(spark, tmp_path):
    archive = "MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/css\r\n\r\na{}\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p class=3D\"x\">r=C6=B0=E1=BB=A3u</p>\r\n--B--\r\n"
    (tmp_path / "a.mhtml").write_bytes(archive.encode())
    (tmp_path / "b.html").write_bytes("<p>bia</p>".encode())
    scan = spark.read.format("binaryFile").load(str(tmp_path))
    html = {r["path"].rsplit("/", 1)[1]: r["html"].strip() for r in S.decode_archives(scan.filter("path LIKE '%mhtml'")).collect()}
    assert html == {"a.mhtml": '<p class="x">rượu</p>'}
    pages = spark.createDataFrame([("1", None, "b.html"), ("2", "inline", "b.html"), ("3", None, "zz")], "raw_page_id string, content string, filename string")
    got = {r["raw_page_id"]: r["html"] for r in S.resolve_payloads(pages, files=scan).collect()}
    assert got == {"1": "<p>bia</p>", "2": "inline", "3": None}


def test_decode_falls_back(one):
    assert one(S.decode_text(F.lit(bytearray("é".encode("latin-1"))))) == "é" and one(S.decode_text(F.lit(bytearray("ợ".encode())))) == "ợ"


def test_page_lake(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", None, "x"), ("7", "v", "a.vn", "yy")], "raw_page_id string, url string, domain string, content string").withColumns(
        {"content_type": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "captured_at": F.lit(None).cast("timestamp")})
    S.append_pages(S.prepared_pages(pages, when()), str(tmp_path / "lake"))
    got = S.read_pages(spark, str(tmp_path / "lake"))
    assert {(r["domain"], r["content_length"], r["status"]) for r in got.collect()} == {("unknown", 1, "pending"), ("a.vn", 2, "pending")}


def test_output_rule_and_job_files(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "shop_1.json").write_text(json.dumps({"products": [{"name": "A", "price": 5}, {"name": ""}]}))
    rows = S.read_output_files(spark, str(out)).collect()
    assert [(r["name"], r["source"], r["price"], r["category"]) for r in rows] == [("A", "shop", "5", "Khác")]
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "a.vn.json").write_text(json.dumps({"listing": {"fields": [{"name": "n", "selector": "s"}]}}))
    (rules / "bad.json").write_text("{")
    got = S.read_rule_files(spark, str(rules)).collect()
    assert [(r["domain"], r["structure"]["listing"]["fields"][0]["name"]) for r in got] == [("a.vn", "n")]
    jobs = tmp_path / "raw"
    (jobs / "a.vn").mkdir(parents=True)
    for name in ("j1.meta.json", "j2.meta.json", "j3.meta.json", "j2.error", "j1.json"):
        (jobs / "a.vn" / name).write_text("{}")
    got = {r["id"]: (r["status"], r["source"]) for r in S.scan_jobs(spark, str(jobs)).collect()}
    assert got == {"j1": ("Completed", "a.vn"), "j2": ("Failed", "a.vn"), "j3": ("Pending", "a.vn")}
    other = tmp_path / "raw2"
    S.write_named_files(spark.createDataFrame([("raw/b/k 1+.meta.json", '{"domain": "shop"}'), ("raw/c/k 1+.meta.json", "{}"), ("raw/c/k 1+.error", ""), ("raw/c/bad.meta.json", "{"),
                                               ("raw/c/list.meta.json", "[1]"), ("out/x_k 1+_2.json", "")], "path string, text string"), str(other))
    got = sorted((r["id"], r["status"], r["source"]) for r in S.scan_jobs(spark, f"{other}/raw", f"{other}/out").collect())
    assert got == [("k 1+", "Completed", "shop"), ("k 1+", "Failed", "c")]
    assert S.scan_jobs(spark, f"{other}/raw", f"{other}/out", limit=1).count() == 1


def test_sections_fall_back_to_unknown_pages(spark):
    pages = spark.createDataFrame([("a", "1", "listing"), ("a", "2", "unknown"), ("b", "3", "unknown"), ("c", "4", "product_detail"), ("d", "5", "unknown")], "domain string, raw_page_id string, class string")
    rules = spark.createDataFrame([("a", "listing"), ("a", "product_detail"), ("a", "stores"), ("b", "stores"), ("c", "listing"), ("e", "listing")], "domain string, target string")
    got = sorted((r["domain"], r["target"], r["raw_page_id"], r["class"]) for r in Q.sample_targets(pages, rules).collect())
    want = [("a", "listing", "1", "listing"), ("a", "product_detail", "2", "unknown"), ("a", "stores", None, None), ("b", "stores", "3", "unknown"), ("c", "listing", None, "unknown"), ("e", "listing", None, "unknown")]
    assert [g[:3] for g in got] == [w[:3] for w in want] and got[1][3] == got[3][3] == "unknown"
    none = spark.createDataFrame([], "domain string, raw_page_id string, target string, record map<string,string>")
    results = Q.target_results(none, Q.sample_targets(pages, rules))
    assert {(r["domain"], r["target"]): r["sample_count"] for r in results.collect()}[("c", "listing")] == 0
    assert not any(r["accepted"] for r in Q.rule_verdicts(results, Q.rule_metrics(none)).collect())


def test_median_of_even_and_odd_groups(spark):
    rng = random.Random(4)
    groups = {k: [rng.choice([rng.randrange(1, 9), round(rng.uniform(1000, 1001), 4), rng.randrange(1, 10 ** 7)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 500), (None, 4))}
    rows = [(k, float(v)) for k, values in groups.items() for v in [*values, 0, -5]] + [("e", None), ("f", 0.0)]
    got = {r["k"]: r["median_price"] for r in Q.grouped_median(spark.createDataFrame(rows, "k string, price_numeric double"), ["k"]).collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def test_drafts_need_a_product_target(spark):
    rows = [("1", "stores", True, ["brand"]), ("1", "listing", False, ["price", "url"]), ("2", "product_detail", True, []), ("3", "stores", True, [])]
    got = {r["raw_page_id"]: (r["accepted"], r["accepted_targets"], r["warnings"]) for r in Q.draft_verdicts(spark.createDataFrame(rows, "raw_page_id string, target string, required_pass boolean, missing_recommended array<string>")).collect()}
    assert got == {"1": (False, 1, ["listing: missing price, url", "stores: missing brand"]), "2": (True, 1, []), "3": (False, 1, [])}


def metrics(count, required, brand, duplicate, median):
    return dict(zip(Q.METRICS, (count, required, brand, duplicate, median)))


def judge(spark, build, now, before):
    names = "valid_products long, required_coverage double, brand_coverage double, duplicate_ratio double, median_price double"
    row = spark.createDataFrame([(now, before)], f"n struct<{names.replace(' long', ':long').replace(' double', ':double')}>, b struct<{names.replace(' long', ':long').replace(' double', ':double')}>")
    return row.select(build(F.col("n"), F.col("b")).alias("v")).first()["v"]


def test_gate_and_drift(spark):
    now, before = metrics(2, 0.7, 0.2, 0.6, 300000.0), metrics(20, 1.0, 0.8, 0.1, 100000.0)
    assert judge(spark, Q.drift_warnings, now, before) == ["product count dropped from 20 to 2", "brand_coverage dropped from 0.80 to 0.20", "median price changed by more than 60%", "duplicate ratio exceeded 50%"]
    assert judge(spark, Q.gate_reasons, now, before) == ["product count dropped more than 70% (20 -> 2)", "median price changed more than 80%"]
    assert judge(spark, Q.gate_reasons, metrics(9, 0.5, 0.0, 0.0, None), None) == ["required coverage below 65%"]
    assert judge(spark, Q.drift_warnings, now, None) == []


def test_writer_metrics_use_the_upper_median(spark):
    rows = spark.createDataFrame([("1", "A", "u", 100.0, "b"), ("2", "B", "u", 300.0, None), ("2", "", "u", None, "")], "product_id string, product_name string, product_url string, price_numeric double, brand string")
    assert tuple(rows.agg(*Q.metric_columns()).first()) == (3, 0.667, 0.333, 0.333, 300.0)


def test_grouped_median_equals_sorting(spark):
    import random
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, None, rng.randrange(1, 10**6) / 1.0, 5.0])) for _ in range(400)]
    got = {r["k"]: r["median_price"] for r in Q.grouped_upper_median(spark.createDataFrame(rows, "k string, price_numeric double"), ["k"]).collect()}
    for key in ("a", "b", None):
        prices = sorted(p for k, p in rows if k == key and p)
        assert got[key] == prices[len(prices) // 2]


def test_synthetic_rules(spark):
    rows = [("b", 1, "Bia A", "Bia", "10000", "4.5", "https://a.vn", "", "K"), ("b", 2, " bia a ", "bia", "10000", "", "", "", "k"), ("b", 3, "", "Kẹo", "0", "2.5", "nope", "", ""), ("c", 1, "Sữa B", "Sữa", "5", "", "", "", "")]
    checked = Q.check_synthetic(spark.createDataFrame(rows, "batch_id string, position int, name string, category string, price string, rating string, url string, source string, store_name string"), ["Bia", "Sữa"])
    got = {(r["batch_id"], r["position"]): r["reasons"] for r in checked.collect()}
    assert got[("b", 1)] == [] and got[("b", 2)] == ["duplicate product row"] and got[("c", 1)] == []
    assert got[("b", 3)] == ["product name is missing or too generic", "category is outside requested product types", "price must be a positive number", "rating must be between 4.0 and 5.0", "url must be an absolute HTTP URL"]
    good, bad = Q.route_synthetic(checked)
    assert {r["synthetic_id"] for r in good.collect()} == {"c-1"} and bad.count() == 3


def test_analytics_fixtures(spark):
    rows = spark.createDataFrame([("a", 100.0), ("a", 300.0), ("b", 500.0), ("b", 0.0)], "source string, price_numeric double")
    assert [tuple(r) for r in O.source_price_comparison(rows).collect()] == [("a", 200.0, 2), ("b", 500.0, 1)]
    results = [("f", "failed"), ("f", "failed"), ("b", "blocked"), ("m", "failed"), ("m", "completed"), ("c", "completed")]
    runs = spark.createDataFrame([(r, o, 1, 1) for r, o in results], "run_id string, outcome string, products long, offers long")
    assert {r["run_id"]: r["status"] for r in O.run_summary(runs).collect()} == {"f": "failed", "b": "blocked", "m": "partial", "c": "completed"}
    view = O.product_view(spark.createDataFrame([("1", "https://a.vn/x/vodka-men-750ml-chai.html", None, 0.0, "?", "a.vn", when is None)], "product_id string, product_name string, product_url string, price_numeric double, category string, domain string, updated_at boolean"))
    row = view.first()
    assert (row["name"], row["price"], row["price_status"], row["category"], row["address_status"]) == ("Vodka Men 750Ml Chai", None, "MISSING", "Rượu", "MISSING")


def test_previous_row_crosses_buckets(spark):
    rows = spark.createDataFrame([("a", i) for i in (1, 2, 15, 31, 32)] + [("b", 7)], "k string, n int")
    got = M.previous_row(rows, "k", "n", [], F.floor(F.col("n") / 10)).collect()
    assert {(r["k"], r["n"]): (r["previous"] or [None])[0] for r in got} == {("a", 1): None, ("a", 2): 1, ("a", 15): 2, ("a", 31): 15, ("a", 32): 31, ("b", 7): None}


def test_work_list_and_promotion(spark):
    work = spark.createDataFrame([("d", "h", m) for m in ("m1", "m2", "m3", "m4")], "domain string, content_hash string, model string")
    done = spark.sql("SELECT * FROM VALUES ('d', 'h', 'm1', 'rejected', TIMESTAMP '2024-05-31 23:00:00'), ('d', 'h', 'm2', 'rejected', TIMESTAMP '2024-05-01') AS t(domain, content_hash, model, status, updated_at)")
    cooling = spark.sql("SELECT 'd' AS domain, 'h' AS content_hash, 'm3' AS model, TIMESTAMP '2024-06-02' AS retry_after")
    assert sorted(r["model"] for r in L.needs_generation(work, done, cooling, when(), 7200).collect()) == ["m2", "m4"]
    active = spark.createDataFrame([("a", "s", "v1", 0.9, "c0"), ("b", "s", "v1", 0.5, "c0"), ("c", "s", "v1", 0.5, "c0")], "domain string, structure string, version string, score double, candidate_id string")
    cand = spark.createDataFrame([(d, f"{d}1", "new", "v2", 0.8, e, "validated") for d, e in (("a", None), ("b", "v1"), ("c", "v9"), ("e", None))], "domain string, candidate_id string, structure string, version string, score double, expected_version string, status string")
    now, retired, outcomes = L.promote(active, cand, when())
    assert {r["domain"]: r["outcome"] for r in outcomes.collect()} == {"a": "candidate_score_lower", "b": "promoted", "c": "conflict", "e": "promoted"}
    assert {r["domain"]: r["version"] for r in now.collect()} == {"a": "v1", "b": "v2", "c": "v1", "e": "v2"} and [r["domain"] for r in retired.collect()] == ["b"]


def test_links_sitemaps_and_budget(spark):
    html = "<!-- <a href='/c'> --><a href='/san-pham/x/'>1</a><a href=/tin>2</a><a href='https://o.vn/'>3</a><a href='/san-pham/x'>4</a><a href='f.pdf'>5</a><a href='mailto:a'>6</a>"
    page = spark.createDataFrame([("1", "https://a.vn/", html)], "raw_page_id string, url string, html string")
    got = P.same_site_links(page, 10).orderBy("position").collect()
    assert [(r["link"], r["score"]) for r in got] == [("https://a.vn/san-pham/x", 5), ("https://a.vn/tin", 0)]
    seeds = spark.createDataFrame([("r", "0")], "root string, url string")
    links = spark.createDataFrame([("0", "1", 1), ("0", "2", 9), ("1", "3", 0), ("3", "0", 0)], "url string, link string, score int")
    reach = lambda **o: sorted((r["url"], r["depth"]) for r in P.expand_frontier(seeds, links, 2, **o).collect())
    assert reach() == [("0", 0), ("1", 1), ("2", 1), ("3", 2)] and reach(page_budget=2) == [("0", 0), ("2", 1)]


def test_full_roots_are_followed_no_further(spark):
    rng = random.Random(9)
    edges = sorted({(str(rng.randrange(40)), str(rng.randrange(40)), rng.randrange(4)) for _ in range(140)})
    seeds = [("r", "0"), ("r", "1"), ("q", "2"), ("many", "3"), ("many", "4"), ("many", "5"), ("many", "6")]
    budget, want = 3, set()
    for root in {r for r, _ in seeds}:
        level, seen = {u: 0 for r, u in seeds if r == root}, {}
        for depth in range(4):
            order = sorted(level, key=lambda u: (-level[u], u))[: budget - len(seen)]
            seen |= {u: depth for u in order}
            level = {v: max(s for a, b, s in edges if b == v and a in order) for u in order for a, v, _ in edges if a == u and v not in seen}
        want |= {(root, u, d) for u, d in seen.items()}
    got = P.expand_frontier(spark.createDataFrame(seeds, "root string, url string"), spark.createDataFrame(edges, "url string, link string, score int"), 3, budget)
    assert {(r["root"], r["url"], r["depth"]) for r in got.collect()} == want


def test_compaction_again_adds_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "daily"), StructType.fromDDL(L.DAY_SUMMARY), ["product_id", "date"], 4)
    row = lambda n, day, price: (f"o{n}", "p", price, f"2024-01-{day:02} 0{n}:00:00", "d", "s", None)
    make = lambda rows: spark.createDataFrame(rows, "observation_id string, product_id string, price_numeric double, observed_at string, domain string, source_id string, currency string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    first, late = make([row(1, 1, 10.0), row(2, 1, 20.0), row(3, 2, 0.0), row(4, 30, 5.0), ("x", None, 1.0, "2024-01-01", "d", "s", None)]), make([row(5, 1, 30.0), row(6, 2, 7.0)])
    as_of = F.lit("2024-02-03").cast("timestamp")
    assert [r["observation_id"] for r in L.compact_into(table, first, as_of, 1, 20).collect()] == ["o4"]
    for _ in range(2):
        L.compact_into(table, late, as_of, 2, 20)
    got = {r["date"].day: (r["min_price"], r["max_price"], r["avg_price"], r["latest_price"], r["observation_count"], r["currency"]) for r in L.as_daily(table.read()).collect()}
    assert got == {1: (10.0, 30.0, 20.0, 30.0, 3, "VND"), 2: (7.0, 7.0, 7.0, 7.0, 1, "VND")}


def test_runs_are_paired_in_order_of_time(spark):
    rows = [(0, "s", "r2", 2, 20, False), (0, "s", "r4", 4, 40, False), (1, "s", "r3", 3, 9, True), (1, "s", "r1", 1, 30, False), (1, "t", "u1", 5, 7, False), (2, "s", "r9", 28, 1, False), (2, "t", None, None, 1, False)]
    frame = spark.createDataFrame(rows, "part int, source_id string, run_id string, day int, valid_products long, quarantined boolean").withColumn("run_at", F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(day)"))
    frame = frame.drop("day").withColumns({c: F.lit(1.0) for c in Q.METRICS[1:]})
    got = drain(T.drift_stream(in_batches(frame, "part", 3, "order"), "10 days"), "order").collect()
    assert {(r["run_id"], r["previous_run_id"]) for r in got} == {("r1", None), ("r2", "r1"), ("r3", "r2"), ("r4", "r2"), ("u1", None)}
    assert [r["warnings"][0] for r in got if r["run_id"] == "r3"] == ["product count dropped from 20 to 9"]


def test_a_source_has_one_timer_however_many_runs_wait():
    import pandas as pd

    class State:
        rows = ()
        exists = lambda self: False
        get = lambda self: iter(self.rows)
        put = update = lambda self, rows: setattr(self, "rows", tuple(rows))
        appendList = lambda self, rows: setattr(self, "rows", (*self.rows, *rows))
        clear = lambda self: setattr(self, "rows", ())

    class Handle:
        timers: set = set()
        getValueState = getListState = lambda self, *_: State()
        listTimers = lambda self: iter(self.timers)
        registerTimer = lambda self, time: self.timers.add(time)

    runs = pd.DataFrame([(pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), False, f"r{d:03}", d, 1.0, 1.0, 1.0, 1.0) for d in range(200)], columns=["run_at", "quarantined", "run_id", *Q.METRICS])
    machine, watermark = T.LastMetrics(), pd.Timestamp("2024-01-31").value // 1_000_000
    machine.init(Handle())
    list(machine.handleInputRows(("s",), iter([runs[100:], runs[:100]]), None))
    assert Handle.timers == {pd.Timestamp("2024-01-01").value // 1_000_000}
    passed = type("Times", (), {"getCurrentWatermarkInMs": lambda self: watermark})()
    out = pd.concat(machine.handleExpiredTimer(("s",), passed, None))
    assert list(out["run_id"]) == [f"r{d:03}" for d in range(31)] and list(out["previous_run_id"])[1:] == [f"r{d:03}" for d in range(30)]
    assert min(t for t in Handle.timers if t > watermark) == watermark + 86_400_000 and not list(machine.handleExpiredTimer(("s",), passed, None))


def test_newest_offers_ignore_late_rows(spark):
    current = spark.sql("SELECT 'a' AS offer_id, 5.0D AS price_numeric, TIMESTAMP '2024-01-05' AS updated_at")
    arrived = spark.sql("SELECT * FROM VALUES ('a', 1.0D, TIMESTAMP '2024-01-01'), ('b', 2.0D, TIMESTAMP '2024-01-01'), ('b', 3.0D, TIMESTAMP '2024-01-02') AS t(offer_id, price_numeric, updated_at)")
    assert {r["offer_id"]: r["price_numeric"] for r in T.newest_offers(current, arrived).collect()} == {"a": 5.0, "b": 3.0}


def test_session_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT 's' AS source, TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, m) AS ts FROM VALUES (0), (5), (40), (41), (300), (900) AS t(m)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    closed = {(r["session_start"], r["events"]) for r in T.capture_sessions(rows).filter("session_end < TIMESTAMP '2024-01-01 14:00:00'").collect()}
    assert {(r["session_start"], r["events"]) for r in drain(T.capture_sessions(stream), "t").collect()} == closed and len(closed) == 3
