"""Keyed tables and the writer job: replays, crashes and late rows."""

import pytest
from marketloom.sources.keyed import KeyedTable
from marketloom.sources.upsert import upsert
from marketloom.streaming import jobs as S
from marketloom.streaming.writer import WriterJob
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def lay(now, new):
    return upsert(now, new, ["id"], order=["v"])


def rows_of(table):
    return {r.id: r.v for r in table.read().collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_batches_apply_once_and_touch_their_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], 8)
    assert rows_of(table) == {} and table.applied("j") == -1
    assert table.merge(frame(spark, [(i, "a") for i in range(50)]), "j", 0, lay)
    assert not table.merge(frame(spark, [(1, "replayed")]), "j", 0, lay)
    assert table.merge(frame(spark, [(1, "b"), (1, "c"), (100, "n")]), "j", 1, lay)
    assert rows_of(table) == {i: "a" for i in range(50)} | {1: "c", 100: "n"} and table.applied("j") == 1
    versions = list(table.manifest()["buckets"].values())
    assert len(versions) == 8 and 1 <= versions.count(2) <= 2
    # Other jobs have batches of their own; an empty batch and one that removes all rows are batches too.
    assert table.merge(frame(spark, [(200, "x")]), "other", 0, lay) and table.merge(frame(spark, []), "j", 2, lay)
    assert table.merge(frame(spark, [(i, "") for i in range(50)]), "j", 3, lambda now, new: now.join(new.select("id"), "id", "left_anti"))
    assert rows_of(table) == {100: "n", 200: "x"}
    assert table.read(1).count() == 50
    assert table.expire(keep=1) >= 1 and rows_of(table) == {100: "n", 200: "x"} and table.expire(keep=1) == 0


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], 4)
    table.merge(frame(spark, [(1, "a"), (2, "a")]), "j", 0, lay)

    def crash(manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(table, "_publish", crash)
        with pytest.raises(RuntimeError):
            table.merge(frame(spark, [(1, "half"), (3, "half")]), "j", 1, lay)
    assert rows_of(table) == {1: "a", 2: "a"} and table.applied("j") == 0
    again = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], 4)
    assert again.merge(frame(spark, [(1, "b"), (3, "b")]), "j", 1, lay) and rows_of(again) == {1: "b", 2: "a", 3: "b"}


def test_null_keys_have_a_bucket(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], 4)
    table.merge(frame(spark, [(None, "a"), (1, "a")]), "j", 0, lambda now, new: now.unionByName(new))
    assert rows_of(table) == {None: "a", 1: "a"}


def test_offers_keep_the_latest_time_in_any_order(spark, tmp_path):
    schema = "offer_id string, updated_at timestamp, price_numeric double"
    at = lambda n: __import__("datetime").datetime(2024, 1, n)
    batches = [[("a", at(2), 5.0), ("b", at(1), 1.0)], [("a", at(1), 9.0), ("b", at(3), 2.0), ("b", at(2), 8.0)], [("a", at(2), 4.0), ("c", at(1), None)], [("a", at(2), 6.0)]]
    table = KeyedTable(spark, f"{tmp_path}/o", spark.createDataFrame([], schema).schema, ["offer_id"], 4)
    for n, rows in enumerate(batches):
        table.merge(spark.createDataFrame(rows, schema), "offers", n, S.newest_offers)
    assert {r.offer_id: r.price_numeric for r in table.read().collect()} == {"a": 6.0, "b": 2.0, "c": None}


def products(spark, rows, hour):
    names = ["product_id", "source_id", "price_numeric", "raw_page_id"]
    df = spark.createDataFrame(rows, "product_id string, source_id string, price_numeric double, raw_page_id string")
    assert df.columns == names
    text = {c: F.lit("x") for c in ("product_name", "brand", "product_url", "currency", "store_name", "store_url", "store_phone", "domain", "rule_version", "data_origin")}
    return df.withColumns(text | {"store_address": F.lit(None).cast("string"), "updated_at": F.timestamp_seconds(F.lit(hour * 3600))})


def tables_of(job):
    pick = lambda table, *c: sorted((tuple(r) for r in table.read().select(*c).collect()), key=str)
    return {"products": pick(job.products, "product_id", "price_numeric", "raw_page_id", "created_at"), "offers": pick(job.offers, "product_id", "price_numeric"), "observations": pick(job.observations, "product_id", "raw_page_id", "price_numeric"),
            "quarantine": pick(job.quarantine, "batch", "source_id", "reason", "payload.product_id"), "metrics": pick(job.metrics, "source_id", "batch", "valid_products", "quarantined")}


def test_a_replay_after_a_crash_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    full = [(f"p{i}", "s", 100.0 + i, f"r0-{i}") for i in range(10)] + [("q1", "t", 5.0, "r0"), (None, None, 5.0, "r0")]
    few = [("p1", "s", 300.0, "r1"), ("q1", "t", 6.0, "r1"), ("q1", "t", 6.0, "r2")]
    batches = [full, few, [(p, s, v + 1, r.replace("r0", "r2")) for p, s, v, r in full[:10]]]
    runs = {}
    for name in ("whole", "broken"):
        job = WriterJob(spark, f"{tmp_path}/{name}", products(spark, [], 0), buckets=2)
        for n, rows in enumerate(batches):
            batch = products(spark, rows, n)
            if name == "broken" and n:
                with monkeypatch.context() as patch:
                    patch.setattr(job.observations if n == 1 else job.metrics, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
                    with pytest.raises(RuntimeError):
                        job.sink(batch, n)
            job.sink(batch, n)
        job.sink(products(spark, few, 1), 1)  # a batch that was done long ago
        runs[name] = tables_of(job)
    assert runs["whole"] == runs["broken"]
    assert [(r[0], r[1], r[3]) for r in runs["whole"]["quarantine"]] == [(1, "s", "p1")] and "dropped more than 70%" in runs["whole"]["quarantine"][0][2]
    assert ("p1", 102.0, "r2-1") in [r[:3] for r in runs["whole"]["products"]] and ("q1", 6.0) in runs["whole"]["offers"]
    assert ("s", 1, 1, True) in runs["whole"]["metrics"] and ("s", 2, 10, False) in runs["whole"]["metrics"]
