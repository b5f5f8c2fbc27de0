"""URL lists against a plain replay, leaks against plain alignment, the pipeline against its stages in plain form."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import odd
from marketloom.llm import decontaminate as D
from marketloom.llm import url_lists as U
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "list string, kind string, key string, action string, at timestamp"


def test_captures_equal_a_replay_of_the_log(spark):
    draw = random.Random(8)
    hosts = ["a.example.com", "b.a.example.com", "other.org", "x.other.org"]
    names = [("host", h) for h in hosts] + [("domain", "example.com"), ("domain", "other.org"), ("prefix", "other.org/p/"), ("url", "a.example.com/p/q?x=1")]
    log = [(draw.choice("LMN"), *draw.choice(names), draw.choice(["add", "remove", "ADD", "noise"]), START + timedelta(days=draw.randint(0, 90))) for _ in range(400)]
    log += [(None, "host", "other.org", "add", START), ("L", "host", "other.org", "add", None)]
    shots = [(i, draw.choice(["http://", "https://u@"]) + draw.choice(hosts).replace("o", "O") + draw.choice(["", "/", "/p/q?x=1#f", "/p/q"]), START + timedelta(days=draw.randint(0, 100))) for i in range(300)]
    shots += [(300, None, START), (301, "http://other.org/", None), (302, "no address", START), (None, "http://other.org/p/q", START), (7, shots[7][1], shots[7][2])]
    found = U.lists_at_fetch(spark.createDataFrame(shots, "active long, url string, fetched_at timestamp"), spark.createDataFrame(log, LOG)).collect()
    assert len(found) == len(shots)

    def state(one, key, when):
        events = [(at, action.lower()) for lst, kind, name, action, at in log if lst == one and (kind, name) == key and at and action.lower() != "noise" and at <= when]
        last = max((at for at, _ in events), default=None)
        return last is not None and "remove" not in {a for at, a in events if at == last}

    def keys(url):
        if "://" not in (url or ""):
            return []
        rest = url.split("#")[0].split("://")[1].split("@")[-1]
        host, _, path = rest.partition("/")
        host = host.lower()
        address, labels = host + rest[len(host):], host.split(".")
        segments = address.split("?")[0].split("/")
        return [("url", address), ("host", host), *(("domain", ".".join(labels[i:])) for i in range(len(labels))), *(("prefix", "/".join(segments[:i]) + "/") for i in range(1, len(segments)))]

    want = defaultdict(list)
    for number, url, when in shots:
        on = sorted({one for one in "LMN" for key in keys(url) if when and state(one, key, when)})
        want[(number, url)].append(on)
    for r in found:
        assert (list(r._active.lists) if r._active else []) in want[(r.active, r.url)]
    assert any(r._active for r in found)


def test_empty_log_and_captures(spark):
    none = spark.createDataFrame([], LOG)
    shots = spark.createDataFrame([(1, "http://a.b/", START)], "id long, url string, fetched_at timestamp")
    assert U.lists_at_fetch(shots, none).filter("active is null").count() == 1
    assert U.lists_at_fetch(shots.limit(0), spark.createDataFrame([("L", "host", "a.b", "add", START)], LOG)).count() == 0


def distance_in(item, text):
    """Least edits of ``item`` anywhere in ``text``."""
    row = [0] * (len(text) + 1)
    for i, byte in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (byte != other), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(draw, text, edits):
    own = list(text)
    for _ in range(edits):
        at = draw.randrange(len(own))
        kind = draw.choice("sid")
        own[at:at + (kind != "i")] = [] if kind == "d" else [draw.choice("klmnop")]
    return "".join(own)


def test_leaks_equal_plain_alignment(spark):
    draw = random.Random(6)
    items = [(i, odd.prose(200 + i, n)) for i, n in enumerate((5, 9, 14, 20, 30))] + [(7, "tiny"), (8, None), (9, odd.prose(200, 5))]
    docs = []
    for n in range(120):
        item = draw.choice(items[:5])[1]
        docs.append((n, odd.prose(1000 + n, draw.randint(0, 12)) + " " + edited(draw, item, draw.randint(0, 9)) + " " + odd.prose(2000 + n, draw.randint(0, 12))))
    found = {(r.doc_id, r.item_id): r for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n, text in docs:
        for i, item in items[:5]:
            data, own = D.folded(text.encode()), D.folded(item.encode())
            edits = distance_in(own, data)
            hit = found.pop((n, i), None)
            assert (hit is not None) == (edits <= D.budget(len(own))), (n, i, edits)
            if hit:
                assert hit.edits == edits and distance_in(own, data[hit.start:hit.end]) == edits
    assert not found


def test_blocks_find_what_one_block_finds(spark):
    items = spark.createDataFrame([(i, odd.prose(300 + i, 20)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, odd.prose(400 + i, 30) + " " + odd.prose(300 + i, 20).upper()) for i in range(12)], "doc_id long, text string")
    pairs = lambda **o: sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items, **o).collect())
    assert pairs() == pairs(block_bytes=600) == [(i, i) for i in range(12)]
    assert D.leaks_removed(docs, items, block_bytes=600).count() == 0


def test_parts_of_long_items_and_short_items_are_found(spark):
    long = odd.prose(500, 400)
    item_rows = [(1, long), (2, "Yes"), (3, "a short item"), (4, "twenty bytes of item")]
    docs = [(1, odd.prose(1, 20) + " " + long[700:1500] + " " + odd.prose(2, 20)), (2, long.upper()), (3, "yes"), (4, "yes or no"), (5, "Here is a short\titem."), (6, "a shorx item"), (7, "xx twenty bytes of item"), (8, "twenty bytes uf item"), (9, long[:300] + odd.prose(3, 40))]
    found = {(r.doc_id, r.item_id): (r.part, r.edits, r.start) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item_rows, "item_id long, text string")).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 2), (5, 3), (7, 4)}
    assert found[1, 1][0] and found[1, 1][1] == 0 and not found[2, 1][0] and found[7, 4] == (False, 0, 3)


def test_every_piece_that_stays_whole_has_its_seed(monkeypatch):
    draw = random.Random(9)
    monkeypatch.setattr(D, "SLICE_BYTES", 64)
    every = np.full(D.CHUNK_BITS // 8, 255, dtype=np.uint8)
    for n in range(300):
        passage = odd.prose(n, draw.randint(3, 60)).encode()
        need, pieces = D.pieces_of(passage)
        text = edited(draw, passage.decode(), draw.randint(0, D.budget(len(passage)))).encode()
        (own,) = D.seeds_in([text], every)
        assert need >= 1 and sum(bool(np.isin(p, own).any()) for p in pieces) >= need
        assert set(own) == set(D.grams(text)) if len(text) >= D.Q else len(own) == 1


def test_filter_holds_every_seed(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_BITS", 1 << 18)
    hashes = D.mixed(np.arange(1, 20_000, dtype=np.uint64))
    held = D.seed_filter(spark.createDataFrame([(int(h),) for h in D.signed(hashes)], "seed long"))
    assert len(held) == 1 << 15 and len(D.passing(held, hashes)) == len(hashes)
    assert len(D.passing(held, D.mixed(np.arange(1 << 40, (1 << 40) + 20_000, dtype=np.uint64)))) < 2000


def test_odd_rows_for_leaks(spark):
    docs = odd.table(spark)
    items = spark.createDataFrame([(1, odd.prose(2, 60_000)[1000:1300]), (None, odd.prose(4, 12)), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()} == {(6, 1), (14, None)}
    left = D.leaks_removed(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.leaks(odd.empty(spark), items).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    from conftest import SF
    from marketloom.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [D.folded(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
        assert seen[-1].columns[: len(columns)] == columns, name
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) < set(ids[1]) and set(ids[3]) < set(ids[2]) and set(ids[4]) <= set(ids[3])
    leaked = {r.doc_id for r in seen[2].collect() if any(i in D.folded(r.text.encode()) for i in items)}
    assert leaked and set(ids[2]) - set(ids[3]) == leaked
    assert max(ids[4].count(i) for i in set(ids[4])) <= 2 and sorted(ids[5]) == sorted(ids[4])
    assert P.run(spark, SF).select(F.countDistinct("shard")).first()[0] > 1
    assert len(seen[-1].columns) == len(columns) + 3
