"""Sharding and mixing: laws, invariants and odd rows."""

from collections import Counter, defaultdict

import odd
import pytest
from marketloom.llm import mixing as M
from marketloom.llm import sharding as S
from pyspark.sql import functions as F

from conftest import SF


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_shards_follow_the_key_and_slots_have_no_gaps(spark):
    docs = documents(spark).select("doc_id", "text")
    rows = S.sharded(docs, bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and max(slots) < 40
    more = {r.doc_id: r.shard for r in S.sharded(docs, shards=41).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and any(r.grown_shard == 40 for r in rows)


def test_shuffle_agrees_on_reruns_and_depends_on_the_seed(spark):
    docs = documents(spark).select("doc_id", "text")
    order = lambda **o: [(r.doc_id, r.shard, r.slot) for r in S.sharded(docs.repartition(5), shards=2, **o).orderBy("shard", "slot").collect()]
    one = order()
    assert one == order() and one != order(seed=5)
    ids = [i for i, s, _ in one if s == 0]
    assert ids != sorted(ids)


def test_first_places_are_uniform(spark):
    """Over many seeds every row comes first about equally often."""
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    seen = Counter(next(r.doc_id for r in S.sharded(docs, shards=1, seed=s).collect() if r.slot == 0) for s in range(60))
    assert len(seen) >= 5 and max(seen.values()) <= 25


def test_odd_rows_in_shards(spark):
    docs = odd.table(spark)
    out = S.sharded(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[len(docs.columns):] == ["_shard", "_slot", "grown_shard"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r[0], r[1]) for r in odd.rows())
    assert S.sharded(odd.empty(spark)).count() == 0


def shared(sizes, weights, share, most):
    """Targets by moving the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in names}
        fixed.update({s: most * sizes[s] for s in over})


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, None: 50, "é": 700, "z": 0, "c": 10}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    assert got == pytest.approx(shared(sizes, (5, 2, 1), 1.5, 2))


@pytest.mark.parametrize("part_rows", [2048, 8])
def test_words_come_near_their_targets(spark, monkeypatch, part_rows):
    monkeypatch.setattr(M, "PART_ROWS", part_rows)
    monkeypatch.setattr(M, "FAN_IN", 3)
    docs = documents(spark)
    rows = M.mixed_documents(docs).collect()
    assert sorted(r.k0 for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1, 2)
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) for s in target)
    again = M.mixed_documents(docs.repartition(3)).collect()
    assert {r.k0: r.copies for r in again} == {r.k0: r.copies for r in rows}


def test_expected_copies_are_kept(spark):
    """Over many seeds a document is taken as often as its fraction says."""
    docs = spark.createDataFrame([(i, "w " * (1 + 7 * i)) for i in range(9)], "doc_id long, text string").withColumn("source", F.lit("s"))
    seen = Counter()
    for seed in range(40):
        for r in M.mixed_documents(docs, seed=seed).collect():
            seen[r.k0] += r.copies
    assert all(1.2 <= seen[i] / 40 <= 1.8 for i in range(9))


def test_odd_rows_in_the_mix(spark):
    docs = odd.table(spark)
    rows = M.mixed_documents(docs)
    assert rows.count() == docs.count()
    size = {(r.k0, r.nth): r.size for r in rows.collect()}
    assert size[(2, 1)] == 0 and size[(9, 1)] == 2 and (5, 2) in size
    out = M.mixed(docs)
    assert out.columns == docs.columns
    taken = Counter((r.doc_id, r.text) for r in out.collect())
    have = Counter((r[0], r[1]) for r in odd.rows())
    assert all(k in have and n <= 2 * have[k] for k, n in taken.items())
    assert M.mixed_documents(odd.empty(spark)).count() == 0 and M.mixed(odd.empty(spark)).count() == 0


def test_mixing_joins_alike_at_every_size(spark):
    """A small table of copies is no reason for another join: the disk that larger inputs take follows from smaller ones."""
    plan = M.mixed(odd.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
