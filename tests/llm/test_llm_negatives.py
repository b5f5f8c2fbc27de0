"""Hard negatives against brute force, the curve and the bounds."""

import itertools
import math
import random

import numpy as np
import pytest
from marketloom.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, block long, key string, rank int"


def plain(rows, asks, scale=256, low=80, high=100):
    q = {(i, tuple(math.floor(scale * float(np.float32(x))) for x in v), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v, l in q:
        if not asks(i):
            continue
        met = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in q if j != i and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in met if x[2] == l)[:5]:
            far = sorted(x for x in met if x[2] != l and low * -ps <= 100 * -x[0] <= high * -ps)[:5]
            out += [(i, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(far)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, "z", 2) for i, v, l in rows], SCHEMA)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in H.hard_negatives(df, anchor=F.col("vec_id") % 10 == 0, **more).collect())


def draws(n, dims, seed, labels=3):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0.05 * (i % labels), 0.2) for _ in range(dims)], i % labels) for i in range(n)]


def test_equal_to_brute_force_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 60)
    rows = draws(400, 12, 1)
    assert got(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = draws(60, 4, 2) + [(None, [1.0, 1, 1, 1], 1), (70, None, 1), (80, [1.0, None, 1, 1], 1), (90, [float("nan")] * 4, 1), (100, [float("inf"), 0, 0, 0], 1), (110, [0.5] * 4, None), (120, [], 1), (130, [0.2, 0.2], 1), (140, [0.1, 0.3], 2), (131, [0.2, 0.2], 1)]
    rows += [(150, [0.5, 0.5, 0.5, 0.5], 1)] * 3 + [(160, [0.5, 0.5, 0.5, 0.5], 1), (161, [0.5, 0.5, 0.5, 0.5], 1), (162, [0.45, 0.5, 0.5, 0.5], 2), (163, [0.45, 0.5, 0.5, 0.5], 2), (170, [0.1, 0.2, 0.3, 0.4], 1), (170, [0.4, 0.3, 0.2, 0.1], 1)]
    assert got(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert got(spark, []) == []


def test_one_label_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 40)
    rows = [(i, [0.3, 0.1, 0.2], 1) for i in range(200)] + [(1000 + i, [0.3, 0.1, 0.19], 2) for i in range(30)]
    assert got(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert got(spark, rows[:50]) == []


def test_huge_components_stay_exact(spark):
    rows = [(10, [1e6, 1.0], 1), (1, [1e6, 2.0], 1), (2, [1e6 + 2, 1.0], 1), (3, [1e6 - 2, 1.0], 2), (4, [0.9e6, 1.0], 2)]
    assert {r[:4] for r in got(spark, rows)} == {r[:4] for r in plain(rows, lambda i: i % 10 == 0)}


def test_zones_leave_blocks_out(spark, monkeypatch):
    """Where rows lie in clusters, most blocks are not read."""
    monkeypatch.setattr(H, "PART_ROWS", 64)
    draw = random.Random(5)
    rows = []
    for i in range(1200):
        c = i % 12
        rows.append((i, [(2.0 if k == c else 0.0) + draw.gauss(0, 0.01) for k in range(12)], c))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table = H.blocks(df, anchor=F.col("vec_id") % 10 == 0)
    assert table.agg(F.sum("n")).first()[0] == 1200
    assert got(spark, rows[:240]) == plain(rows[:240], lambda i: i % 10 == 0)
    v = H.unpacked(*(lambda r: (r.vectors, r.n, r.dims))(table.first()))
    others = [r for r in table.collect() if r.label != table.first().label]
    chosen = 0
    for r in others:
        least, most = H.bounds(v[:1], H.unpacked(r.low, 1, 12), H.unpacked(r.high, 1, 12))
        chosen += most[0, 0] * 100 >= 80 * (v[0] @ v[0])
    assert chosen == 0


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_the_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = H.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = draw.integers(-300, 300, (5, 6)).astype(float), draw.integers(-300, 300, (9, 6)).astype(float)
        least, most = H.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
        s = H.scores(a, b)
        assert (s >= least).all() and (s <= most).all()
