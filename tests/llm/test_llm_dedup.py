"""MinHash groups and suffix dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from marketloom.llm import minhash as M
from marketloom.llm import suffixes as S
from pyspark.sql import functions as F


def set_of(text, width=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def components(rows, width=3, percent=85):
    """rows (id, text) -> the smallest id reachable, by comparing all pairs."""
    sets, up = [set_of(t, width) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)].append(own)
    return [min(least[root(i)], default=None) for i in range(len(rows))]


def chained(count):
    """Near copies: a drift in which neighbours link and the ends do not, and copies with a few edits of their own."""
    draw, out, words = random.Random(3), [], odd.prose(77, 120).split()
    for i in range(count):
        words = list(words)
        words[draw.randrange(len(words))] = f"w{i}"
        out.append((100 + i, " ".join(words)))
    base = odd.prose(78, 120).split()
    for i in range(count):
        own = list(base)
        for k in draw.sample(range(len(own)), draw.choice([1, 2, 3, 4])):
            own[k] = f"e{i}x{k}"
        out.append((1000 + i, " ".join(own)))
    return out


def test_groups_equal_all_pairs(spark):
    rows = [(r[0], r[1]) for r in odd.rows()] + chained(60)
    found = M.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((i, len(set_of(t)), c, i == c) for (i, t), c in zip(rows, components(rows), strict=True) if i is not None)
    assert Counter((r.id, r.n, r.component, r.kept) for r in found if r.id is not None) == want
    assert {r.component for r in found if r.id is None} == {4, None}  # the null id with the text of others joins them


def test_words_and_similarity_are_parameters(spark, monkeypatch):
    """The pipeline's rule, five words and 0.8, in one bucket; it differs from the other on these rows."""
    monkeypatch.setattr(M, "_in_buckets", lambda classes: classes.select(F.lit(0).alias("bucket"), "sid", "n"))
    rows = [(i, t) for i, t in chained(40)] + [(1, "a b c d"), (2, "a b c d"), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: (r.component, r.n) for r in M.grouped(df, width=5, percent=80).collect()}
    assert found == {i: (c, len(set_of(t, 5))) for (i, t), c in zip(rows, components(rows, 5, 80), strict=True)}
    assert {i: c for i, (c, _) in found.items()} != dict(zip((i for i, _ in rows), components(rows), strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_inside_a_bucket_are_not_lost(spark, monkeypatch, seed):
    """All classes in one bucket: what the leads leave out must still be what brute force leaves out."""
    monkeypatch.setattr(M, "BLOCK", 30)
    monkeypatch.setattr(M, "_in_buckets", lambda classes: classes.select(F.lit(0).alias("bucket"), "sid", "n"))
    draw, base = random.Random(seed), odd.prose(79, 100).split()
    rows = chained(40)
    for i in range(60):
        own = list(base)
        for k in draw.sample(range(0, 100, 3), draw.randint(2, 9)):
            own[k:k + 1] = [f"v{k}"] * draw.choice([0, 1, 1, 2])
        rows.append((5000 + i, " ".join(own)))
    found = {r.id: r.component for r in M.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(zip((i for i, _ in rows), components(rows), strict=True))
    assert 5 < len(set(found.values())) < len(rows)


def test_one_row_of_a_group_stays(spark):
    docs = odd.table(spark)
    left = M.copies_removed(docs)
    assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    rows = [(r[0], r[1]) for r in odd.rows()]
    groups = {(c if set_of(t) else ("alone", k)) for k, ((_, t), c) in enumerate(zip(rows, components(rows), strict=True))}
    assert len(kept) == len(groups)
    assert sum(t is not None and "x" * 900 in t for _, t in kept) == 1 and [i for i, _ in kept].count(5) == 0
    assert M.copies_removed(odd.empty(spark)).count() == 0
    twins = spark.createDataFrame([(None, "p q r s"), (None, "p q r s"), (None, "u v w x")], "doc_id long, text string")
    assert sorted(r.text for r in M.copies_removed(twins).collect()) == ["p q r s", "u v w x"]


def cut_plainly(bodies, length):
    often = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def repeating():
    draw = random.Random(9)
    passage, other = odd.prose(50, 120), odd.prose(51, 40)
    texts = [odd.prose(60 + i, draw.randint(1, 80)) + passage[draw.randrange(200):][:draw.randint(380, 520)] + odd.prose(90 + i, draw.randint(1, 80)) for i in range(40)]
    texts += [passage, passage, passage[:400], passage[1:400], other * 4, "ab" * 500, "ab" * 300 + "q", passage.replace("c", "C", 3)]
    texts += [None, "", "short", "ü" * 300, "ü" * 201]
    return texts


@pytest.mark.parametrize("buckets", [20_000, 7])
def test_repeats_equal_a_plain_search(spark, monkeypatch, buckets):
    """With seven rows a bucket every run crosses boundaries."""
    monkeypatch.setattr(S, "BUCKET_ROWS", buckets)
    texts = repeating()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(docs).collect()}
    assert [found[i] for i in range(len(texts))] == cut_plainly([(t or "").encode() for t in texts], S.LENGTH)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 1000)
    texts = [odd.prose(1, 900), odd.prose(2, 300) + odd.prose(1, 900)[1234:3456] + odd.prose(3, 100)]
    parts = [(i, at, p) for i, t in enumerate(texts) for _, at, p in S._pieces([i], [t.encode()])]
    assert max(len(p) for *_, p in parts) <= 1000 + S.LENGTH - 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(docs).collect()}
    assert [found[i] for i in range(2)] == cut_plainly([t.encode() for t in texts], S.LENGTH)


def test_odd_rows_for_repeats(spark):
    docs = odd.table(spark)
    out = S.repeats_removed(docs)
    assert out.count() == docs.count()
    # A row that is repeated counts as two texts, and so do copies under other ids.
    assert out.filter(F.col("doc_id").isin(4, 5)).agg(F.sum("n_removed")).first()[0] == 3 * len(odd.prose(1, 300))
    assert S.digests(odd.empty(spark)).count() == 0


def test_multikey_sort():
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 24))) for _ in range(300)]
    order, common = S.multikey_sort(S._keys(strings, 24))
    got = [strings[i].ljust(24, b"\0") for i in order]
    assert got == sorted(got)
    for k in range(1, len(got)):
        shared = next((i for i in range(24) if got[k][i] != got[k - 1][i]), 24)
        assert common[k] == shared


def test_every_run_with_the_leading_bytes_of_a_boundary_is_compared_with_other_buckets():
    """Runs that share 16 bytes are dealt by g, not by bytes: any of them may go on in the next bucket."""
    right = [(b"x" * 16 + bytes([65 + i]) * 400)[:400] for i in range(5)]
    five, zero = np.arange(5, dtype=np.int64), np.zeros(5, dtype=np.int64)
    _, cores = S.compare(five + 10, five + 100, right, [b""] * 5, zero, zero)
    assert {f for own, *_ in cores for f in own.tolist()} == {100, 101, 102, 103, 104}
