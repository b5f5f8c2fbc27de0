"""Quality rules against a plain count, and the bound against the binomial sum."""

import math
import random
import re
from collections import Counter

import odd
import pandas as pd
from marketloom.llm import quality_rules as Q
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, seen, again, covered = WORD.findall(text), set(), 0, set()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_measures_equal_a_plain_count():
    draw = random.Random(5)
    texts = [r[1] for r in odd.rows() if r[1] is None or len(r[1]) < 5000]
    texts += ["\n".join(" ".join(draw.choice(["a", "b", "é|", "#c"]) for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(1, 9))) for _ in range(200)]
    for text in texts:
        assert Q.measure(None if text is None else text.encode())[:5] == plain(text)


def test_bound_is_the_rate_at_which_so_few_are_unlikely():
    for lost, good, error in ((0, 40, 0.01), (3, 200, 0.001), (50, 1000, 0.05)):
        p = Q.loss_bound(lost, good, error)
        tail = sum(math.comb(good, i) * p**i * (1 - p) ** (good - i) for i in range(lost + 1))
        assert abs(tail - error) < 1e-6
    assert Q.loss_bound(0, 0, 0.1) == 1.0


def test_cutoffs_reject_junk_only_where_labels_prove_it(spark):
    good = [(i, "en", odd.prose(i, 30)) for i in range(3000)]
    bad = [(9000 + i, "en", odd.prose(i, 30).replace(" ", "### ")) for i in range(50)]
    few = [(9500 + i, "de", odd.prose(i, 30).replace(" ", "### ")) for i in range(50)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(9500 + i, 1) for i in range(20)] + [(9000, 0), (None, 1), (1, None)], "doc_id long, quality int")
    left = {r.doc_id for r in Q.rejected_removed(docs, labels).select("doc_id").collect()}
    assert not left & set(range(9000, 9050))
    assert set(range(9500, 9550)) <= left and len(left & set(range(3000))) >= 0.98 * 3000


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 1), (5, 0)], "doc_id long, quality int")
    docs = odd.table(spark)
    measured = Q.measured_documents(docs)
    judged = Q.judged(measured, Q.cutoffs(measured, labels, "lang"), "lang")
    assert judged.count() == docs.count()
    left = Q.rejected_removed(docs, labels)
    assert left.columns == docs.columns and left.filter("text is null or trim(text) = ''").count() == 0
    assert left.filter(F.col("doc_id") == 5).count() == 2
    none = Q.rejected_removed(odd.empty(spark), labels)
    assert none.columns == docs.columns and none.count() == 0
    assert Q.rejected_removed(docs, labels.limit(0)).count() == left.count()


def settings(good, bad, strata=4):
    """The cutoffs of one stratum of labelled rows, each a step for every rule."""
    rows = pd.DataFrame([("x", *steps, n, 0) for steps, n in good] + [("x", *steps, 0, n) for steps, n in bad], columns=["stratum", *Q.RULES, "good", "bad"])
    return Q._chosen(rows, Q.DELTA / strata, Q.LOSS)


def test_a_small_stratum_gets_what_its_labels_prove():
    clean, junk = (0, 0, 0, 0), (9, 0, 0, 0)
    out = settings([(clean, 312)], [(junk, 50)])
    assert out["all_caught"].unique() == [50] and out["bound"].max() <= Q.LOSS and set(out["rule"]) == set(Q.RULES)
    none = settings([(clean, 218)], [(junk, 50)])
    assert none["cutoff"].isna().all() and none["bound"].isna().all() and none["good"].unique() == [218]


def test_rules_that_stop_midway_are_joined_where_each_is_proven():
    """Every rule must stop before its strictest cutoff; with many labels all four still get one."""
    point = lambda k, step: tuple(step if j == k else 0 for j in range(4))
    out = settings([((0, 0, 0, 0), 20_000)] + [(point(k, 9), 600) for k in range(4)], [(point(k, 20), 10) for k in range(4)])
    assert out["cutoff"].notna().all() and out["all_caught"].unique() == [40] and out["all_lost"].unique() == [0]


def test_settings_rarely_lose_more_than_they_may():
    """Good rows drawn so that the strictest settings lose 3 %: a setting that loses more than 2 % is taken with a chance below delta."""
    draw, wrong = random.Random(8), 0
    for _ in range(200):
        n = sum(draw.random() < 0.03 for _ in range(400))
        out = settings([((0, 0, 0, 0), 400 - n), ((1, 1, 1, 1), n)], [((21, 1, 1, 1), 30)], 1)
        wrong += bool((out["cutoff"] == Q.GRID[0]).any())
    assert wrong <= 0.05 * 200 * 1.5
