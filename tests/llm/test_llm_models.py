"""Licence scan, quality model and language ID: held-out accuracy, plain versions and odd rows."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import odd
import pytest
from marketloom.llm import language as L
from marketloom.llm import licenses as C
from marketloom.llm import quality_model as Q
from marketloom.llm.common import held_out
from pyspark.sql import functions as F

from conftest import SF


def documents(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark), documents(spark, "labels")
    weights = Q.learn(docs, labels)
    rows = docs.join(labels, "doc_id").select("quality", held_out("doc_id").alias("h"), Q.score(F.col("text"), weights).alias("s")).collect()
    good, bad = ([r.s for r in rows if r.quality == q] for q in (1, 0))
    assert min(good) > 0.3 and sum(s < 0.3 for s in bad) >= 0.7 * len(bad)
    assert any(r.h for r in rows)


def test_quality_update_is_follow_the_regularised_leader():
    """One step against the update written out for a single weight."""
    at, value = np.array([0, 7]), np.array([1.0, 1.0])
    w = Q.train([(at, value, 1)], epochs=1, alpha=1.0, beta=1.0, l1=0.1, l2=0.0)
    g = -0.5  # the score is 0.5 at first
    z, n = g, g * g
    assert w[7] == pytest.approx(-(z + 0.1) / (1 + math.sqrt(n)))


def test_quality_of_odd_rows(spark):
    docs = odd.table(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (4, 7), (4, 0)], "doc_id long, quality int")
    weights = Q.learn(docs, labels)
    rows = docs.select("text", Q.score(F.col("text"), weights).alias("s")).collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r.s <= 1 for r in rows)
    assert len({r.s for r in rows if not (r.text or "").strip()}) == 1
    assert not Q.learn(docs, labels.limit(0)).any() and not Q.learn(odd.empty(spark), labels).any()


def plain_bits(texts, text):
    """Prediction by partial matching of one language, byte by byte."""
    seen = defaultdict(lambda: defaultdict(int))
    for t in texts:
        data = b"\n\n\n" + t
        for i in range(3, len(data)):
            for order in range(4):
                seen[data[i - order:i]][data[i]] += 1
    data, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(data)):
        for order in (3, 2, 1, 0):
            here = seen.get(data[i - order:i])
            if here:
                total = sum(here.values()) + len(here)
                if data[i] in here:
                    bits -= math.log2(here[data[i]] / total)
                    break
                bits -= math.log2(len(here) / total)
        else:
            bits += 8
    return bits


def trees_of(texts):
    langs, rows = sorted(texts), []
    for i, name in enumerate(langs):
        four, starts = L.grams(texts[name])
        gram, n = np.unique(four[L._own(len(four), starts)], return_counts=True)
        rows.append((gram, np.full(len(gram), i), n))
    return L.Trees(langs, *(np.concatenate(c) for c in zip(*rows, strict=True))).opened()


def test_code_lengths_are_exact():
    draw = random.Random(4)
    word = lambda letters: bytes(draw.choice(letters) for _ in range(draw.randint(0, 60)))
    texts = {"a": [word(b"abc ") for _ in range(30)] + [b""], "b": [word(b"xyza ") for _ in range(30)], "c": [b"q"]}
    trees = trees_of(texts)
    run = [word(b"abcxyzq \xc3") for _ in range(40)] + [b"", b"z", b""]
    got = trees.lengths(run)
    for i, text in enumerate(run):
        for j, name in enumerate("abc"):
            assert got[i, j] == pytest.approx(plain_bits(texts[name], text), abs=1e-3)


def test_language_on_held_out_rows(spark):
    docs = documents(spark)
    rows = docs.select("lang", held_out("doc_id").alias("h"), L.predict(F.col("text"), L.learn(docs)).alias("p")).filter("h").collect()
    assert rows and sum(r.p.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_language_of_odd_rows(spark):
    docs = odd.table(spark)
    rows = docs.select("text", L.predict(F.col("text"), L.learn(docs)).alias("p")).collect()
    assert len(rows) == len(odd.rows())
    for r in rows:
        assert 0 <= r.p.score <= 1 and (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert L.learn(odd.empty(spark)) is None
    assert {r.p.lang_pred for r in docs.select(L.predict(F.col("text"), None).alias("p")).collect()} == {"und"}


@pytest.fixture(scope="module")
def licence_model(spark):
    return C.learn(documents(spark))


def test_licences_in_documents(spark, licence_model):
    docs = documents(spark)
    found = {(r.doc_id, r.paragraph): r.family for r in C.scan(docs, model=licence_model).collect()}
    stated = {"Apache License, Version 2.0": "apache", "MIT License": "mit", "GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc"}
    want = {(r.doc_id, k): family for r in docs.collect() for k, line in enumerate((r.text or "").split("\n")) for name, family in stated.items() if name in line}
    assert want and {k: found.get(k) for k in want} == want
    assert all(family == "unknown" for k, family in found.items() if k not in want)


def test_unknown_licences_and_other_text_are_not_taken_for_families(spark, licence_model):
    lines = ["Licensed under the Rules of our House, version 7.", "The dog has no licence for this bike.", "licence", "This work is licensed under the GNU Affero General Public License, version 3.",
             "Released under the terms of the Mozilla Public License, version 2.0.", "MIT LICENSE", "Redistribution and use in source and binary forms, with or without modification, are permitted."]
    found = {r.paragraph: r for r in C.scan(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), model=licence_model).collect()}
    assert [found[k].family for k in range(len(lines))] == ["unknown", "unknown", "unknown", "agpl", "mpl", found[5].family, found[6].family]
    assert found[5].family in ("mit", "unknown") and found[6].family in ("bsd", "unknown")


def test_licences_of_odd_rows(spark, licence_model):
    docs = odd.table(spark).unionByName(spark.createDataFrame([(None, "x\nReleased under the MIT License.\nReleased under the MIT License.", None, None, 1, *("z" for _ in odd.CLASHING))], odd.SCHEMA))
    found = C.scan(docs, model=licence_model).collect()
    assert [(r.doc_id, r.family) for r in found] == [(None, "mit")] * 2 and {r.paragraph for r in found} == {1, 2}
    assert C.scan(odd.empty(spark), model=licence_model).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "apache": "Licensed under the Apache\nLicense, Version 2.0.",
    "gpl": "You may use this file under the GNU\nGeneral Public License, version 3.",
    "cc-by": "This work is licensed under Creative\nCommons Attribution 4.0 International License.",
}


def test_wrapped_notices_are_compared_whole(spark, licence_model):
    rows = [(name, f"one two three\n\n{text}\n\nfour five") for name, text in WRAPPED.items()]
    found = {(r.doc_id, r.paragraph): r.family for r in C.scan(spark.createDataFrame(rows, "doc_id string, text string"), model=licence_model).collect()}
    assert {name: found.get((name, 2)) for name in WRAPPED} == {name: name for name in WRAPPED}
    # A blank line ends a notice, and a line takes no part in what the next lines say by themselves.
    apart = [("a", WRAPPED["bsd"].replace("\n", "\n\n")), ("b", "Licensed under the Rules of our House.\nReleased under the MIT License.")]
    found = {(r.doc_id, r.paragraph): r.family for r in C.scan(spark.createDataFrame(apart, "doc_id string, text string"), model=licence_model).collect()}
    assert found == {("a", 0): "unknown", ("b", 0): "unknown", ("b", 1): "mit"}


def test_a_notice_that_its_paragraph_interrupts_is_compared_whole(spark, licence_model):
    # More words stand between the parts of the notice than twice the longest template has; on one line it is found.
    lines = WRAPPED["bsd"].split("\n")
    plain = [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(60)]
    rows = [("apart", "\n".join([lines[0], *plain, *lines[1:]])), ("ended", "\n".join([lines[0], *plain, "", *lines[1:]])), ("one", " ".join([lines[0], *plain, *lines[1:]]))]
    found = {(r.doc_id, r.paragraph): r for r in C.scan(spark.createDataFrame(rows, "doc_id string, text string"), model=licence_model).collect()}
    assert found["one", 0].family == found["apart", 0].family == "bsd" and found["apart", 0].confirmed and found["apart", 0].similarity >= 0.8
    assert found["ended", 0].family == "unknown"


def test_reserved_rights_and_other_licences_give_rows(spark, licence_model):
    lines = ["All rights reserved.", "Copyright 2020 A. Nyone", "Alle Rechte vorbehalten.", "Lizenz: Hausordnung", "Released under the ISC License.", "Licensed under the Eclipse Public License 2.0.", "nothing of the kind"]
    found = {r.paragraph: r.family for r in C.scan(spark.createDataFrame([(1, "\n\n".join(lines))], "doc_id long, text string"), model=licence_model).collect()}
    assert found == {0: "unknown", 2: "unknown", 4: "unknown", 6: "unknown", 8: "isc", 10: "epl"}


def plain_grams(tokens, least, most):
    return {" ".join(tokens[i:i + n]) for n in range(least, most + 1) for i in range(len(tokens) - n + 1)}


@pytest.mark.parametrize("least, most", [(1, 3), (2, 2), (1, 2)])
def test_grams_are_those_of_plain_python(spark, least, most):
    texts = ["", "one", "one two", "Licensed under the MIT License now", "a a a a b a a a"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", C.grams(C.words(F.col("text")), least, most).alias("g")).collect()
    for r in rows:
        assert len(r.g) == len(set(r.g)) and set(r.g) == plain_grams(r.text.lower().split(), least, most)


def test_similarity_is_a_plain_share(spark):
    templates = [["a b", "b c", "c d"], ["x y"], ["b c", "c q"]]
    for own, others in [(["a b", "b c", "z"], []), (["x y", "b c"], ["x y"]), (["q"], []), (["a b", "b c"], ["a b", "b c"])]:
        shares = [len(set(t) & set(own)) / len(t) for t in templates if len(set(t) & set(own)) > len(set(t) & set(others))]
        row = spark.createDataFrame([(templates, own, others)], "t array<array<string>>, a array<string>, b array<string>").select(C.similarity(F.col("t"), F.col("a"), F.col("b")).alias("s")).first()
        assert row.s == pytest.approx(max(shares, default=0.0))


FULL = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
}


@pytest.mark.parametrize("width", [10**6, 72, 30])
def test_full_notices_are_confirmed_on_one_line_and_wrapped(spark, licence_model, width):
    import textwrap

    rows = [(name, "\n".join(textwrap.wrap(text, width))) for name, text in FULL.items()]
    found = {(r.doc_id, r.paragraph): r for r in C.scan(spark.createDataFrame(rows, "doc_id string, text string"), model=licence_model).collect()}
    for name in FULL:
        assert found[name, 0].family == name and found[name, 0].confirmed and found[name, 0].similarity >= 0.8


def test_the_gate_loses_no_sampled_paragraph(licence_model):
    assert licence_model.missed == 0.0 and {"licensed", "reserved", "lizenz", "permission", "redistribution"} <= set(licence_model.triggers)


def every_line(docs, model):
    """What ``scan`` gives when every line with words is joined and scored."""
    t = docs.select("doc_id", F.transform(F.split("text", "\n"), C.words).alias("t"))
    hits = t.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("key"), "t", F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.size(F.get("t", i)) > 0).alias("hits"))
    found = C._candidates(C._begun(C.stored(hits))).withColumn("words", F.concat("own", "rest"))
    found = C.stored(found.select("candidate", "key", "paragraph", "joined", C.grams(F.col("words"), 1, 2).alias("short"), C.grams(F.col("rest"), 1, 2).alias("others"), C.grams(F.col("words")).alias("grams")))
    one = C._met(found, model).groupBy("candidate").agg(F.min(F.struct((~F.col("sure")).alias("open"), "joined", "key", "paragraph", "family", "probability")).alias("x"))
    return sorted((r.key, r.paragraph, r.family, round(r.probability, 6), not r.open) for r in one.select("x.*").collect())


def test_no_line_is_left_out(spark, licence_model):
    rows = ["Modifications are permitted.", "This\n" + C.NOTICES["gpl"][0].removeprefix("This "), "permitted\nsubject to\nany", "the mit is this", "this is the mit of any", "x", "", "\n\n--\n", "a\n\nthe\nGNU\nGeneral\nPublic License\n\nb",
            *("plain words here\n" + w.replace(" ", "\n") + "\nmore words" for _, w in C._wordings()), *WRAPPED.values(), *licence_model.features.vocabulary]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = every_line(docs, licence_model)
    found = sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 6), r.confirmed) for r in C.scan(docs, model=licence_model).collect())
    assert found == want
    # "This" is no rare word, so that a gate of such words leaves its line out.
    assert (1, 0, "gpl", True) in {(*r[:3], r[4]) for r in found}


def test_needed_words_stand_in_whatever_holds_enough_of_a_template():
    draw = random.Random(3)
    templates = [[f"{draw.choice('abcdef')} {draw.choice('abcdefgh')}" for _ in range(n)] for n in (1, 2, 4, 5, 9, 14)]
    templates = [sorted(set(t)) for t in templates]
    for t in templates:
        needed = set(C._needed([t], {"a": 9, "b": 7, "c": 1}))
        enough = next(n for n in range(len(t) + 1) if n / len(t) >= C.CONFIRMED_SHARE)
        for held in itertools.combinations(t, enough):
            assert needed & {w for pair in held for w in pair.split(" ")}
