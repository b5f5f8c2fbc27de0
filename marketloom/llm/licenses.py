"""Licence scan: a trained paragraph classifier whose findings are confirmed by template comparison.

Every line of every text is a paragraph, alone and joined with the lines that follow it up to a blank one, so a notice
or a name that is wrapped is compared whole; a finding is named by the line it begins in. A multinomial logistic
regression over word n-grams (one to three words, those of the licence wording) knows the families of ``NAMES`` and ``NOTICES``, the class
``unknown`` (licence wording with other names, reserved rights: ``OTHERS``) and the class ``plain``: a sample of the
corpus' own paragraphs, whole and in pieces, and the later lines of wrapped notices, which state nothing by themselves.
A third of the training rows is kept back to calibrate: the probability a family must reach is the one that only
``UNKNOWN_LOSS`` of the kept-back unknown rows pass, and a line gives a row only where its chance not to be plain passes
what ``PLAIN_LOSS`` of the kept-back sampled paragraphs reach. A family is confirmed when one of its templates shares
``CONFIRMED_SHARE`` of its word pairs with the paragraph; what is not confirmed is ``unknown``. Of the joins of a line
the shortest confirmed one counts, and only if the line itself adds to what the template shares.

Most lines need no score, and none that would give a row goes without one. A line can speak of a licence only if the fitted weights of its
words, each with those of the n-grams of which it is the rarest word (``Model.triggers``), reach ``Model.gap``: no other word raises the odds, so the sum
bounds them. A join can be confirmed only where its whole paragraph holds enough of a template, so at least one of the
words that stand for the template's rarest pairs (``Model.needed``), and only from a line in which one of that template's
pairs begins. ``Model.missed`` measures on the sampled paragraphs that the first bound loses none.
A line is first joined with lines after it until twice the longest template's words are together (``joined_words``).
Where its paragraph goes on and nothing is confirmed so far, ``_beyond`` compares all longer joins up to the blank line:
a join is another one only at the line in which a word or n-gram of the licence wording is complete for the first time,
so it has at most two joins for each of them, however long the paragraph is.

Only built-in columns and the JVM's own learner are used. The training sample is bounded by ``SAMPLE_PARAGRAPHS``.

Defined results: null and empty texts have no paragraphs; lines without words are none; a line that
repeats is reported at each place; a null id is reported as null; an empty table trains on the templates
alone and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, stored

UNKNOWN, PLAIN = "unknown", "plain"
#: Names and sentences by which licences are stated.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 License", "Apache Software License"],
    "mit": ["MIT License", "MIT license", "Expat MIT License", "MIT software license"],
    "bsd": ["BSD License", "BSD-3-Clause license", "BSD 2-Clause License", "3-clause BSD License", "New BSD License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0 license", "GPLv3 license", "GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU LGPL", "LGPL-2.1 license", "GNU Lesser General Public License"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0 license", "GNU Affero General Public License"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0 license"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0 license", "Creative Commons Attribution license"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0 license", "CC BY-SA 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0 license", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 public domain dedication", "Creative Commons Zero license"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0 license"],
    "isc": ["ISC License", "ISC software license"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "Eclipse Public License", "EPL-2.0 license"],
    "boost": ["Boost Software License 1.0", "Boost Software License", "BSL-1.0 license"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "artistic": ["Artistic License 2.0", "Artistic License"],
    "unlicense": ["The Unlicense", "Unlicense license"],
}
SENTENCES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This text is made available under the {}.", "You may use this file under the {}.", "License: {}", "Use of this source code is governed by the {}."]
NOTICES = {
    "apache": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Licence wording that names no family; ``{}`` stands for other words.
OTHERS = ["All rights reserved.", "{} All rights reserved.", "Copyright {}", "Copyright 2020 {}", "Copyright (c) 2019 {}", "\u00a9 2021 {}", "\u00a9 {}", "{} licence {}", "{} license {}", "licence", "license", "License", "Licence: {}", "the licences of {}", "licenses {}", "licensing {}",
          "Use is permitted without warranty {}", "public domain {}", "{} free software {}", "Alle Rechte vorbehalten.", "Rechte vorbehalten {}", "Lizenz: {}", "Lizenziert unter {}", "Urheberrecht {}", "Tous droits r\u00e9serv\u00e9s.", "droits r\u00e9serv\u00e9s {}", "Droits d'auteur {}", "sous licence {}",
          "Todos los derechos reservados.", "derechos reservados {}", "derechos de autor {}", "licencia {}", "Permission to use {} is hereby granted"]
SAMPLE_PARAGRAPHS = 2000
UNKNOWN_LOSS = 0.01
PLAIN_LOSS = 0.001
LEAST_PROBABILITY = 0.5
CONFIRMED_SHARE = 0.8
#: What sums of weights may lose to rounding.
ROUNDING = 1e-6
#: Every wording of ``OTHERS`` is shown with so many names.
OTHER_NAMES = 20
#: Words of a sampled paragraph that stand in for names, and that follow a notice on the same line.
LONGEST_NAME, LONGEST_TAIL = 6, 24


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\u00a9.+-]+|[.+-]+(?=[^\\p{L}\\p{N}]|$)", " "), " +"), lambda w: w != "")


def _grams_of(tokens: Column, n: int) -> Column:
    # A lambda of one argument: a second one, even with a default, would be the place of the element.
    joined = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def grams(tokens: Column, least: int = 1, most: int = 3) -> Column:
    """Distinct word n-grams of ``least`` to ``most`` words."""
    return F.array_distinct(F.concat(*(_grams_of(tokens, n) for n in range(least, most + 1))))


def _wordings() -> list[tuple[str, str]]:
    """(family, text): every name, and the notices."""
    return [(family, name) for family, names in NAMES.items() for name in names] + [(family, text) for family, texts in NOTICES.items() for text in texts]


def _templates(spark: SparkSession) -> DataFrame:
    """(family, pairs): the word pairs of every name and notice; single words where a name has but one."""
    tokens = words(F.col("text"))
    return spark.createDataFrame(_wordings(), "family string, text string").select("family", F.when(F.size(tokens) > 1, grams(tokens, 2, 2)).otherwise(tokens).alias("pairs"))


def joined_words() -> int:
    """Twice the words of the longest template."""
    return 2 * max(len(text.split()) for _, text in _wordings())


def _training_texts(pieces: list[str]) -> list[tuple[str, str]]:
    """(family, text): licence wording alone and before other words, later lines of notices, and pieces of plain text."""
    tail = lambda i: " ".join(pieces[i % len(pieces)].split()[:LONGEST_TAIL]) if pieces else ""
    name = lambda i: " ".join(pieces[i % len(pieces)].split()[:1 + i % LONGEST_NAME]) if pieces else ""
    known = [(family, sentence.format(n)) for family, names in NAMES.items() for n in names for sentence in SENTENCES]
    cut = lambda text, start, stop: " ".join(text.split()[len(text.split()) * start // 6:len(text.split()) * stop // 6])
    known += [(family, cut(text, 0, k)) for family, texts in NOTICES.items() for text in texts for k in (3, 4, 5, 6, 6)]
    known += [(family, f"{text} {tail(i)}") for i, (family, text) in enumerate(known)]
    other = [(UNKNOWN, wording.replace("{}", name(7 * i + k))) for k in range(OTHER_NAMES) for i, wording in enumerate([*OTHERS, *SENTENCES])]
    later = [(PLAIN, cut(text, start, stop)) for texts in NOTICES.values() for text in texts for start, stop in ((2, 4), (2, 6), (3, 5), (3, 6), (4, 6), (5, 6))]
    return known + other + 4 * later + [(PLAIN, name(i)) for i in range(len(pieces))]


def _sampled(docs: DataFrame, text: str) -> DataFrame:
    """(text): a bounded sample of the corpus' paragraphs, by the lowest hash."""
    lines = docs.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("text")).select("text", F.xxhash64(F.lit(3), "text").alias("h"))
    # Drawn by hash before anything is looked at, about the wanted number; then the lowest hashes, so that the bound holds.
    share = max(1, docs.count() // SAMPLE_PARAGRAPHS)
    return lines.filter((F.pmod("h", F.lit(share)) == 0) & (F.trim("text") != "")).orderBy("h", "text").limit(SAMPLE_PARAGRAPHS).select("text")


class Model:
    """The classifier, its classes by number, what a family and a row must reach, and the bounds by which a line needs no score.

    ``triggers`` are the words that may raise the odds against ``plain`` with how far they do, ``gap`` how far they have to;
    ``needed`` has a word at least of whatever confirms a template; ``missed`` is the share of sampled paragraphs that the bound loses.
    """

    def __init__(self, features: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], least: float, reported: float, triggers: dict[str, float], gap: float, needed: list[str], missed: float):
        self.features, self.regression, self.families, self.least, self.reported, self.triggers, self.gap, self.needed, self.missed = features, regression, families, least, reported, triggers, gap, needed, missed

    def may_speak(self, tokens: Column) -> Column:
        """False only for words that would not be reported as a line of their own."""
        held = F.array_intersect(tokens, F.array(*map(F.lit, self.triggers)).cast("array<string>"))
        gains = F.create_map(*(F.lit(x) for pair in self.triggers.items() for x in pair)) if self.triggers else F.lit(None).cast("map<string, double>")
        return (F.size(tokens) > 0) & (F.aggregate(held, F.lit(0.0), lambda sum_, w: sum_ + F.element_at(gains, w)) > self.gap - ROUNDING)

    def rated(self, rows: DataFrame) -> DataFrame:
        """``rows`` (grams, ...) with ``p``, the probability of every class."""
        return self.regression.transform(self.features.transform(rows)).withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def _best(p: str = "p") -> Column:
    """The largest probability of a family."""
    return F.array_max(F.slice(p, 1, len(NAMES)))


def learn(docs: DataFrame, text: str = "text") -> Model:
    spark = docs.sparkSession
    families = [*NAMES, UNKNOWN, PLAIN]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    # Licence wording, cut where other words may stand.
    wording = [t for _, t in _wordings()] + [t for w in [*OTHERS, *SENTENCES] for t in w.split("{}") if t.strip()]
    tokens = spark.createDataFrame([(w,) for w in wording], "text string").select(F.explode(F.array(words(F.col("text")))).alias("w"))
    vocabulary = sorted(r.g for r in tokens.select(F.explode(grams(F.col("w"))).alias("g")).distinct().collect())
    features = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    features.setBinary(True)
    vocabulary = [g for g in vocabulary if " " not in g]
    sample = stored(_sampled(docs, text).select(words(F.col("text")).alias("words")))
    # Paragraphs that may state a licence themselves teach nothing about plain text.
    doubtful = F.arrays_overlap("words", F.array(*map(F.lit, sorted(w for w in vocabulary if _telling(w)))))
    pieces = [r.w for r in sample.filter(~doubtful).select(F.array_join(F.slice("words", 1, LONGEST_TAIL), " ").alias("w")).orderBy(F.xxhash64("w"), "w").collect() if r.w]
    rows = spark.createDataFrame(_training_texts(pieces), "family string, text string").select("family", words(F.col("text")).alias("words"), F.lit(False).alias("whole"))
    # Words are a column of their own: inside the lambdas of ``grams`` they would be made anew for every gram.
    rows = stored(rows.unionByName(sample.filter(~doubtful).select(F.lit(PLAIN).alias("family"), "words", F.lit(True).alias("whole"))))
    rows = rows.select("family", "whole", number.cast("double").alias("label"), grams(F.col("words")).alias("grams"), (F.pmod(F.xxhash64("words"), F.lit(3)) == 0).alias("kept_back"))
    rows = stored(features.transform(rows).select("family", "whole", "label", "features", "kept_back"))
    regression = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, elasticNetParam=0.1, aggregationDepth=2).fit(rows.filter("not kept_back"))
    scored = regression.transform(rows.filter("kept_back")).select("family", "whole", vector_to_array("probability").alias("p"))
    some_licence = 1 - F.element_at("p", -1)
    edges = scored.agg(F.percentile(F.when(F.col("family") == UNKNOWN, _best()), 1 - UNKNOWN_LOSS).alias("known"), F.percentile(F.when(F.col("whole"), some_licence), 1 - PLAIN_LOSS).alias("plain")).first()
    reported = max(LEAST_PROBABILITY, edges.plain or 0.0)
    seen = {r.w: r.n for r in sample.select(F.explode(F.array_distinct(F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    triggers, gap = _bound(features, regression, reported, seen)
    needed = _needed([r.pairs for r in _templates(spark).collect()], seen)
    model = Model(features, regression, families, max(LEAST_PROBABILITY, edges.known or 0.0), reported, triggers, gap, needed, 0.0)
    per = model.rated(sample.select("words", grams(F.col("words")).alias("grams")))
    model.missed = per.agg(F.avg(((1 - F.element_at("p", -1) > reported) & (F.size("words") > 0) & ~model.may_speak(F.col("words"))).cast("double")).alias("m")).first().m or 0.0
    return model


def _telling(word: str) -> bool:
    """Words by which paragraphs are kept out of the plain training rows: stems of the licence words and the families' own names."""
    own = {w.strip("().,:\"").lower() for names in NAMES.values() for n in names for w in n.split()}
    stems = ("licen", "lizen", "copyright", "\u00a9", "reserved", "vorbehalten", "urheberrecht", "r\u00e9serv", "reservados", "redistribut", "granted")
    return word.startswith(stems) or (word in own and len(word) > 2 and not word.replace(".", "").isdigit())


def _bound(features: CountVectorizerModel, regression: LogisticRegressionModel, reported: float, seen: dict[str, int]) -> tuple[dict[str, float], float]:
    """How far a word with the n-grams of which it is the rarest word can raise the odds against ``plain``, and how far they have to be raised to be reported."""
    weights, base = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    gain = dict(zip(features.vocabulary, (weights[:-1] - weights[-1]).max(axis=0).tolist(), strict=True))
    most = {g: x for g, x in gain.items() if " " not in g}
    for g, x in gain.items():
        if " " in g and x > 0:
            most[min(g.split(" "), key=lambda w: (seen.get(w, 0), w))] += x
    gap = math.log(reported / (1 - reported)) - math.log(sum(math.exp(x - base[-1]) for x in base[:-1])) if reported < 1 else math.inf
    return {w: x for w, x in sorted(most.items()) if x > 0}, gap


def _needed(templates: list[list[str]], seen: dict[str, int]) -> list[str]:
    """Words of which a text holds one at least if it holds ``CONFIRMED_SHARE`` of the pairs of a template: the rarest words of its rarest pairs, one more than may be missing."""
    out, rare = set(), lambda pair: min((seen.get(w, 0), w) for w in pair.split(" "))
    for pairs in templates:
        enough = next(n for n in range(len(pairs) + 1) if n / len(pairs) >= CONFIRMED_SHARE)
        out |= {w for _, w in sorted(map(rare, pairs))[:len(pairs) - enough + 1]}
    return sorted(out)


def _hits(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(row, key, t, spoken, stated): the words of every line of the texts that may give a row, the places of lines that may speak of a licence, and whether the text may hold a template."""
    # ``explode`` of one element keeps what is in it a column that is made once.
    own = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(F.transform(F.split(F.col(f"`{text}`"), "\n"), words))).alias("t"))
    spoken = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: model.may_speak(F.get("t", i)))
    stated = F.arrays_overlap(F.flatten("t"), F.array(*map(F.lit, model.needed)))
    hits = own.select("key", "t", F.explode(F.array(F.struct(spoken.alias("spoken"), stated.alias("stated")))).alias("x")).select("key", "t", "x.*").filter((F.size("spoken") > 0) | F.col("stated"))
    # Rows may share their ids, so a row has a name of its own, which it keeps once it is written.
    return stored(hits.select(F.monotonically_increasing_id().alias("row"), "key", "t", "spoken", "stated"))


def _stating(hits: DataFrame) -> DataFrame:
    """(row, key, t, hits): the lines in which a pair of a template begins of which their paragraph holds enough."""
    places, size = F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.coalesce(F.size(F.get("t", i)), F.lit(0))
    first, last = (F.filter(places, lambda i: (size(i) > 0) & (size(i + by) <= 0)) for by in (-1, 1))
    each = hits.filter("stated").select("row", "key", "t", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("x")).select("row", "key", "t", "x.*")
    templates = F.collect_list("pairs")
    templates = _templates(hits.sparkSession).agg(templates.alias("templates"), F.array_distinct(F.flatten(templates)).alias("pairs"))
    held = each.withColumn("w", F.explode(F.array(F.flatten(F.slice("t", F.col("first") + 1, F.col("last") - F.col("first") + 1))))).crossJoin(F.broadcast(templates))
    # Of the pairs of a whole text only those of templates are compared with each template.
    held = held.withColumn("held", F.explode(F.array(F.array_intersect(grams(F.col("w"), 1, 2), F.col("pairs"))))).filter(F.size("held") > 0)
    reached = F.filter("templates", lambda t: F.size(F.array_intersect(t, F.col("held"))) / F.size(t) >= CONFIRMED_SHARE)
    telling = held.select("row", "key", "t", "first", "last", F.explode(F.array(F.array_distinct(F.flatten(reached)))).alias("telling")).filter(F.size("telling") > 0)
    near = lambda i: F.concat(F.get("t", i), F.slice(F.coalesce(F.get("t", i + 1), F.array().cast("array<string>")), 1, 1))
    # ``exists`` over one element names its words, which the lambdas of ``grams`` would make anew for every gram.
    begins = F.filter(F.sequence("first", "last"), lambda i: F.exists(F.array(near(i)), lambda w: F.arrays_overlap(grams(w, 1, 2), F.col("telling"))))
    return telling.select("row", "key", "t", begins.alias("hits"))


def _begun(hits: DataFrame) -> DataFrame:
    """(candidate, key, paragraph, own, after): the words of every line of ``hits``, and of the lines after it that may be joined at first."""
    # A line with words brings at least one, so that these lines hold more words than are joined if the paragraph does.
    one = hits.select("row", "key", F.explode(F.transform("hits", lambda i: F.struct(i.alias("paragraph"), F.get("t", i).alias("own"), F.slice("t", i + 2, joined_words() + 1).alias("after")))).alias("x")).select("row", "key", "x.*")
    blank = F.array_position(F.transform("after", lambda x: F.size(x) == 0), True).cast("int")
    one = one.withColumn("after", F.when(blank > 0, F.slice("after", 1, F.greatest(blank - 1, F.lit(0)))).otherwise(F.col("after")))
    return one.select(F.struct("row", "paragraph").alias("candidate"), "key", "paragraph", "own", "after")


def _candidates(begun: DataFrame) -> DataFrame:
    """(candidate, key, paragraph, joined, own, rest): every line of ``begun``, joined with no line and with more of those after it."""
    most = joined_words()
    one = begun.withColumn("joined", F.explode(F.sequence(F.lit(0), F.size("after"))))
    before = F.aggregate(F.slice("after", 1, F.greatest(F.col("joined") - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.size(x))
    rest = F.slice(F.flatten(F.slice("after", 1, F.col("joined"))), 1, most)
    return one.filter((F.col("joined") <= 1) | (before < most)).select("candidate", "key", "paragraph", "joined", "own", F.explode(F.array(rest)).alias("rest"))


def _placed_grams(lines: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(row, block, line, gram, end): the n-grams of the vocabulary in paragraphs of ``lines`` (row, line, w), with the lines in which they begin and end."""
    spark, none = lines.sparkSession, F.array().cast("array<string>")
    lines = lines.withColumn("block", F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line")))
    ahead = Window.partitionBy("row", "block").orderBy("line")
    lines = lines.withColumns({name: F.coalesce(F.lead(F.slice("w", 1, 2), k).over(ahead), none) for k, name in ((1, "next"), (2, "then"))})
    tokens = lines.select("row", "block", "line", F.size("w").alias("own"), (F.size("w") + F.size("next")).alias("near"), F.concat("w", F.slice(F.concat("next", "then"), 1, 2)).alias("tokens"))
    at = tokens.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("own"))))
    last = lambda n: F.col("at") + (n - 1)
    gram = lambda n: F.when(last(n) <= F.size("tokens"), F.array_join(F.slice("tokens", F.col("at"), n), " "))
    end = lambda n: F.col("line") + F.when(last(n) <= F.col("own"), 0).when(last(n) <= F.col("near"), 1).otherwise(2)
    each = at.select("row", "block", "line", F.explode(F.array(*(F.struct(gram(n).alias("gram"), end(n).alias("end")) for n in (1, 2, 3)))).alias("g")).select("row", "block", "line", "g.*")
    return each.join(F.broadcast(spark.createDataFrame([(g,) for g in vocabulary], "gram string")), "gram")


def _beyond(hits: DataFrame, open_ones: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(candidate, key, paragraph, joined, short, others, grams): the joins of ``open_ones`` (candidate, key, paragraph) up to the blank line that may confirm a template.

    Grams are those of the vocabulary, which is all that a score looks at. Only lines that hold a part of a template
    of which the whole paragraph holds enough are compared.
    """
    rows = open_ones.select(F.col("candidate.row").alias("row")).distinct()
    grams = stored(_placed_grams(hits.join(rows, "row", "left_semi").select("row", F.posexplode("t").alias("line", "w")).filter(F.size("w") > 0), vocabulary))
    templates = _templates(hits.sparkSession).agg(F.collect_list("pairs").alias("templates"))
    held = grams.groupBy("row", "block").agg(F.collect_set("gram").alias("held")).crossJoin(F.broadcast(templates))
    reached = F.filter("templates", lambda t: F.size(F.array_intersect(t, F.col("held"))) >= CONFIRMED_SHARE * F.size(t))
    telling = held.select("row", "block", F.explode(F.array_distinct(F.flatten(reached))).alias("gram"))
    begun = open_ones.select("candidate", "key", "paragraph", F.col("candidate.row").alias("row"), F.col("paragraph").alias("line"))
    begun = begun.join(grams.join(telling, ["row", "block", "gram"], "left_semi").select("row", "block", "line").distinct(), ["row", "line"]).drop("line")
    met = begun.join(grams, ["row", "block"]).filter(F.col("line") >= F.col("paragraph"))
    # Where a gram is first complete in the join, and in what follows its first line.
    first = met.groupBy("candidate", "key", "paragraph", "gram").agg(F.min("end").alias("whole"), F.min(F.when(F.col("line") > F.col("paragraph"), F.col("end"))).alias("after"))
    per = first.groupBy("candidate", "key", "paragraph").agg(F.collect_list(F.struct("gram", "whole", "after")).alias("g"))
    ends = F.array_compact(F.array_distinct(F.concat(F.col("g")["whole"], F.col("g")["after"])))
    joins = per.withColumn("end", F.explode(ends))
    until = lambda c: F.transform(F.filter("g", lambda x: x[c] <= F.col("end")), lambda x: x["gram"])
    return joins.select("candidate", "key", "paragraph", (F.col("end") - F.col("paragraph")).alias("joined"), until("whole").alias("short"), until("after").alias("others"), until("whole").alias("grams"))


def similarity(templates: Column, own: Column, others: Column) -> Column:
    """The largest share of a template's pairs found in ``own``, of those templates of which ``others`` alone holds fewer."""
    held = lambda t, c: F.size(F.array_intersect(t, c))
    share = F.array_max(F.transform(templates, lambda t: F.when(held(t, own) > held(t, others), held(t, own) / F.size(t)).otherwise(0.0)))
    return F.coalesce(share, F.lit(0.0))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, paragraph, family, probability, similarity, confirmed): a row for every line that begins a licence or speaks of one."""
    model = model or learn(docs, text)
    hits = _hits(docs, key, text, model)
    begun = stored(_begun(_stating(hits)))
    # What confirms no template with the lines after it is looked at alone.
    alone = hits.select("row", "key", F.explode(F.transform("spoken", lambda i: F.struct(i.alias("paragraph"), F.get("t", i).alias("own")))).alias("x")).select(F.struct("row", "x.paragraph").alias("candidate"), "key", "x.*")
    alone = alone.select("candidate", "key", "paragraph", F.lit(0).alias("joined"), "own", F.array().cast("array<string>").alias("rest"))
    found = _candidates(begun).unionByName(alone).select("*", F.explode(F.array(F.concat("own", "rest"))).alias("words"))
    found = found.select("candidate", "key", "paragraph", "joined", grams(F.col("words"), 1, 2).alias("short"), grams(F.col("rest"), 1, 2).alias("others"), grams(F.col("words")).alias("grams"))
    near = stored(_met(found, model))
    long = begun.filter(F.aggregate("after", F.lit(0), lambda n, x: n + F.size(x)) > joined_words()).select("candidate", "key", "paragraph")
    open_ones = stored(long.join(near.filter("sure").select("candidate"), "candidate", "left_anti"))
    met = near
    if not open_ones.isEmpty():
        met = near.unionByName(_met(_beyond(hits, open_ones, model.features.vocabulary), model).filter("sure"))
    # The shortest confirmed join; where there is none, the line alone.
    one = met.groupBy("candidate").agg(F.min(F.struct((~F.col("sure")).alias("open"), "joined", "key", "paragraph", "family", "probability", "similarity")).alias("x"))
    return one.select(F.col("x.key").alias(key), "x.paragraph", "x.family", "x.probability", "x.similarity", (~F.col("x.open")).alias("confirmed"))


def _met(found: DataFrame, model: Model) -> DataFrame:
    """(candidate, key, paragraph, joined, family, probability, similarity, sure): the joins that confirm a family, and the lines that speak of a licence."""
    best = model.rated(found).withColumn("probability", _best()).withColumn("speaks", 1 - F.element_at("p", -1) > model.reported)
    best = best.withColumn("guess", F.element_at(F.array(*map(F.lit, model.families)), F.array_position(F.slice("p", 1, len(NAMES)), F.col("probability")).cast("int")))
    # A row per family, so no more rows than families.
    templates = _templates(found.sparkSession).groupBy("family").agg(F.collect_list("pairs").alias("templates")).withColumnRenamed("family", "guess")
    met = best.join(F.broadcast(templates), "guess", "left").withColumn("similarity", similarity(F.col("templates"), F.col("short"), F.col("others")))
    met = met.withColumn("sure", (F.col("probability") >= model.least) & (F.col("similarity") >= CONFIRMED_SHARE))
    met = met.filter(F.col("sure") | (F.col("speaks") & (F.col("joined") == 0)))
    return met.select("candidate", "key", "paragraph", "joined", F.when(F.col("sure"), F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", "sure")


def with_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the sorted array of confirmed families of each row's id."""
    (licences,) = free(docs, "licences")
    per = scan(docs, key, text).filter("confirmed").groupBy(key).agg(F.array_sort(F.collect_set("family")).alias(licences)).withColumnRenamed(key, f"_{licences}_key")
    return docs.join(per, F.col(f"`{key}`") == F.col(f"_{licences}_key"), "left").drop(f"_{licences}_key")
