"""A small table with everything that may be odd about documents."""

import random

from pyspark.sql import types as T

#: Names that the operators use for their own columns.
CLASHING = ["kept", "shard", "slot", "row", "m", "size", "taken", "nth", "mark", "hits", "act", "bucket"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(words))


def rows():
    base = prose(1, 300)
    out = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (None, base, "en", "a"), (4, base, "en", None), (5, base, "en", "b"), (5, base, "en", "b"),
        (6, prose(2, 60_000), "de", "b"), (7, base.replace("a", "A", 1), "en", "a"), (8, base + " " + prose(3, 5), "en", "a"), (9, "one two", "en", "c"), (10, "ONE two", "en", "c"), (11, "é" * 700, "fr", "c"),
        (12, "x" * 900, None, "a"), (13, "123 456 !!", "en", "a"), (14, prose(4, 12) + "\n" + prose(4, 12) + "\n\n", "en", "a"), (None, None, None, None), (None, None, None, None),
    ]
    return [(i, t, lang, source, len(t) if t else None, *("z" for _ in CLASHING)) for i, t, lang, source in out]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
