"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

A text's tokens are runs of letters and digits and runs of other signs. Its features are the hashes of
tokens and of pairs of neighbouring tokens, by how often they occur, scaled to unit length. Training
takes a bounded sample of the labelled documents, ``SAMPLE`` rows of the lowest hash of their id, and
makes ``EPOCHS`` passes of the follow-the-regularised-leader update; its L1 term keeps most weights at
zero. Scoring is a sparse dot product over the whole text, without a shuffle. The weights are one float
per bucket (``2 ** BITS``), whatever the corpus.

Only rows whose ``held_out`` is false are learnt from; language, source and id are no features.
Defined results: a null text is empty and its score is that of the bias alone; labels with a null id or
value are not used; an id labelled twice is learnt with each distinct label; without labels the score is 0.5.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, texts

BITS = 18
SAMPLE = 3000
EPOCHS = 6
#: Chosen by log loss on a fifth of the labelled rows that may be learnt from, at sf0.1; held-out rows were not read for it.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.01, 0.01
CUTOFF = 0.3
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their values; the first is bucket 0, the bias, which no token takes."""
    words = _TOKEN.findall(text or b"")
    if not words:
        return np.zeros(1, dtype=np.int64), np.ones(1)
    one = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((one * np.uint64(0x9E3779B97F4A7C15), two)) >> np.uint64(64 - BITS)
    buckets, counts = np.unique(np.maximum(both, 1).astype(np.int64), return_counts=True)
    values = counts / np.sqrt(np.square(counts, dtype=float).sum())
    return np.concatenate(([0], buckets)), np.concatenate(([1.0], values))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights after ``epochs`` passes over (buckets, values, label), in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(at) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(own) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for buckets, values, label in examples:
            w = weight(buckets)
            g = (1.0 / (1.0 + np.exp(-np.clip((w * values).sum(), -35, 35))) - label) * values
            before = np.sqrt(n[buckets])
            n[buckets] += g * g
            z[buckets] += g - (np.sqrt(n[buckets]) - before) / alpha * w
    return weight(slice(None)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` labelled rows that are not held out; tasks send hashed features, not texts."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("label")).distinct()
    order = F.xxhash64(F.lit(11), key, "label")
    chosen = known.orderBy(order, key, "label").limit(sample)
    kind = T.StructType([T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def hashed(array: pa.Array) -> pa.Array:
        found = [features(t) for t in texts(array)]
        return pa.StructArray.from_arrays([pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["b", "v"])

    own = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    rows = own.join(chosen, key).select(order.alias("o"), "label", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), F.arrow_udf(hashed, kind)("text").alias("f")).select("o", "label", "c", "f.b", "f.v").toPandas()
    rows = rows.sort_values(["o", "label", "c"], kind="stable")
    examples = [(np.asarray(b, dtype=np.int64), np.asarray(v), int(y)) for b, v, y in zip(rows["b"], rows["v"], rows["label"], strict=True)]
    return train(examples) if examples else np.zeros(1 << BITS, dtype=np.float32)


def score(text: Column, weights: np.ndarray) -> Column:
    """The probability of label 1 for a text column."""
    # Most weights are zero: only the others travel with the tasks, at most 2 ** BITS of them.
    at = np.flatnonzero(weights)
    kept = weights[at]

    def scored(array: pa.Array) -> pa.Array:
        dense = np.zeros(1 << BITS)
        dense[at] = kept
        margins = np.array([(dense[b] * v).sum() for b, v in map(features, texts(array))])
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(margins, -35, 35))), pa.float64())

    return F.arrow_udf(scored, T.DoubleType())(text)
