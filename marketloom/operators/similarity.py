"""Exact similarity join on strings: every pair whose match ratio reaches its threshold.

The ratio is 2*M/T with M the characters in matching blocks and T both lengths together. At a threshold close to what
unlike texts of one language reach, nearly all pairs share something rare, so pairs are not built and moved: the texts of
a block are dealt into strips, and every two strips meet in one task that holds no more than their texts, a tile of the
bounds and the pairs that pass. What is moved is each text once a strip, whatever is alike; nothing is capped. A pair is
scored only where it passes bounds that follow from the ratio:

* M is at most the letters that both have, and the shorter length;
* D = T-2*M characters stay unmatched, so there are at most D+1 blocks, and ratio t promises M-(D+1) = (1.5*t-1)*T-1
  bigrams that both have;
* matching blocks are in order in both texts, so M is at most the longest common subsequence.

Letters and bigrams are counted for a tile at once, as products of 0/1 rows with a column for every occurrence of a gram;
both go to ``BUCKETS`` numbers first, by which a pair can only share more, and what a row holds beyond ``OCCURRENCES`` of
one counts as shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread

_SLACK = 1e-9
#: Strips of a block: of ``STRIP_ROWS`` rows up to ``STRIPS`` of them, then larger ones up to ``MOST_ROWS`` rows or ``MOST_CHARACTERS``.
STRIP_ROWS, STRIPS, MOST_ROWS, MOST_CHARACTERS = 2048, 24, 65536, 16 << 20
#: Rows of a side that are compared at a time, and pairs that are looked at together.
TILE, PAIRS = 1024, 1 << 16
BUCKETS, OCCURRENCES = 256, 64


@F.pandas_udf(T.DoubleType())
def match_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None
                      for a, b in zip(left, right)], dtype="float64")


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for every character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _occurrences(rows: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which occurrence of its gram in its row an element is, from 0."""
    order = np.lexsort((grams, rows))
    r, g, place = rows[order], grams[order], np.arange(len(rows))
    new = np.ones(len(rows), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    out = np.empty(len(rows), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


class Grams:
    """Multisets of grams by row, as 0/1 rows with a column for every occurrence of a gram."""

    def __init__(self, rows: np.ndarray, grams: np.ndarray, texts: int):
        nth = _occurrences(rows, grams)
        held = nth < OCCURRENCES
        self.rows, columns = rows[held], (grams * OCCURRENCES + nth)[held]
        self.ends, self.extra = np.searchsorted(self.rows, np.arange(texts + 1)), np.bincount(rows[~held], minlength=texts)
        kinds, self.columns = np.unique(columns, return_inverse=True)
        self.width = len(kinds)

    def marks(self, start: int, stop: int) -> np.ndarray:
        out, part = np.zeros((stop - start, self.width), np.float32), slice(self.ends[start], self.ends[stop])
        out[self.rows[part] - start, self.columns[part]] = 1
        return out

    def shared(self, one: tuple[int, int], other: tuple[int, int]) -> np.ndarray:
        """For every pair of two tiles the grams that both have, or more."""
        return self.marks(*one) @ self.marks(*other).T + np.minimum(self.extra[one[0]:one[1], None], self.extra[None, other[0]:other[1]])


class Strip:
    """Texts of both strips of a cell, one after the other, as rows of letters and bigrams."""

    def __init__(self, texts: list[str]):
        self.texts, self.size = texts, np.array([len(t) for t in texts], np.int64)
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), self.size)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        _, letters = np.unique(letters, return_inverse=True)
        self.rows, self.letters, self.alphabet = rows, letters, int(letters.max(initial=0)) + 1
        pair = rows[1:] == rows[:-1]
        bigrams = (letters[:-1] * 31 + letters[1:])[pair] % BUCKETS
        self.letter_sets, self.bigram_sets = Grams(rows, letters % BUCKETS, len(texts)), Grams(rows[1:][pair], bigrams, len(texts))

    def masks(self, start: int, stop: int) -> np.ndarray:
        """A bit for every place of a letter, by row and letter, in the rows of up to 64 letters; the last letter is none."""
        out, part = np.zeros((stop - start, self.alphabet + 1), np.uint64), slice(self.ends[start], self.ends[stop])
        rows = self.rows[part]
        at, held = np.arange(self.ends[start], self.ends[stop]) - self.ends[rows], self.size[rows] <= 64
        np.bitwise_or.at(out, (rows[held] - start, self.letters[part][held]), np.uint64(1) << at[held].astype(np.uint64))
        return out

    def padded(self, start: int, stop: int) -> np.ndarray:
        """Letters by row and place, rows of over 128 letters cut; the letter after the last one fills up."""
        out, part = np.full((stop - start, int(min(128, self.size[start:stop].max(initial=0)))), self.alphabet), slice(self.ends[start], self.ends[stop])
        rows = self.rows[part]
        at = np.arange(self.ends[start], self.ends[stop]) - self.ends[rows]
        held = at < out.shape[1]
        out[rows[held] - start, at[held]] = self.letters[part][held]
        return out

    def pairs(self, one: tuple[int, int], other: tuple[int, int], t: float) -> Iterator[tuple[int, int]]:
        """Pairs of two tiles that may reach the ratio ``t``."""
        sizes = self.size[one[0]:one[1], None], self.size[None, other[0]:other[1]]
        total = sizes[0] + sizes[1]
        ok = (np.minimum(*sizes) >= t / 2 * total - 1e-6) & (total > 0)
        if one == other:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        for grams, need in ((self.letter_sets, t / 2 * total), (self.bigram_sets, (1.5 * t - 1) * total - 1)):
            if ok.any():
                ok &= grams.shared(one, other) >= need - 1e-6
        a, b = np.nonzero(ok)
        if len(a):
            masks, letters = self.masks(*one), self.padded(*other)
        for start in range(0, len(a), PAIRS):
            x, y = a[start:start + PAIRS], b[start:start + PAIRS]
            v = np.full(len(x), ~np.uint64(0))
            for place in range(letters.shape[1]):
                u = v & masks[x, letters[y, place]]
                v = (v + u) | (v - u)
            size = self.size[one[0] + x]
            inside = np.where(size < 64, (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            common = size - np.bitwise_count(v & inside)
            long = (size > 64) | (self.size[other[0] + y] > 128)
            need = t / 2 * (size + self.size[other[0] + y]) - 1e-6
            for i in np.nonzero(long | (common >= need))[0]:
                p, q = int(one[0] + x[i]), int(other[0] + y[i])
                if not long[i] or longest_common(self.texts[p], self.texts[q]) >= need[i]:
                    yield p, q


def _cell(rows: pa.Table, threshold: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Scored pairs between two strips, or within one, of a block."""
    rows = rows.sort_by("strip")
    strips, items, texts = (rows[c].to_pylist() for c in ("strip", "item", "text"))
    first, both = strips.count(strips[0]), rows["i"][0].as_py() != rows["j"][0].as_py()
    strip = Strip(texts) if not both or first < len(texts) else None
    tiles = lambda a, b: [(s, min(s + TILE, b)) for s in range(a, b, TILE)]
    left = tiles(0, first) if strip else []
    met = ((x, y) for x in left for y in (tiles(first, len(texts)) if both else [z for z in left if z >= x]))
    out, block = [], {f.name: rows[f.name][0].as_py() for f in schema if f.name in rows.column_names}
    for x, y in met:
        for p, q in strip.pairs(x, y, threshold - _SLACK):
            (a, s), (b, u) = sorted([(items[p], texts[p]), (items[q], texts[q])])
            ratio = SequenceMatcher(None, s, u).ratio()
            if ratio >= threshold:
                out.append({**block, "left_item": a, "right_item": b, "left_text": s, "right_text": u, "ratio": ratio})
        if len(out) >= 10000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def similar_pairs(items: DataFrame, item: str, text: str, threshold: float, block: list[str]) -> DataFrame:
    """Scored pairs (block, left_item, right_item, left_text, right_text, ratio) of distinct items in one block with ratio at or above ``threshold``.

    ``items`` has one row per distinct text and block, so copies of one text meet nobody here.
    """
    base = items.select(*block, F.col(item).alias("item"), F.col(text).alias("text")).filter(F.length("text") > 0)
    needed = F.greatest(F.least(F.ceil(F.col("n") / STRIP_ROWS), F.lit(STRIPS)), F.ceil(F.col("n") / MOST_ROWS), F.ceil(F.col("characters") / MOST_CHARACTERS)).cast("int")
    sizes = base.groupBy(*block).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters")).select(*block, needed.alias("strips"))
    dealt = base.join(sizes, block) if block else base.crossJoin(F.broadcast(sizes))
    dealt = dealt.withColumn("strip", F.pmod(F.xxhash64("item"), F.col("strips")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    cells = dealt.select(*block, F.least("strip", "other").alias("i"), F.greatest("strip", "other").alias("j"), "strip", "item", "text")
    fields = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType([T.StructField(n, fields[n]) for n in block] + [T.StructField(f"{s}_{c}", fields[c]) for c in ("item", "text") for s in ("left", "right")] + [T.StructField("ratio", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    keys = [*block, "i", "j"]

    def compare(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_cell(rows, threshold, arrow), arrow)

    return spread(cells, *keys).groupBy(*keys).applyInArrow(compare, schema)
