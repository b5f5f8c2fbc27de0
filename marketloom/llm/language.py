"""Language identification by prediction by partial matching.

For every language a tree of byte contexts of up to three bytes holds how often each byte followed.
A byte is coded in its longest known context, ``count / (n + d)`` with n bytes and d distinct ones seen
there; a byte new to a context costs an escape, ``d / (n + d)``, and is coded one byte shorter, down to
256 equal chances. The statistics are frozen after training, so the code length of a text is a sum over
its bytes, and the language with the shortest code is the prediction. Scores are the posterior under
equal priors.

Counting runs in tasks on a bounded sample, ``SAMPLE`` whole texts a language, those of the lowest hash.
The trees of all languages are merged into tables of code lengths, a column a language, so a byte costs
two table look-ups for all of them. Their size is bounded by the sample and by the bytes, not by the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0; a null language is not
learnt from; with nothing to learn from all texts are ``und``; equal code lengths go to the first
language by code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, slices, texts

SAMPLE = 400
ORDER = 3
PAD = b"\n" * ORDER
SLICE_BYTES = 1 << 18
UNKNOWN = "und"


def grams(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes that end at every byte of the texts, as numbers, and where each text begins; contexts before a text are line feeds."""
    data = np.frombuffer(PAD + PAD.join(run), dtype=np.uint8).astype(np.uint32)
    four = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    return four, np.cumsum([0] + [len(t) + ORDER for t in run])


def _own(length: int, starts: np.ndarray) -> np.ndarray:
    """False at the padding between texts."""
    own = np.ones(length, dtype=bool)
    for k in range(1, ORDER + 1):
        own[starts[1:-1] - k] = False
    return own


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(lang, gram, n) of the sampled texts."""
    order = F.xxhash64(F.lit(5), F.col(f"`{key}`"))
    known = docs.filter(F.col(f"`{lang}`").isNotNull() & ~held_out(F.col(f"`{key}`"))).select(F.col(f"`{lang}`").alias("lang"), order.alias("o"), F.col(f"`{text}`").alias("text"))
    # The hash of the last sampled row of every language; texts are not read for it.
    rank = Window.partitionBy("lang").orderBy("o")
    last = known.select("lang", "o").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= sample).groupBy("lang").agg(F.max("o").alias("last"))
    # A row per language, as in the model itself; without the hint every text would be shuffled by its language.
    chosen = known.join(F.broadcast(last), "lang").filter("o <= last and text is not null").select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            held: dict[str, list[bytes]] = {}
            for name, own in zip(langs, texts(batch.column(1)), strict=True):
                held.setdefault(name, []).append(own)
            for name, own in held.items():
                for _, run in slices(own, SLICE_BYTES):
                    four, starts = grams(run)
                    found, n = np.unique(four[_own(len(four), starts)], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Code lengths in bits of the bytes in their contexts, for all languages at once."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs = langs
        width = len(langs)
        per = [(gram[lang == i].astype(np.int64), n[lang == i].astype(np.int64)) for i in range(width)]
        self.four = np.unique(gram.astype(np.int64))
        self.three = np.unique(np.concatenate((self.four & 0xFFFFFF, self.four >> 8)))
        self.bits4 = np.zeros((len(self.four) + 1, width), dtype=np.float32)
        self.escape3 = np.zeros((len(self.three) + 1, width), dtype=np.float32)
        self.bits3 = np.zeros((len(self.three) + 1, width), dtype=np.float32)
        self.escape2 = np.zeros((1 << 16, width), dtype=np.float32)
        self.bits2 = np.zeros((1 << 16, width), dtype=np.float32)
        for i, (grams_, counts_) in enumerate(per):
            bits = np.full(1, 8.0)  # 256 equal chances, in the context of none
            for order in range(ORDER + 1):
                # Rows of the order above are extended by a byte in front; ``bits`` holds the code length of every suffix asked for.
                seen, at = np.unique(grams_ & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                c = np.bincount(at, counts_, len(seen))
                context, back = np.unique(seen >> 8, return_inverse=True)
                total, kinds = np.bincount(back, c, len(context)), np.bincount(back, minlength=len(context))
                escape = -np.log2(kinds / (total + kinds))
                own = -np.log2(c / (total[back] + kinds[back]))
                if order == 0:
                    zero = np.full(256, escape[0] + bits[0])
                    zero[seen] = own
                elif order == 1:
                    lost = np.zeros(256)
                    lost[context] = escape
                    one = np.repeat(lost, 256) + np.tile(zero, 256)
                    one[seen] = own
                    self.bits2[:, i] = one
                elif order == 2:
                    self.escape2[context, i] = escape
                    self.bits3[1:, i] = self.escape2[self.three >> 8, i] + one[self.three & 0xFFFF]
                    self.bits3[1 + np.searchsorted(self.three, seen), i] = own
                else:
                    self.escape3[1 + np.searchsorted(self.three, context), i] = escape
                    suffix = 1 + np.searchsorted(self.three, self.four & 0xFFFFFF)
                    self.bits4[1:, i] = self.escape3[1 + np.searchsorted(self.three, self.four >> 8), i] + self.bits3[suffix, i]
                    self.bits4[1 + np.searchsorted(self.four, seen), i] = own

    def opened(self) -> Trees:
        """With the direct tables that find a context, built where they are used."""
        if not hasattr(self, "find3"):
            self.find3 = np.zeros(1 << 24, dtype=np.int32)
            self.find3[self.three] = np.arange(1, len(self.three) + 1)
            self.find4 = np.zeros((len(self.three) + 1) * 256, dtype=np.int32)
            self.find4[self.find3[self.four >> 8].astype(np.int64) * 256 + (self.four & 0xFF)] = np.arange(1, len(self.four) + 1)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("find")}

    def lengths(self, run: list[bytes]) -> np.ndarray:
        """Code length in bits of every text under every language."""
        four, starts = grams(run)
        if not len(four):
            return np.zeros((len(run), len(self.langs)))
        three = self.find3[four & 0xFFFFFF]
        context = self.find3[four >> 8]
        whole = self.find4[context.astype(np.int64) * 256 + (four & 0xFF)]
        bits = self.bits4[whole]
        miss = np.flatnonzero(whole == 0)
        if len(miss):
            shorter = self.bits3[three[miss]]
            new = np.flatnonzero(three[miss] == 0)
            two = four[miss[new]]
            shorter[new] = self.escape2[(two >> 8) & 0xFFFF] + self.bits2[two & 0xFFFF]
            bits[miss] = self.escape3[context[miss]] + shorter
        bits[~_own(len(bits), starts)] = 0
        sums = np.zeros((len(run), len(self.langs)))
        filled = np.flatnonzero([len(t) > 0 for t in run])
        if len(filled):
            # A text's bytes reach to the next text that has any; between them stands only padding.
            sums[filled] = np.add.reduceat(bits, starts[:-1][filled], axis=0, dtype=np.float64)
        return sums


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Trees | None:
    rows = counts(docs, text, lang, key, sample).toPandas()
    if not len(rows):
        return None
    langs = sorted(rows["lang"].unique())
    place = {name: i for i, name in enumerate(langs)}
    return Trees(langs, rows["gram"].to_numpy(), rows["lang"].map(place).to_numpy(), rows["n"].to_numpy())


def predict(text: Column, trees: Trees | None) -> Column:
    """struct(lang_pred, score) of a text column."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if trees is None:
        return none

    def predicted(array: pa.Array) -> pa.Array:
        model, langs, scores = trees.opened(), [], []
        for _, run in slices(texts(array), SLICE_BYTES):
            bits = model.lengths(run)
            best = bits.argmin(axis=1)
            more = bits - bits[np.arange(len(best)), best][:, None]
            langs += [model.langs[i] for i in best]
            scores.append(1.0 / np.exp2(-np.minimum(more, 1000)).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=kind.names)

    found = F.arrow_udf(predicted, kind).asNondeterministic()(text)
    return F.when(F.coalesce(text.rlike("\\p{L}"), F.lit(False)), found).otherwise(none)
