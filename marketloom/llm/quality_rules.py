"""Quality rules whose cutoffs come with a bound on good documents lost.

Fixed rules fail a document with too few words or too many repeated ones. Beyond them, each of
``RULES`` is a share of a text; cutoffs for them are chosen per stratum (by default the language) from a
fixed grid. All labelled documents that pass the fixed rules are the holdout: what is tested comes from no
data, so none of it is used up. A setting is a cutoff, or none, for every rule; the labelled good documents
that it rejects by any rule are counted, and an exact (Clopper-Pearson) upper bound on the chance to lose a
good document is drawn from the count.

Settings are tested in chains fixed beforehand: each tightens one rule step by step through the grid, then the
next rule, starting with another rule in each chain, and a chain ends at the first setting whose bound is above
``loss``. In such a fixed order a chain needs no correction for its length, only for the number of chains and
strata. ``ALONE`` of the error goes to a second proof, for strata with many labels: each rule is tightened by
itself while its own bound is within its part of ``loss``, and what the rules reach is one more setting. So with
probability 1 - ``delta`` no tested setting of any stratum that passed loses more than ``loss`` of its good
documents, and any of them may be taken: the one that rejects most labelled bad documents, of those the one that
loses fewest good ones, then the strictest. Where the labels are too few to prove any (with four strata about 300
good ones are needed), no cutoff is set; ``cutoffs`` says so with a row of its own.

Defined results: a null text counts as empty and fails the fixed rules; a null stratum is a stratum of
its own; unlabelled strata have no cutoffs; labels with a null id or a null or unknown value are not
used and an id labelled twice counts each good label once; empty tables give no rows or no cutoffs;
texts of any length are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, stored, texts

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
#: Share of good documents that may be lost per stratum, and the chance that any bound fails.
LOSS = 0.02
DELTA = 0.05
#: Of the error chance, the part for rules proven one by one.
ALONE = 0.25
RULES = ("symbols", "lines", "repeats", "capitals")
GRID = tuple(round(0.01 * 1.25 ** i, 6) for i in range(21))

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")])
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")
_TO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows are named by exact pairing, so no two different ones are taken as equal."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    name = ids.astype(np.int64)
    for k in range(1, window):
        # name[i] stands for words i..i+k-1 and is extended by one word, then numbered anew.
        name = name[:-1] * len(ids) + ids[k:]
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        fresh = np.empty(len(name), dtype=np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        name = fresh
        if fresh.max() == len(fresh) - 1:  # all differ, and so will all that are longer
            return 0
    twice = (np.bincount(name) > 1)[name]
    ends = np.zeros(len(ids) + 1, dtype=np.int64)
    ends[:n] += twice
    ends[window:window + n] -= twice
    return int((np.cumsum(ends[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals of a text."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, b"#*$%&|<>")), 0, 0, 0, 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    run = b"".join(words)
    chars = len(run) if run.isascii() else int(((np.frombuffer(run, dtype=np.uint8) & 0xC0) != 0x80).sum())
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    repeats = repeated_words(ids) if len(names) < len(ids) else 0
    return len(words), chars, len(text) - len(text.translate(None, b"#*$%&|<>")), again, repeats, lines, len(run.translate(None, _TO_CAPITALS))


def _measures(array: pa.Array) -> pa.Array:
    columns = list(zip(*(measure(t) for t in texts(array)), strict=True)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES.names)


def measures(text: Column) -> Column:
    """The struct of ``MEASURES`` of a text column; computed once wherever it is used."""
    return F.arrow_udf(_measures, MEASURES).asNondeterministic()(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def scores(m: Column) -> dict[str, Column]:
    """What the rules look at, each a share of the text."""
    share = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(0.0)
    return {"symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}


def loss_bound(lost: int, good: int, error: float) -> float:
    """Exact upper bound on a rate at the given error, from ``lost`` of ``good``: the p at which so few would have that chance."""
    if lost >= good:
        return 1.0
    k = np.arange(lost + 1)
    ways = np.array([math.lgamma(good + 1) - math.lgamma(i + 1) - math.lgamma(good - i + 1) for i in k])
    low, high = lost / good, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = ways + k * math.log(p) + (good - k) * math.log1p(-p) if 0 < p < 1 else np.array([-np.inf])
        if np.exp(terms).sum() > error:
            low = p
        else:
            high = p
    return high


def _chains() -> list[list[tuple[int, ...]]]:
    """The settings of every chain in order, loosest first: for each rule the grid point, or len(GRID) for no cutoff."""
    out = []
    for first in range(len(RULES)):
        setting, chain = [len(GRID)] * len(RULES), []
        for k in range(len(RULES)):
            for point in reversed(range(len(GRID))):
                setting[(first + k) % len(RULES)] = point
                chain.append(tuple(setting))
        out.append(chain)
    return out


def _chosen(rows: pd.DataFrame, error: float, loss: float) -> pd.DataFrame:
    """The proven setting of one stratum, a row for every rule; rows are (a step for every rule, good, bad), step the number of grid points below the score."""
    steps, good, bad = rows[list(RULES)].to_numpy(), rows["good"].to_numpy(), rows["bad"].to_numpy()
    labelled = int(good.sum())
    known: dict[tuple[int, float], float] = {}

    def counted(setting: tuple[int, ...]) -> tuple[int, int]:
        above = (steps > np.array(setting)).any(axis=1)
        return int(good[above].sum()), int(bad[above].sum())

    def bound(lost: int, chance: float) -> float:
        if (lost, chance) not in known:
            known[lost, chance] = loss_bound(lost, labelled, chance)
        return known[lost, chance]

    off = len(GRID)
    proven = []  # (setting, bound)
    chance = (1 - ALONE) * error / len(RULES)
    for chain in _chains():
        for setting in chain:
            if (least := bound(counted(setting)[0], chance)) > loss:
                break
            proven.append((setting, least))
    alone, chance, total = [off] * len(RULES), ALONE * error / len(RULES), 0.0
    for k in range(len(RULES)):
        reached = 0.0
        for point in reversed(range(off)):
            own = tuple(point if j == k else off for j in range(len(RULES)))
            if (least := bound(counted(own)[0], chance)) > loss / len(RULES):
                break
            alone[k], reached = point, least
        total += reached
    if min(alone) < off:
        proven.append((tuple(alone), total))

    def worth(one):
        lost, caught = counted(one[0])
        return caught, -lost, -sum(one[0])

    setting, least = max(proven, key=worth, default=((off,) * len(RULES), None))
    lost, caught = counted(setting)
    out = []
    for k, (rule, point) in enumerate(zip(RULES, setting, strict=True)):
        own = int(good[steps[:, k] > point].sum())
        out.append((rows["stratum"].iloc[0], rule, GRID[point] if point < off else None, labelled, own, lost, caught, least))
    return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "good", "lost", "all_lost", "all_caught", "bound"]).astype({"cutoff": float, "bound": float})


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality", loss: float = LOSS, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, good, lost, all_lost, all_caught, bound) from ``measured`` (key, stratum, m) and ``labels`` (key, label).

    A row for every rule and stratum with labels; ``cutoff`` is null where none was proven. ``lost`` are the good rows the rule
    itself rejects; ``all_lost`` and ``all_caught`` the good and bad ones that all rules of the stratum do, ``bound`` what was proven of the former.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, (F.col(label) == 1).alias("is_good"))
    met = measured.filter(~base_failed(F.col("m"))).join(marked, key)
    steps = [sum(((score > c).cast("int") for c in GRID), F.lit(0)).alias(rule) for rule, score in scores(F.col("m")).items()]
    placed = met.select(F.col(stratum).alias("stratum"), "is_good", *steps)
    counted = stored(placed.groupBy("stratum", *RULES).agg(F.sum(F.col("is_good").cast("long")).alias("good"), F.sum((~F.col("is_good")).cast("long")).alias("bad")))
    strata = max(1, counted.filter("good > 0").select("stratum").distinct().count())
    error = delta / strata
    kind = measured.schema[stratum].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("good", "lost", "all_lost", "all_caught")]
    schema = T.StructType([T.StructField("stratum", kind), T.StructField("rule", T.StringType()), T.StructField("cutoff", T.DoubleType()), *longs, T.StructField("bound", T.DoubleType())])
    return counted.groupBy("stratum").applyInPandas(lambda rows: _chosen(rows, error, loss), schema)


def judged(measured: DataFrame, limits: DataFrame, stratum: str, m: str = "m") -> DataFrame:
    """``measured`` with ``kept``: the fixed rules and no score above its stratum's cutoff. A join on a table of a row per stratum."""
    kept, name, own = free(measured, "kept", "stratum", "cutoffs")
    # A null stratum is matched by a text that no stratum equals.
    mark = lambda c: F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c.cast("string"), F.lit("")))
    per = limits.groupBy(mark(F.col("stratum")).alias(name)).agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{own}_{r}") for r in RULES))
    met = measured.withColumn(name, mark(F.col(f"`{stratum}`"))).join(per, name, "left")
    above = [F.coalesce(s > F.col(f"{own}_{r}"), F.lit(False)) for r, s in scores(F.col(m)).items()]
    verdict = ~base_failed(F.col(m))
    for one in above:
        verdict = verdict & ~one
    return met.withColumn(kept, verdict).drop(name, *(f"{own}_{r}" for r in RULES))


def measured_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, m) of every row, written once; texts are read once and not moved."""
    return stored(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{stratum}`").alias(stratum), measures(F.col(f"`{text}`")).alias("m")))


def rejected_removed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``docs`` without the rejected rows. Cutoffs come from all rows; a second pass over the texts applies them, so no text is moved."""
    limits = stored(cutoffs(measured_documents(docs, key, text, stratum), labels, stratum, key))
    (m,) = free(docs, "m")
    judged_ = judged(docs.withColumn(m, measures(F.col(f"`{text}`"))), limits, stratum, m)
    (kept,) = free(docs.withColumn(m, F.lit(0)), "kept")
    return judged_.filter(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
