"""Aligned tokens against whole texts encoded at once and a plain walk over their bytes."""

import hashlib
import random
from collections import Counter

import odd
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marketloom.llm import alignment as A
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF

PAIR = A.Pair(*(f"{A.FOLDER}/{f}" for f in A.FILES))
#: The first tokenizer as its own library reads it.
OWN = Tokenizer.from_file(f"{A.FOLDER}/{A.FILES[0]}")
OWN.encode_special_tokens = True


def plain_one(text):
    """(n_a, n_b, groups, links) of a whole text."""
    if not text:
        return 0, 0, [], []
    a, b = OWN.encode(f" {text}", add_special_tokens=False).ids, PAIR.b.encode(text)
    raw = f" {text}".encode()
    if b"".join(PAIR.a_bytes[i] for i in a) != raw or b"".join(PAIR.b_bytes[i] for i in b) != raw:
        return 0, 0, [], []
    spans = []
    for ids, sizes in ((a, PAIR.a_bytes), (b, PAIR.b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(sizes[i]), i))
            at += len(sizes[i])
        spans.append(own)
    links, j = [], 0
    for s, e, x in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((x, spans[1][k][2]))
            k += 1
    groups, ends = [], {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
    start = 0
    for end in sorted(ends):
        groups.append("|".join(",".join(str(x) for s, e, x in own if start <= s and e <= end) for own in spans)) if len(raw) < 3000 else None
        start = end
    if len(raw) >= 3000:
        sides = []
        for own in spans:
            parts, held = [], []
            for _, e, x in own:
                held.append(str(x))
                if e in ends:
                    parts.append(",".join(held))
                    held = []
            sides.append(parts)
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
    return len(a), len(b), groups, links


def plain(rows):
    one = [(key, plain_one(text)) for key, text in rows]
    count = Counter(x for _, (_, _, _, links) in one for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted([(key, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for key, (n_a, n_b, groups, links) in one], key=str)


def got(df, **more):
    return sorted((tuple(r) for r in A.aligned(df, **more).select("doc_id", *A.NUMBERS, "groups_sha256").collect()), key=str)


TRICKY = ["", " ", "  ", "a ", "a  ", " a", "  a  b \n c", "x  y   z ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁under ▁", "café 你好 \U0001f600\U0001f468‍\U0001f469", "tab\tand\r\nline \x85   x", "\u0000 nul", "it's we'll 12345 6.7", "ﬁ ① é ̈", "a\n b\n  c\n\n\n d", "\x1c \x1d x \x1f y"]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, None), (7, None), (None, "same text"), (None, "same text"), (3, "same text")]
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "doc_id long, text string, row string, chunk string, n_a string")
    assert got(df) == plain(rows)


@pytest.mark.parametrize("longest", [1, 40])
def test_long_texts_in_ranges(spark, longest):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100, odd.prose(1, 400)), (101, odd.prose(1, 400)), (101, odd.prose(1, 400)), (None, "x" * 500 + " y"), (102, odd.prose(3, 60) + " ")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), longest=longest) == plain(rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert A.aligned(docs.limit(0)).count() == 0


def test_wide_rows_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    """Units have megabytes a row: neither what the writer holds nor a batch of the reader may be all units of a task."""
    tables, stored = {}, A.stored

    def seen(df, *more, **named):
        out = stored(df, *more, **named)
        tables[tuple(df.columns)] = (out, named.get("wide"), int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
        return out

    monkeypatch.setattr(A, "stored", seen)
    words = odd.prose(1, 40)
    docs = spark.range(900).coalesce(1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('{words} ', {40_000 // (len(words) + 1)})").alias("text"))
    n_a, n_b, groups, links = plain_one(docs.first().text)
    found = got(docs)
    assert [(r[0], *r[1:5]) for r in found] == sorted(((i, n_a, n_b, len(groups), len(links)) for i in range(900)), key=str)
    (units,) = [x for columns, x in tables.items() if "seg_pair" in columns]
    assert units[0].count() >= 8 and units[1]
    assert [n for columns, (_, _, n) in tables.items() if "n_best" in columns] == [A.UNIT_BATCH]
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    draw = random.Random(1)
    (file,) = stored(spark.createDataFrame([(draw.randbytes(1 << 20),) for _ in range(40)], "x binary").coalesce(1), wide=True).inputFiles()
    read = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert max(read.row_group(k).total_byte_size for k in range(read.num_row_groups)) <= 20 << 20


def test_keys_of_any_type(spark):
    rows = [(["a", None], "one two"), (None, "one"), (["b"], "x" * 100)]
    found = A.aligned(spark.createDataFrame(rows, "doc_id array<string>, text string"), longest=50).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(k) for k, _ in rows)


def test_a_range_that_does_not_give_back_its_bytes_empties_its_text():
    pair = A.Pair(*(f"{A.FOLDER}/{f}" for f in A.FILES))
    whole = A.Aligned(pair, ["good", "text"])
    pair.b_bytes[pair.b.encode("good")[0]] = b"?"
    some = A.Aligned(pair, ["good", "text"])
    assert whole.good.tolist() == [True, True] and some.good.tolist() == [False, True]
    assert some.n_links.tolist()[0] == 0 and some.n_links.tolist()[1] == whole.n_links.tolist()[1] and some.groups[1] == whole.groups[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.booleans()), max_size=14), st.integers(0, 2**32))
def test_fragments_compose_in_any_order(steps, seed):
    """Every way to put the pieces of a token run together gives its groups."""
    pieces, groups, held = [], [], ([], [])
    for n, (a, b, end) in enumerate([*steps, (1, 1, True)]):
        a, b = [f"{n}{i}" for i in range(a)], [f"{n}{i}" for i in range(b)]
        end = end and (held[0] + a) and (held[1] + b)
        held[0].extend(a)
        held[1].extend(b)
        head = (",".join(a), ",".join(b))
        pieces.append(A.Fragment(head, cut=True) if end else A.Fragment(head))
        if end:
            groups.append("|".join(",".join(x) for x in held))
            held = ([], [])
    draw = random.Random(seed)
    while len(pieces) > 1:
        i = draw.randrange(len(pieces) - 1)
        pieces[i:i + 2] = [pieces[i].then(pieces[i + 1])]
    assert pieces[0].groups() == ";".join(groups)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n .'1é你\t\U0001f600s"), max_size=40))
def test_cutting_changes_no_tokens(text):
    a, b = PAIR.encoded(A.segments(text)) if text else ([], [])
    assert [i for x in a for i in x] == (OWN.encode(f" {text}", add_special_tokens=False).ids if text else [])
    assert [i for x in b for i in x] == (PAIR.b.encode(text) if text else [])
