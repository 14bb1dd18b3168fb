"""Benchmark passages in documents, against plain comparisons of word lists."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.llm import contamination as C
from rollcall.llm import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain(docs, items, window=10):
    """(words, hit words, items) of each document."""
    wanted = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[p : p + n]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for t in docs:
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wanted:
                    hit |= set(range(p, p + n))
                    names |= wanted[k]
        out.append((len(w), hit, names))
    return out


def spelled(first, end):
    return {p for a, b in zip(first.tolist(), end.tolist(), strict=True) for p in range(a, b)}


WORDS = st.lists(st.sampled_from(["a", "b", "C", "é9", "longerword", "x1"]), max_size=25)


@settings(max_examples=200, deadline=None)
@given(docs=st.lists(WORDS, min_size=1, max_size=5), items=st.lists(WORDS, max_size=5), window=st.integers(1, 5), data=st.data())
def test_hits_equal_plain_comparison(docs, items, window, data):
    docs = [" ".join(x) for x in docs]
    if items and data.draw(st.booleans()):
        docs.append(" ".join(items[0]) + "! " + docs[0])
    items = [(k % 3, " ".join(x)) for k, x in enumerate(items)]
    suite = C.Suite([(str(i), t.encode()) for i, t in items], window)
    for got, want in zip(suite.hits([d.encode() for d in docs]), plain(docs, items, window), strict=True):
        assert got[0] == want[0] and spelled(got[1], got[2]) == want[1]
        assert {suite.ids[k] for k in got[3].tolist()} == want[2]
    for d, want in zip(docs, plain(docs, items, window), strict=True):  # the same text in small pieces
        got = C.joined([(at, suite.hits([p])[0]) for at, p in C.pieces(d.encode(), 12, window)])
        assert got[0] == want[0] and spelled(got[1], got[2]) == want[1]


@settings(max_examples=150, deadline=None)
@given(docs=st.lists(WORDS, min_size=1, max_size=4), items=st.lists(WORDS, min_size=1, max_size=4), window=st.integers(1, 4))
def test_longest_matches_equal_plain_comparison(docs, items, window):
    suite = C.Suite([(str(k), " ".join(x).encode()) for k, x in enumerate(items)], window)
    ids = np.array([7 * k % 5 for k in range(len(docs))], np.int64)
    got = {(suite.ids[i], p): (n, d, a) for i, p, n, d, a in zip(*(x.tolist() for x in suite.longest([" ".join(x).encode() for x in docs], ids)), strict=True)}
    want = {}
    for k, item in enumerate(items):
        w = words(" ".join(item))
        for p in range(len(w)):
            least = min(len(w), window)
            found = []
            for d, text in zip(ids.tolist(), docs, strict=True):
                v = words(" ".join(text))
                for a in range(len(v)):
                    n = 0
                    while p + n < len(w) and a + n < len(v) and w[p + n] == v[a + n]:
                        n += 1
                    if n >= least and (least == window or p == 0):
                        found.append((-n, d, a))
            if found:
                n, d, a = min(found)
                want[(str(k), p)] = (-n, d, a)
    assert got == want


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(50):
        n, kinds, depth = rng.randint(1, 60), rng.choice([2, 3, 10**6]), rng.randint(1, 20)
        s = np.array([rng.randrange(kinds) for _ in range(n)], np.int64)
        at = np.flatnonzero(s)
        pad = [*s.tolist(), *([0] * depth)]
        assert C.suffix_order(s, at, depth).tolist() == sorted(at.tolist(), key=lambda i: (pad[i : i + depth], i))


@pytest.fixture
def tables(spark):
    passage = "The quick brown fox jumps over the lazy dog and runs away from here"
    items = [(1, passage), (1, "another text of the same item that is long enough to count"), (2, "Short ONE"), (None, "items without an id have an empty one for all that"), (3, None), (4, ""), (5, "!?"), (12, passage), (6, "é 漢字 1")]
    docs = [
        None,
        "",
        " \n ",
        "nothing at all",
        passage,
        f"before {passage.upper()} after",
        passage.replace("fox", "FOX,"),
        passage.replace("over", "under"),
        "a short one, and a short-one; shortone",
        "É 漢字 1 é 漢字 1",
        " ".join([passage] * 3),
        "word " * 30_000 + passage + " word" * 30_000 + " short one",
    ]
    schema = "doc_id long, text string, id string, window long, item long"
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(docs)] + [(4, docs[4], "x", 1, 2), (None, docs[5], None, None, None)], schema).repartition(3)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long"), docs, items


@pytest.mark.parametrize(("block", "shard"), [(8 << 20, 4 << 20), (60, 64), (8 << 20, 1000)])
def test_odd_rows_blocks_and_pieces(tables, block, shard):
    """The same rows whether items come in one block or several, and texts whole or in pieces."""
    docs, bench, texts, items = tables
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 5, r["n_words"], {p for s in r["spans"] for p in range(s["start"], s["end"])}, r["items"]) for r in C.scan(docs, bench, block=block, shard=shard).collect())
    want = [(i, n, hit, sorted(names, key=str.encode)) for i, (n, hit, names) in enumerate(plain(texts, items))]
    assert got == sorted([*want, want[4], want[5]])


def test_affected_documents_go(spark, tables):
    docs, bench, texts, items = tables
    clean = C.without_benchmark(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, x in enumerate(plain(texts, items)) if not x[1]]
    assert C.without_benchmark(docs, bench.limit(0)).count() == docs.count()
    assert C.without_benchmark(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="spans"):
        C.scan(docs.withColumn("spans", F.lit(1)), bench)


def test_longest_matches_over_shards(tables):
    """Shards of a row each against one shard of all."""
    docs, bench, texts, _ = tables
    short = docs.where("doc_id < 11")
    one = {tuple(r) for r in C.longest_matches(short, bench).collect()}
    assert one == {tuple(r) for r in C.longest_matches(short, bench, shard=10_000).collect()}
    assert {(r[0], r[1]): r[2:] for r in one}[("1", 0)] == (14, 4, 0)
    assert {(r[0], r[1]): r[2:] for r in one}[("2", 0)] == (2, 8, 1)


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(con.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op13_benchmark_decontamination']})").fetchall())
    got = queries.QUERIES["op13_benchmark_decontamination"](spark, sf)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want
    assert sum(r[5] for r in want) > 0
