"""Near words and their forms against comparisons of all pairs."""

import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.llm import queries, spelling


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected(counts, times=10):
    words = sorted(counts)
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()))


def vocabulary(seed):
    """Few letters, so that words are near each other in many ways and grams repeat; runs of one letter; long words."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(kinds) for _ in range(rng.randint(7, 11))) for kinds in ("ab", "abé", "abcdefÿ", "zÀ") for _ in range(120)}
    for n in (7, 8, 9, 12, 13):
        words |= {"a" * n, "ab" * n, "b" + "a" * n, "a" * n + "é"}
    for w in rng.sample(sorted(words), 80):
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "é" + w[i:], w[:i] + "q" + w[i + 1 :]}
    words = {w for w in words if len(w) >= 7} | {"x" * 70_000, "x" * 69_999 + "y", "y" + "x" * 69_999 + "y"}
    return {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in words}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    counts = vocabulary(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows_of(spelling.variants(df)) == sorted(expected(counts))


def test_one_edit_of_long_words(spark):
    """Words of over 64 code points are compared by another expression."""
    base = "abcdefghij" * 7
    others = [base, base[1:], base[:-1], base[:30] + base[31:], "x" + base, base + "x", base[:9] + "é" + base[9:], "x" + base[1:], base[:-1] + "x", base[:40] + "é" + base[41:], base[1:] + "x", "xx" + base, base[:5] + "xy" + base[7:], base[::-1]]
    rows = spark.createDataFrame([(a, b) for a in (base, base[:-1]) for b in others], "a string, b string")
    for r in rows.select("a", "b", spelling.one_edit(F.col("a"), F.col("b")).alias("near")).collect():
        assert r["near"] == one_edit(r["a"], r["b"]), r


def test_few_candidates(spark):
    """Keys bring little together besides near words."""
    rng = random.Random(3)
    parts = ["ta", "re", "no", "mi", "so", "le", "ku", "pa", "di", "ro"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(4, 6))) for _ in range(4000)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    rows = spelling.index(df).cache()
    met = rows.where("pivot").groupBy("key").count().join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("all")), "key").agg(F.sum(F.col("count") * F.col("all"))).first()[0]
    rows.unpersist()
    assert met < 0.03 * len(words) ** 2
    assert spelling.near_pairs(df).count() == sum(one_edit(a, b) for a, b in combinations(sorted(words), 2))


@settings(max_examples=300, deadline=None)
@given(places=st.lists(st.integers(0, 9), min_size=3, max_size=6, unique=True), data=st.data())
def test_pivots_weigh_least(places, data):
    places = sorted(places)
    weight = [data.draw(st.integers(0, 20)) for _ in places]
    a, b = spelling.pivots(np.array([places]), np.array([weight]), np.arange(len(places))[None, :]).tolist()
    assert abs(places[a] - places[b]) >= 2
    assert weight[a] + weight[b] == min(weight[i] + weight[j] for i, j in combinations(range(len(places)), 2) if places[j] - places[i] >= 2)


def test_words_of_odd_rows(spark):
    texts = [None, "", " 123 ", "ALPHABET alphabet Alphabet alphabets", "Überfälle ÜBERFÄLLE überfälle", "short wordss sevenne sevenne", "naïvement×naïvement÷naïvement", "étudiante étudiante", "x" * 100_000 + " " + "x" * 100_000]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumn("n", F.lit(1)).withColumn("run", F.lit("r"))
    import re

    want = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.corpus_words(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert spelling.corpus_words(df.limit(0)).count() == 0
    assert spelling.variants(spelling.corpus_words(df.limit(0))).count() == 0


def test_chains_end_at_the_last_form(spark):
    """Ten forms in a row, each ten times as frequent."""
    words = ["a" * 7 + "b" * k for k in range(10)]
    df = spark.createDataFrame([(w, 10**k) for k, w in enumerate(words)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(df).collect()}
    assert got == {w: (words[k + 1] if k < 9 else None, words[9]) for k, w in enumerate(words)}


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select word, form, root, n, n_near, form_n from ({queries.ORACLE_SQL['op11_spelling_variants']})").fetchall()
    assert rows_of(queries.QUERIES["op11_spelling_variants"](spark, sf)) == sorted(want)
