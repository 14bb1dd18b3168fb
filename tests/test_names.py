"""Similar names against the textbook distance of insertions and deletions, pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import text
from rollcall.operators import resolve


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(row[j], row[j + 1])
    return row[-1]


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 100 * (1 - distance(a, b) / max(1, len(a) + len(b)))


def test_ratio_of_any_texts(spark):
    rng = random.Random(5)
    sizes = [0, 1, 2, 15, 62, 63, 64, 65, 130, 255, 256]
    made = [tuple("".join(rng.choices("abcé\U0001f600\0", k=rng.choice(sizes))) for _ in "ab") for _ in range(200)]
    rows = [(i, *p) for i, p in enumerate([*made, ("", ""), ("a", ""), ("same", "same")])] + [(900, None, "x"), (901, "x", None), (902, None, None)]
    got = {r["i"]: r["r"] for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", text.indel_ratio("a", "b").alias("r")).collect()}
    want = {i: None if a is None or b is None else 100 * (1 - distance(a, b) / max(1, len(a) + len(b))) for i, a, b in rows}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [50.0, 66.0, 67.0, 80.0, 90.0, 100.0])
def test_candidates_are_the_most_similar(spark, threshold):
    rng = random.Random(7)
    words = ["Mary", "mary", "A.", "Jones", "Jonas", "O'Neil", "van", "Dam", "Smith-Lee", "Åsa", "Li"]
    name = lambda: "  ".join(rng.choices(words, k=rng.randint(1, 4)))
    members = [(i, rng.choice("HS"), name()) for i in range(40)] + [(40, "H", ""), (41, "H", "a" * 300)]
    names = sorted({(rng.choice("HSX"), name()) for _ in range(30)} | {("H", ""), ("H", "a" * 301), ("S", "aaaaaaa")})
    m = spark.createDataFrame(members, "member_id long, chamber string, name string")
    found = resolve.candidates(spark.createDataFrame(names, "chamber string, name string"), m, 3, threshold)
    want = set()
    for chamber, n in names:
        scored = sorted((-round(ratio(n, full), 6), i) for i, c, full in members if c == chamber and ratio(n, full) >= threshold - 1e-9)
        want |= {(chamber, n, i, -s, place + 1) for place, (s, i) in enumerate(scored[:3])}
    assert {(r["chamber"], r["name"], r["member_id"], round(r["score"], 6), r["place"]) for r in found.collect()} == want


@pytest.mark.parametrize("threshold", [90.0, 95.0])
def test_similarity_join_loses_no_pair_and_looks_at_few(spark, threshold):
    """5,000 members and 2,000 misspelled or other names against all pairs."""
    rng = random.Random(11)
    parts = ["Ander", "son", "Bern", "ard", "Cas", "tillo", "De", "lacroix", "Ed", "wards", "Fitz", "gerald", "Gon", "zalez", "Har", "ington", "Jo", "hannsen", "Kowal", "ski", "Lind", "strom", "Mc", "Allister"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3))).capitalize()
    members = [(i, rng.choice("HS"), f"{word()} {rng.choice('ABCDEFGH')}. {word()}") for i in range(5000)]

    def spoiled(n):
        n = list(n)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(n))
            n[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        rng.random() < 0.2 and n.reverse()
        return "".join(n)

    names = sorted({(c, spoiled(n)) for _, c, n in rng.sample(members, 2000)})
    m = spark.createDataFrame(members, "member_id long, chamber string, name string")
    x = spark.createDataFrame(names, "chamber string, name string").select("chamber", "name", text.token_sort(F.col("name"), False).alias("__x"))
    y = m.select("chamber", "member_id", F.col("name").alias("full"), text.token_sort(F.col("name"), False).alias("__y"))
    room = (F.length("__x") + F.length("__y")) * (1 - threshold / 100) + 1e-9
    every = x.join(y, "chamber")
    near = every.where(F.abs(F.length("__x") - F.length("__y")) <= room).where(F.levenshtein("__x", "__y") <= room)
    want = {(r["name"], r["member_id"]) for r in near.where(text.indel_ratio("__x", "__y") >= threshold).collect()}
    found = resolve.similar_pairs(x, y, ["name"], ["member_id", "full"], "__x", "__y", "chamber", threshold).cache()
    assert len(want) > 400
    assert want <= {(r["name"], r["member_id"]) for r in found.collect()}
    total = every.count()
    assert found.count() < 0.02 * total  # names made of 24 syllables share many grams
    assert found.where((F.col("met") > 0) & (F.levenshtein("__x", "__y") <= room)).count() < 0.001 * total  # what is scored
    found.unpersist()


def test_cascade_of_odd_names(spark):
    """Every method once: no member, known, exact, after a vote code, similar, unresolved; nulls match nothing."""
    members = spark.createDataFrame([(1, "Mary Ann Flowers", "H"), (2, "Emanuel Welch", "H"), (3, "Robert Martwick", "S"), (4, None, "S")], "member_id long, name string, chamber string")
    gold = spark.createDataFrame([("Chris", 2)], "name string, member_id long")
    names = spark.createDataFrame([("H", "Mr. Speaker"), ("H", "Chris"), ("H", "Flowers, Mary Ann"), ("H", "Y Welch, Emanuel"), ("S", "Robert Martwik"), ("H", "Robert Martwik"), ("S", "Zzz"), ("S", None), (None, "Flowers"), ("S", "")], "chamber string, name string")
    got = {(r["chamber"], r["name"]): (r["member_id"], r["method"]) for r in resolve.resolve(names, members, gold).collect()}
    assert got == {
        ("H", "Mr. Speaker"): (None, "non_member"),
        ("H", "Chris"): (2, "gold"),
        ("H", "Flowers, Mary Ann"): (1, "exact"),
        ("H", "Y Welch, Emanuel"): (2, "stripped"),
        ("S", "Robert Martwik"): (3, "fuzzy"),
        ("H", "Robert Martwik"): (None, "unresolved"),
        ("S", "Zzz"): (None, "unresolved"),
        ("S", None): (None, "unresolved"),
        (None, "Flowers"): (None, "unresolved"),
        ("S", ""): (None, "non_member"),
    }


def test_known_ratios(spark):
    pairs = [("Jones Mary", "Mary Jones", 100.0), ("abcd", "abxd", 75.0), ("JONES", "jones", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, want double")
    got = rows.select(text.similarity(F.col("a"), F.col("b"), fold=False).alias("r"), "want").collect()
    assert all(r["r"] == pytest.approx(r["want"]) for r in got)


@pytest.mark.parametrize("limit", [32 << 20, 60_000])
def test_names_in_texts_equal_contains(spark, limit):
    """10,000 names in texts of all kinds, in one pass and in several."""
    rng = random.Random(3)
    syllables = ["An", "der", "son", "Wel", "ch", "Mar", "tin", "O'", "Li", "Äs", "É"]
    names = [(i, "".join(rng.choices(syllables, k=rng.randint(2, 5)))) for i in range(9_997)] + [(9_997, ""), (9_998, None), (9_999, "İ")]
    texts = [(i, " ".join(n.upper() if rng.random() < 0.5 else n for _, n in rng.sample(names[:9_000], 3)) + rng.choice(["", " and others", "son"])) for i in range(60)] + [(60, ""), (61, None), (62, "İ i̇")]
    m = spark.createDataFrame(names, "member_id int, name string")
    t = spark.createDataFrame([(*r, "x") for r in texts], "i int, text string, name string")
    got = resolve.named_in(t, m, "text", limit)
    low = lambda df, c: {r[0]: r[1] for r in df.select(df.columns[0], F.lower(c)).collect()}
    in_texts, in_names = low(t.select("i", "text"), "text"), low(m, "name")
    want = {(i, n) for i, x in in_texts.items() for n, y in in_names.items() if x is not None and y is not None and y in x}
    assert sorted((r["i"], r["member_id"]) for r in got.collect()) == sorted(want)
    assert resolve.named_in(t, m.limit(0), "text").count() == 0
