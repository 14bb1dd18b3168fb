"""The operators on small tables against brute force, and on the odd cases: nulls, empty tables, ties, extra columns."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rollcall.llm import chat, classifier, embeddings, packing, quality_rules, simhash, suffix, token_files, toxicity
from rollcall.llm.bpe import ByteBpe, decode_bpe, encode_bpe
from rollcall.llm.common import components, work_path

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " \n\t ", "one", "Ein Wort, noch ein Wort.\nEin Wort, noch ein Wort.\n", "a" * 5000, "héé 漢字 🎉 <|endoftext|> it's 1234\r\n  x", "the quick brown fox jumps over the lazy dog " * 30]
SCHEMA = "doc_id long, text string, key long, h long, a string, fp string, d string, component string"


def table(spark, texts, parts=3):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 1, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA).repartition(parts)


def words(text):
    return (text or "").encode().split()


def reach(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# BPE ---------------------------------------------------------------------------------------------------------------------
def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [*TEXTS, "   ", "　x  y", "aaa aaaa aaaaa", "don't DON'T 'll", "<|endoftext|><|endoftext|>"]
    coded = encode_bpe(table(spark, texts), path)
    got = {r["doc_id"]: list(r["ids"]) for r in coded.collect()}
    back = {r["doc_id"]: r["decoded"] for r in decode_bpe(coded, path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t or "", add_special_tokens=False).ids
        assert back[i] == (t or "")
    assert encode_bpe(table(spark, texts).limit(0), path).count() == 0


def test_bpe_cache_may_overflow():
    data = open(P.path("byte_bpe_50k.json"), "rb").read()
    small, large = ByteBpe(data, word_cache=3), ByteBpe(data)
    docs = ["alpha beta gamma", "delta alpha", "beta epsilon zeta"]
    assert [small.encode([d])[0] for d in docs] == large.encode(docs)


# Token files -------------------------------------------------------------------------------------------------------------
def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*TEXTS, "A Word. a word; <|startoftext|> <|STARTOFTEXT|>"]
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, "no id", 1, 1, "", "", "", ""), (3, "twice", 1, 1, "", "", "", "")], SCHEMA))
    got = token_files.token_binary(docs, path).collect()
    want = sorted([(i, t) for i, t in enumerate(texts)] + [(3, "twice")], key=lambda x: x[0])
    ids = lambda t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(ids(t)) // 4, zlib.crc32(ids(t))) for i, t in [*want, (None, "no id")])
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.token_binary(docs.limit(0), path).count() == 0


def test_token_reader_checks_frames(tmp_path):
    f = tmp_path / "x.tok.zst"
    with open(f, "wb") as out:
        w = token_files.Writer(out, frame_bytes=40)
        for d in range(20):
            w.add(d, np.arange(d, dtype="<u4").tobytes())
        w.close()
    with open(f, "rb") as file:
        r = token_files.Reader(file, f.stat().st_size)
        assert [(d, len(b) // 4) for d, b in r.documents({7, 19})] == [(7, 7), (19, 19)]
        assert len(r.frames) > 3
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj().decompress(f.read_bytes()[: r.frames["packed"][0]]) is not None
    raw = bytearray(f.read_bytes())
    raw[10] ^= 255
    f.write_bytes(raw)
    with open(f, "rb") as file, pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(file, len(raw)).documents())


# Chat --------------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    odd = [r"\### Assistant: </turn> ok", "", None, "# ## ### #### #####", r"\\/ \# \: <\/turn>", "</turn></turn>", "漢字 🎉"]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(odd)] + [(2, i, "assistant" if i % 5 else "odd: role\\", f"t{i}") for i in range(200)] + [(3, None, None, None), (None, 1, "user", "x"), (2, 7, "user", "tie"), (2, 7, "user", "tie")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, chunk long")
    back = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert "".join(back[c]["loss_texts"]) == "".join(x for _, r, x in turns if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_merges_turns_of_one_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    for chunk in (1, 64):
        r = chat.format_chats(df, chunk_turns=chunk).first()
        assert r["formatted"] == "### user: a</turn>b</turn>### assistant: c</turn>"


def test_chat_mask_that_does_not_fit(spark):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="mask"):
        chat.read_chats(df.withColumn("formatted", F.concat("formatted", F.lit("x")))).collect()


# Quality rules -----------------------------------------------------------------------------------------------------------
def brute_stats(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_rules(spark):
    good = " ".join(f"word{i} in sentence{i}." for i in range(60))
    texts = [*TEXTS, good, good.replace(".", "###$$$"), "x y\r\nx y\r\n\x0b\n", *[good + f" tail{i}" for i in range(20)]]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_stats(t)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[8]["kept"] and got[9]["posterior"] < got[8]["posterior"]
    assert quality_rules.quality_rules(table(spark, texts).limit(0)).count() == 0


def test_vote_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    right, said = np.array([0.95, 0.8, 0.6, 0.9]), np.array([0.9, 0.7, 0.8, 0.5])
    v = np.where(rng.random((len(y), 4)) < said, np.where((rng.random((len(y), 4)) < right) == y[:, None], 2, 1), 0)
    patterns, at, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    prior, tab = quality_rules.fit(patterns, n.astype(float))
    found = tab[1, :, 2] / (tab[1, :, 1] + tab[1, :, 2])
    assert abs(prior - 0.7) < 0.03 and np.abs(found - right).max() < 0.04
    assert ((quality_rules.posterior(patterns, prior, tab)[at.ravel()] > 0.5) == y).mean() > 0.93


# Learned scores -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_learned_scores(spark, sf, kind):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    f = classifier.quality_scores if kind == "quality" else toxicity.toxicity_scores
    got = {r["doc_id"]: r for r in f(docs, labels).collect()}
    truth = {r["doc_id"]: r[kind] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == truth[i] for i in held])
    assert right >= max(0.93, max(Counter(truth[i] for i in held).values()) / len(held))


@pytest.mark.parametrize("f", [classifier.quality_scores, toxicity.toxicity_scores])
def test_learned_scores_odd_tables(spark, f):
    label = "quality" if f is classifier.quality_scores else "toxic"
    docs = table(spark, TEXTS)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = f(docs, none).collect()
    assert len(got) == len(TEXTS) and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 1), (3, 0), (4, 1)], f"doc_id long, {label} int")
    assert f(docs, one).count() == len(TEXTS)
    assert f(docs.limit(0), one).count() == 0


def test_machine_learns_pairs():
    rng = np.random.default_rng(1)
    filler = [f"filler{i}" for i in range(40)]
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join([*rng.choice(filler, 6), *(["insultword"] if a else []), *(["groupword"] if b else [])]).encode(), int(a and b)))
    m = toxicity.train(rows, bits=16, epochs=20, rate=0.2)
    s = m.score([b"insultword filler1 filler2", b"groupword filler3 filler4", b"insultword groupword filler5 filler6"])
    assert s[2] > 0.5 > max(s[0], s[1])
    v = m.v[toxicity.terms([b"insultword"], 16)[0]], m.v[toxicity.terms([b"groupword"], 16)[0]]
    assert float((v[0].sum(0) * v[1].sum(0)).sum()) > 0


def test_machine_learns_pairs_of_words_that_say_nothing_alone():
    """Toxic if exactly one of two words is there: neither has an association of its own, nor has either a weight without the other."""
    rng = np.random.default_rng(1)
    filler = [f"filler{i}" for i in range(40)]
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join([*rng.choice(filler, 6), *(["oneword"] if a else []), *(["otherword"] if b else [])]).encode(), int(a != b)))
    m = toxicity.train(rows, bits=16, epochs=20)
    s = m.score([b"oneword filler1 filler2", b"filler3 filler4 otherword", b"filler5 oneword otherword filler6", b"filler7 filler8"])
    assert min(s[0], s[1]) > 0.9 and max(s[2], s[3]) < 0.1


def test_machine_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(-0.3, rng.normal(size=1 << 8), rng.normal(size=(1 << 8, 3)) * 0.2, 8)
    texts = ["one two three", "Insult, insult! Two", "", "漢字 wörd-y (group)"]
    for t, s in zip(texts, m.score([t.encode() for t in texts]), strict=True):
        ids = toxicity.terms([t.encode()], 8)[0].tolist()
        raw = -0.3 + sum(float(m.w[i]) for i in ids) + sum(float(m.v[i] @ m.v[j]) for i, j in combinations(ids, 2))
        assert s == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5)


def test_toxicity_recall_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"] == 1], [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) > 90 and np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


# SimHash -----------------------------------------------------------------------------------------------------------------
def brute_print(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [8192, 3])
def test_simhash(spark, cap):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{i}" for i in range(200)], 80)) for _ in range(6)]
    texts = list(TEXTS)
    for t in base:
        texts += [t, t.upper(), t + " extra", t.replace("w1 ", "v1 ", 1), " ".join(t.split()[:-1])]
    docs = table(spark, texts).unionByName(table(spark, [base[0]]))
    got = simhash.near_duplicates(docs, cap=cap).collect()
    prints = [brute_print(t) for t in texts]
    want = reach(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    ids = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got]
    # the row that repeats id 0 with another text joins what it is near to
    zero = reach(len(texts) + 1, [*((i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4), *((len(texts), j) for j in range(len(texts)) if (prints[j] ^ brute_print(base[0])).bit_count() <= 4), (0, len(texts))])
    assert Counter(x[:2] for x in ids) == Counter([(i, f"{p:016x}") for i, p in enumerate(prints)] + [(0, f"{brute_print(base[0]):016x}")])
    del want
    near0 = {i for i in range(len(texts)) if zero[i] == 0}
    for d, _, c in ids:
        assert c == (0 if d in near0 and c == 0 else c) and c <= d
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [8192, 7])
def test_simhash_components_against_all_pairs(spark, sf, cap):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, cap=cap).collect()}
    ids = sorted(got)
    p = np.array([int(got[i]["fingerprint"], 16) for i in ids], np.uint64)
    x, y = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4)
    want = reach(len(ids), zip(x.tolist(), y.tolist(), strict=True))
    assert [got[i]["component_id"] for i in ids] == [ids[w] for w in want]


def test_simhash_tables_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (100, 10**6, 10**9, 10**12):
        tables = simhash.blocks(n, 4)
        for _ in range(200):
            flips = rng.choice(64, 4, replace=False)
            assert any(not any(a <= f < a + b for f in flips for a, b in t) for t in tables)


@pytest.mark.parametrize("hub", [1_000_000, 5])
def test_components_of_a_chain_and_a_star(spark, hub):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7)]
    df = spark.createDataFrame(chain, "src long, dst long")
    got = {r["node"]: r["component"] for r in components(df, "t", hub=hub).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 50)}
    assert components(df.limit(0), "t", hub=hub).count() == 0


# Embeddings ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("cap", [4096, 5])
def test_embeddings(spark, cap):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 16))
    v[20:40] = v[:20] + rng.normal(size=(20, 16)) * 0.12
    v[40:50] = v[40]
    v[50] = 3 * v[0]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [1.0, 2.0], 1), (205, [], 1), (206, [float("inf")] + [1.0] * 15, 1), (207, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid long").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, cap=cap).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    x, y = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    links = Counter(x.tolist()) + Counter(y.tolist())
    want = reach(120, zip(x.tolist(), y.tolist(), strict=True))
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(120)] == [(links[i], want[i], want[i] == i) for i in range(120)]
    for i in (200, 201, 202, 203, 205, 206):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[204]["n_links"] == 1 and got[207]["component_id"] == 204
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_against_all_pairs(spark):
    """Recall where it can fall: 600 pairs planted at cosines from 0.95 to 0.97 among 40,000 vectors, tables of eleven bits."""
    rng = np.random.default_rng(8)
    n, d, planted = 40_000, 24, 600
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    other = rng.normal(size=(planted, d))
    other -= (other * v[:planted]).sum(1, keepdims=True) * v[:planted]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.97, (planted, 1))
    v[-planted:] = c * v[:planted] + np.sqrt(1 - c * c) * other
    assert embeddings.plan(n, 0.95, 0.999, 32)[1] == 11
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, per_group=32).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.concatenate([(unit[i : i + 2000] @ unit.T >= 0.95).sum(1) - 1 for i in range(0, n, 2000)])
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert want.sum() >= 2 * planted and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum(), found.sum() / want.sum()


# Suffix arrays -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    rng = np.random.default_rng(seed)
    alphabet = [1, 2, 3, 250][: 1 + seed % 4] if seed < 5 else list(range(256))
    text = rng.choice(alphabet, 600).astype(np.uint8)
    text[100:200] = text[300:400]
    text[450:520] = alphabet[0]
    first, last = np.array([0, 250, 420]), np.array([220, 400, 540])
    depth = 40
    order = suffix.two_stage(text, first, last, depth)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in order.tolist()]
    wanted = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    assert set(wanted) <= set(order.tolist()) and len(set(order.tolist())) == len(order)
    runs = sum(a != b for a, b in zip(keys, keys[1:], strict=False)) + 1
    assert runs == len(set(keys))  # equal prefixes lie side by side


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((gone, bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


def runs_in(gone):
    edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def suffix_texts(length, gram):
    rng = np.random.default_rng(length)
    fresh = lambda n: "".join(rng.choice(list("abcdefgh ä"), n))
    shared, edge = fresh(3 * length), fresh(length - 1)
    exact = "e" + "".join(rng.choice(list("abcdefgh "), length - 1))
    texts = [*TEXTS, shared + fresh(50), fresh(70) + shared, fresh(30) + shared[: length + 5] + fresh(9), edge + fresh(99), fresh(33) + edge, exact + fresh(7), fresh(8) + exact, "ab" * length, fresh(900), "x" * (length + 1), shared]
    texts += [fresh(40) + shared[10 : 10 + gram + 12] + fresh(40) for _ in range(12)]
    return [*texts, texts[9]]


@pytest.mark.parametrize(("cap", "length", "gram"), [(512, 40, 16), (1, 40, 16), (512, 400, 128), (2, 33, 8)])
def test_suffix_removal(spark, cap, length, gram):
    texts = suffix_texts(length, gram)
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs, length=length, gram=gram, cap=cap, different=4 * cap, shard_bytes=2000).collect()}
    for i, (gone, kept) in enumerate(brute_removed(texts, length)):
        r = got[i]
        assert (r["n_bytes"], bytes(r["kept"])) == (len(gone), kept), i
        assert [(s["start"], s["end"]) for s in r["spans"]] == runs_in(gone)
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [512, 1])
def test_suffix_passages(spark, cap):
    """Shorter repeats beside the removed ones: the same spans and bytes, and the passages by words or bytes."""
    texts = [*suffix_texts(60, 16), "k l m n o p q r s t u v w x y z 1", "9 k l m n o p q r s t u v w x y z"]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs, length=60, gram=16, passage=24, least_words=10, cap=cap, different=2).collect()}
    plain = {r["doc_id"]: r for r in suffix.remove_repeats(docs, length=24, gram=8, least_words=10, always=60).collect()}
    long, short = brute_removed(texts, 60), brute_removed(texts, 24)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = [(a, b) for a, b in runs_in(short[i][0]) if b - a >= 60 or len(raw[a:b].split()) > 10]
        assert bytes(got[i]["kept"]) == long[i][1] and [(s["start"], s["end"]) for s in got[i]["spans"]] == runs_in(long[i][0])
        assert [(s["start"], s["end"]) for s in got[i]["passages"]] == want == [(s["start"], s["end"]) for s in plain[i]["spans"]]
        edges = [0, *(v for s in want for v in s), len(raw)]
        assert bytes(plain[i]["kept"]) == b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
    assert suffix.remove_repeats(docs.limit(0), passage=200).count() == 0


@pytest.mark.parametrize(("cap", "different"), [(512, 512), (20, 20), (3, 2)])
def test_suffix_frequent_passage(spark, cap, different):
    """A passage in many new surroundings, and many copies of a text: groups over the cap are cut finer, with no loss."""
    rng = np.random.default_rng(4)
    fresh = lambda n: "".join(rng.choice(list("abcdefghij klmno"), n))
    common, copy = fresh(300), fresh(500)
    texts = [fresh(90) + common[: 180 + i % 90] + fresh(90) for i in range(150)] + [copy] * 60 + [fresh(50) + copy[i : i + 250] for i in range(40)]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(table(spark, texts), length=250, passage=200, cap=cap, different=different).collect()}
    for i, ((gone, kept), (short, _)) in enumerate(zip(brute_removed(texts, 250), brute_removed(texts, 200), strict=True)):
        assert ([(s["start"], s["end"]) for s in got[i]["spans"]], bytes(got[i]["kept"])) == (runs_in(gone), kept), i
        assert [(s["start"], s["end"]) for s in got[i]["passages"]] == runs_in(short), i


def test_suffix_does_not_trust_hashes(spark):
    """With hashes that agree far too often the result is the same: bytes decide."""
    texts = suffix_texts(40, 16)
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "d long, text string").withColumns({"th": F.xxhash64("text"), "text": F.col("text").cast("binary")})
    runs = suffix.find_runs(docs, 40, 16, 60)
    open_runs = runs.where("sure <> 1").withColumn("h", F.col("h") % 3)
    sizes = open_runs.groupBy("h").count().withColumnRenamed("count", "n")
    contexts = suffix.contexts_of(open_runs.join(sizes, "h").select("h", "d", "th", "a", "b", "p", "n", (F.col("sure") == 2).alias("known")), docs, 60)
    sure = suffix.whole_spans(runs.where("sure > 0").select("d", "th", "a", "b", F.col("b").alias("e"), F.lit(0).alias("kind")), 40, 60)
    spans = sure.unionByName(suffix.compare_groups(contexts, 40, 60, 1 << 20)).collect()
    for size in (40, 60):
        gone = [np.zeros(len((t or "").encode()), bool) for t in texts]
        for r in spans:
            if r["size"] == size:
                gone[r["d"]][r["a"] : r["b"] + size] = True
        assert [g.tolist() for g in gone] == [g.tolist() for g, _ in brute_removed(texts, size)]


def test_suffix_clashing_columns(spark):
    names = ["d", "th", "text", "a", "b", "h", "p", "k", "keep", "hits", "bytes"]
    rows = [(*range(i, i + len(names)), "same words " * 60) for i in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", body string")
    got = suffix.remove_repeats(df, text="body", keep=tuple(names), passage=200).orderBy("d").collect()
    assert [tuple(r[n] for n in names) for r in got] == [r[:-1] for r in rows] and all(bytes(r["kept"]) == b"" for r in got)
    with pytest.raises(ValueError, match="kept"):
        suffix.remove_repeats(df.withColumnRenamed("d", "kept"), text="body", keep=("kept",))


def test_suffix_removal_of_long_texts(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghij klmno"), 1_300_000))
    rows = [(1, "a" * 1_200_000), (2, "lorem ipsum " * 100_000), (3, long), (4, long[1000:1_250_000] + "x"), (5, long[:399])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix.remove_repeats(df).collect()}
    assert got == {1: [(0, 1_200_000)], 2: [(0, 1_200_000)], 3: [(1000, 1_250_000)], 4: [(0, 1_249_000)], 5: []}


# Packing --------------------------------------------------------------------------------------------------------------------
def plain_best_fit(lengths, sizes, costs):
    bins = []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = sum(lengths)
    at = {}
    for i in order:
        n = lengths[i]
        left -= n
        fit = [(b["cap"] - b["used"], -k) for k, b in enumerate(bins) if b["cap"] - b["used"] >= n]
        if fit:
            room = min(f[0] for f in fit)
            at[i] = room
        else:
            cap = min((s for s in sizes if s >= n), key=lambda s: (costs(s) / (n + min(s - n, left)), s))
            bins.append({"cap": cap, "used": 0})
            at[i] = cap
        k = next(k for k, b in reversed(list(enumerate(bins))) if b["cap"] - b["used"] == at[i])
        bins[k]["used"] += n
    return sorted(min(s for s in sizes if s >= b["used"]) for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 200)
    sizes, costs = (16, 32, 64), packing.Costs(fixed=3.0, quadratic=1e-3)
    got = packing.best_fit(lengths, sizes, costs)
    assert sorted(got.capacity) == plain_best_fit(lengths.tolist(), sizes, costs)
    for b in range(len(got.capacity)):
        at = np.flatnonzero(got.bin == b)
        parts = sorted(zip(got.offset[at].tolist(), lengths[at].tolist(), strict=True))
        assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([n for _, n in parts])[:-1]]).tolist()
        assert sum(n for _, n in parts) <= got.capacity[b]


@pytest.mark.parametrize("shard_rows", [100_000, 4])
def test_packing_keeps_everything(spark, shard_rows):
    texts = [*TEXTS, "w " * 5000, "w " * 1023, "w " * 1022]
    docs = table(spark, texts).unionByName(table(spark, ["again"])).unionByName(spark.createDataFrame([(None, "none", 1, 1, "", "", "", "")], SCHEMA))
    rows = packing.pack(docs, sizes=(256, 1024), shard_rows=shard_rows).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    want = Counter({i: len(words(t)) + 1 for i, t in enumerate(texts)})
    want[0] += 2
    want[None] += 2
    assert total == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append((r["bin_offset"], r["length"], r["bin_capacity"]))
    for parts in bins.values():
        assert len({c for *_, c in parts}) == 1 and sum(n for _, n, _ in parts) <= parts[0][2]
        end = 0
        for o, n, _ in sorted(parts):
            assert o == end
            end += n
    assert packing.pack(docs.limit(0)).count() == 0


# Pipeline -------------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        path = work_path(spark, f"test-{name}")
        stage(spark, docs, big).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == pipeline.COLUMNS
        seen[name] = (before, docs)
    before, after = seen["simhash_near_dedup"]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert {r[0] for r in after.select("doc_id").collect()} == set(groups.values())
    before, after = seen["suffix_array_dedup"]
    rows = before.orderBy("doc_id").collect()
    brute = brute_removed([r["text"] for r in rows], 200)
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    for r, (gone, _) in zip(rows, brute, strict=True):
        raw = (r["text"] or "").encode()
        cuts = [(a, b) for a, b in runs_in(gone) if b - a >= 400 or len(raw[a:b].split()) > 50]
        edges = [0, *(v for c in cuts for v in c), len(raw)]
        assert got[r["doc_id"]] == b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)).decode("utf-8", "ignore")
    packed = pipeline.STAGES[-1][1](spark, docs, big)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(words(r["text"])) + 1 for r in docs.collect())


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text without id", "en", "s", 15), (3, "same words here now", "en", "s", 19), (3, "same words here now", "en", "s", 19)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 5
    kept = pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, None, 3])


def test_digests_are_those_of_the_contract(spark, sf):
    from rollcall.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5).collect()
    got = {r["doc_id"]: r for r in queries.op8_bpe_codec(spark, sf).collect()}
    bpe = ByteBpe(open(P.path("byte_bpe_50k.json"), "rb").read())
    for r in docs:
        ids = np.frombuffer(bpe.encode([r["text"]])[0], "<i4").tolist()
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert json.loads(open(P.path("byte_bpe_50k.json")).read())["model"]["vocab"]
