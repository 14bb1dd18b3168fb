"""Manifests against a plain climb over lists."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rollcall.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return levels, nodes[0]


def path(levels, i):
    out = []
    for nodes in levels:
        a = i // 16 * 16
        out.append((nodes[a:i], nodes[i + 1 : a + 16]))
        i //= 16
    return out


def expected(rows):
    by = {}
    for d, text, lang, source, n in rows:
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        own = leaf(d, source, lang, n, text)
        by.setdefault(source, []).append((d, own, leaf(d, source, lang, n, low) if hit else own))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [climbed([r[1] for r in by[g]]) for g in order]
    top, root = climbed([t[1] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, (d, own, now) in enumerate(by[g]):
            steps = path(trees[k][0], i) + path(top, k)
            for a, b in steps:
                now = digest(*a, now, *b)
            out.append((d, own, trees[k][1], root, digest(*(x for a, b in steps for x in a + b)), now, now == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 1], [256, 257, 3], [5000, 4, 1], [1] * 40])
def test_sizes_around_runs_and_blocks(spark, sizes):
    """One leaf, whole runs, one more than a run, a block, one more than a block, and three stages of blocks."""
    rows = [(i * 1000 + j, f"Text {i} {j}", "en", f"s{i:02d}", j) for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.hash("doc_id"))
    assert rows_of(merkle.audited(df)) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (2, "A" * 300_000, "en", None, 7), (2, "A" * 300_000, "en", None, 7), (2, "b", None, "é", -1), (-5, "漢字 ÄÖ", "de", "z", None), (None, "X", "en", "z", 1), (5, None, "en", "z", 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("tree", "rank", "node", "size", "proof", "top", "at", "kids")})
    assert rows_of(merkle.audited(df)) == expected(rows)
    assert merkle.audited(df.limit(0)).count() == 0


def test_general_proofs_fold_to_the_root(spark):
    """Other fields, another group and text ids; a changed digest no longer leads to the root."""
    df = spark.range(700).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("shard"), F.concat(F.lit("v"), "id").alias("value"))
    found = merkle.manifest(df, fields=("key", "value"), doc_id="key", group="shard").cache()
    assert found.count() == 700 and found.select("root").distinct().count() == 1
    assert found.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    assert found.where(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).isEmpty()
    found.unpersist()


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = sorted(con.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op12_merkle_manifest']})").fetchall(), key=repr)
    assert rows_of(queries.QUERIES["op12_merkle_manifest"](spark, sf)) == want
