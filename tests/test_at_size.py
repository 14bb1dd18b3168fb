"""What larger tables showed: figures of four digits, graphs over the bounds of one machine, long texts."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollcall.functions import classify
from rollcall.functions.text import indel_ratio, ratios
from rollcall.operators import graph, resolve, search_index, votes
from rollcall.plans import catalog_functions
from rollcall.plans.catalog import ORACLE, QUERIES

assert catalog_functions.query  # it adds to the same catalogue


def test_anomaly_reason_without_grouped_thousands(spark):
    df = spark.createDataFrame([(0.6, 6666.66, 0.1, 0.001, 0.1)], "t double, d double, u double, v double, h double")
    got = df.select(classify.anomaly_reason(*(F.col(c) for c in "tduvh"))).first()[0]
    assert got == "one organization files 60%; names recur 6666.7 times; few organizations (0.1%)"


def test_hours_since_of_odd_rows_as_its_sql(spark, tmp_path):
    rows = spark.sql("select * from values (1L, timestamp '2024-07-01 10:00:00.999999'), (9L, null), (2L, null), (null, timestamp '2024-01-01 00:00:01') t(event_id, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    db.execute(f"create view events as select event_id, ts::timestamp as ts from '{tmp_path}/events.parquet/*.parquet'")
    by_id = lambda found: sorted(found, key=str)
    assert by_id(map(tuple, QUERIES["c27_hours_since"](spark, str(tmp_path)).collect())) == by_id(db.execute(ORACLE["c27_hours_since"]).fetchall())


@pytest.mark.parametrize("kind", ["timestamp", "timestamptz"])
def test_hours_since_in_any_session_zone(spark, tmp_path, kind):
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    rows = f"select i event_id, (timestamp '1968-12-31 23:59:58.000001' + to_hours(7 * i))::{kind} ts from range(80000) t(i)"  # to 2032
    db.execute(f"copy ({rows}) to '{tmp_path}/events.parquet'")
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(db.execute(ORACLE["c27_hours_since"]).fetchall())
    try:
        for zone in ("UTC", "America/Chicago", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(map(tuple, QUERIES["c27_hours_since"](spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_timeline_goes_by_votes_not_by_events(spark):
    n = 400
    cast = [(1, e, f"{1990 + e // 10}-01-0{1 + e % 9}", "floor", e % 7 if e % 50 == 0 else 10, ("Y", "N", "NV")[e % 3]) for e in range(n)]
    df = spark.createDataFrame(cast, "bill long, event_id long, date string, vote_type string, member_id long, vote string")
    out = votes.timeline(df, ["bill"])
    order = sorted(range(n), key=lambda e: (cast[e][2], e))
    want = {m: " ".join(cast[e][5] if cast[e][4] == m else "--" for e in order) for m in {x[4] for x in cast}}
    assert {r["member_id"]: r["codes"] for r in out.collect()} == want
    assert "sequence(1, n_events" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_grams_of_a_long_text_take_one_pass(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(150_000)) + "Ä漢字𝒳y"
    df = spark.createDataFrame([(text,), ("ab",), (None,)], "t string").repartition(1)
    start = time.monotonic()
    got = [r[0] for r in df.select(search_index.grams(F.col("t"))).collect()]
    assert time.monotonic() - start < 20  # with the text taken apart for every place in it: minutes
    low = text.lower()
    assert sorted(map(len, got)) == [0, 0, len({low[i : i + 3] for i in range(len(low) - 2)})]
    assert set(max(got, key=len)) == {low[i : i + 3] for i in range(len(low) - 2)}


def test_all_pairs_of_names_are_scored_as_tables(spark):
    a = ["", "Ann Lee", "Lee Annä 漢", "x" * 63, "y" * 70 + "Lee", "Supplier#000000042"]
    b = ["", "Lee", "Ann  Lee", "漢Annä", "x" * 300, "Supplier#0000000421", "yLe\0"]
    want = [list(indel_ratio.func(pd.Series([x] * len(b)), pd.Series(b))) for x in a]
    assert ratios(a, b).tolist() == want
    names = spark.createDataFrame([(str(i % 2), f"Member {i * 7 % 50} {i % 3}") for i in range(60)] + [(None, "x"), ("0", None)], "chamber string, name string")
    members = spark.createDataFrame([(i, str(i % 2), f"{i % 9} Member {i}") for i in range(50)] + [(99, "0", None)], "member_id long, chamber string, name string")
    out = resolve.candidates(names, members, 3, 50.0)
    assert "levenshtein" not in out._jdf.queryExecution().optimizedPlan().toString()
    sort = lambda t: " ".join(sorted(t.split()))
    mine = [r for r in members.collect() if r["name"]]
    want = set()
    for c, t in {(r[0], r[1]) for r in names.collect() if r[0] and r[1]}:
        scored = sorted((-ratios([sort(t)], [sort(m["name"])])[0, 0], m["member_id"]) for m in mine if m["chamber"] == c)
        want |= {(c, t, m, -s, i + 1) for i, (s, m) in enumerate(scored[:3]) if -s >= 50}
    assert {tuple(r) for r in out.select("chamber", "name", "member_id", "score", "place").collect()} == want


@pytest.fixture(scope="module")
def two_rings(spark):
    """80 nodes: two rings with chords and weights, joined by one link, and a node without links."""
    pairs = {(min(a, b), max(a, b)): 1.0 + (a * b) % 3 for h in (0, 40) for i in range(40) for a, b in ((h + i, h + (i + 1) % 40), (h + i, h + i * 7 % 39)) if a != b}
    rows = [(a, b, w) for (a, b), w in (pairs | {(3, 43): 0.5}).items()]
    return spark.createDataFrame([(i,) for i in range(81)], "n long"), spark.createDataFrame(rows, "a long, b long, weight double")


def test_spectral_beyond_a_dense_matrix(two_rings):
    nodes, edges = two_rings
    vectors = lambda most: np.array([r["vector"] for r in graph.spectral(edges, nodes, "n", most_nodes=most).orderBy("n").collect()])
    dense, sparse = vectors(100), vectors(10)
    assert np.abs(dense[:80] - sparse[:80]).max() < 1e-3


def test_betweenness_of_larger_graphs_is_exact(spark, monkeypatch):
    """Components of all kinds: dense, sparse, of two nodes, linked with what is no node, over the bound, in several blocks."""
    rng = np.random.default_rng(1)
    pairs = {(int(min(p)), int(max(p))) for h in (0, 30) for p in rng.integers(h, h + 20, (60, 2)) if p[0] != p[1]}
    pairs |= {(60, 61), (70, 71), (71, 999), (71, 72)} | {(i, i + 1) for i in range(80, 110)} | {(80, 100)}
    nodes, edges = spark.range(115).toDF("n"), spark.createDataFrame(sorted(pairs) * 2 + [(5, 5)], "a long, b long")
    once = spark.createDataFrame(sorted(pairs), "a long, b long")
    exact = {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, once, "n").collect()}
    monkeypatch.setattr(graph, "sources_needed", lambda *a: 3)
    for dense, most in ((3_000, 40), (10, 60), (0, 3)):
        monkeypatch.setattr(graph, "DENSE", dense, raising=False)
        got = {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, edges, "n", most_edges=most).collect()}
        assert got == pytest.approx(exact, abs=2e-6)


def test_betweenness_by_levels_makes_no_row_per_path(two_rings, monkeypatch):
    nodes, edges = two_rings
    exact = {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, edges, "n").collect()}
    joins = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, write=graph.materialize: joins.append("Join" in df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    got = {r["n"]: r["betweenness"] for r in graph.betweenness_by_levels(nodes, edges, "n", batch=30).collect()}
    assert got == pytest.approx(exact, abs=2e-6) and not any(joins)


def test_long_walks_by_steps_are_those_of_one_machine(two_rings):
    nodes, edges = two_rings
    walk = lambda most: {tuple(r["walk_id"]): r["walk"] for r in graph.walks(edges, nodes, "n", 5, 8, most_edges=most).collect()}
    found = graph.walks(edges, nodes, "n", 5, 8, most_edges=10)
    assert walk(10) == walk(10_000)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_walks_of_components_take_no_job_per_step(spark, monkeypatch):
    """A ring of 30, a triangle, a path over the bound of edges and two nodes without any."""
    ring = [(i, (i + 1) % 30, 1 + i % 4) for i in range(30)]
    path = [(i, i + 1, 1 + i % 3) for i in range(40, 90)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in [*ring, (33, 34, 5), (34, 35, 1), (33, 35, 2), *path]], "a long, b long, weight long")
    nodes, names = spark.range(30).union(spark.range(33, 38)).union(spark.range(40, 91)).toDF("n"), []
    monkeypatch.setattr(graph, "materialize", lambda df, name, write=graph.materialize: names.append(name) or write(df, name))
    walk = lambda most: {tuple(r["walk_id"]): r["walk"] for r in graph.walks(edges, nodes, "n", 4, 9, most_edges=most).collect()}
    want = walk(1_000)
    names.clear()
    assert walk(60) == want and len(want) == 86 * 4 and "step" not in names  # every component is within the bound
    assert walk(35) == want and names.count("step") == 8  # the path is not


def test_matrix_products_hold_a_few_rows(two_rings):
    """However large the matrix is, a file has some four rows, and what reads it gets no batch of all of them."""
    nodes, edges = two_rings
    ids = np.arange(81)
    matrix = graph.adjacency(edges, ids, 1)
    held = [r[0] for r in matrix.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(held) > 30 and max(held) <= 4  # before: four times as many files as cores, here 16
    dense = np.zeros((81, 81))
    for a, b, w in edges.collect():
        dense[a, b] = dense[b, a] = w
    x = np.random.default_rng(0).standard_normal((81, 3))
    assert np.allclose(graph.times(matrix, x), dense @ x)
    values, vectors = np.linalg.eigh(dense)
    found = graph.leading(dense.__matmul__, 81, 4, most=24)  # as many vectors as the largest graphs get
    assert np.abs(np.abs((found * vectors[:, ::-1][:, :4]).sum(0)) - 1).max() < 1e-6
