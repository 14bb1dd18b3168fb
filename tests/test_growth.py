"""Steps whose shuffles or passes grew faster than the input."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from rollcall.operators import graph, linkage, ml
from rollcall.plans import catalog, views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_linkage_sends_no_vector_to_each_pair_of_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0 + i % 7, float(i % 11), i / 5]) for i in range(90)], "id long, v array<double>")
    plans = []
    monkeypatch.setattr(linkage, "materialize", lambda df, name, write=linkage.materialize: plans.append(plan(df)) or write(df, name))
    got = {(r["kept"], r["gone"]): r["sim"] for r in linkage.average_linkage(df, "id", "v", 20, 10).collect()}
    assert plans and not any("explode" in p for p in plans)
    assert got == {(r["kept"], r["gone"]): r["sim"] for r in linkage.average_linkage(df, "id", "v").collect()}


def test_board_and_ridge_are_made_once(spark, sf):
    tables = lambda df: plan(df).count("Relation ")
    b = catalog.board(spark, sf)
    assert tables(b) <= 2 and "Generate" not in plan(b)  # the written rows and their maximum, no table of the input
    value = ml.ridge_leave_one_out(b.select("member_id", "magnet", "bridge", "law_rate"), "member_id", ["magnet", "bridge"], "law_rate")
    assert tables(value) == 1
    profiles = b.select("member_id", "score", F.col("centrality").alias("betweenness"))
    pivots = profiles.select("member_id", F.lit(0.5).alias("pivotal_rate"), F.lit(1).alias("swing"))
    pull = profiles.select("member_id", F.col("score").alias("pull"), F.lit(0.1).alias("sponsor_lift"))
    assert "Join LeftOuter" not in plan(views.influence(profiles, pivots, pull))


def test_pairs_and_degrees_read_their_rows_once(spark):
    rows = spark.createDataFrame([(g, n) for g in range(9) for n in range(g)] + [(None, 1), (None, 2), (3, None), (1, 0)], "g long, n long")
    pairs = graph.pair_counts(rows, "g", "n")
    want = {(a, b): sum(b < g for g in range(9)) for b in range(8) for a in range(b)}
    assert {(r["a"], r["b"]): r["weight"] for r in pairs.collect()} == want
    assert plan(pairs).count("Join") == 1
    nodes = spark.createDataFrame([(n,) for n in range(10)], "n long")
    out = graph.degree_centrality(nodes, pairs, "n")
    assert {r["n"]: r["degree"] for r in out.collect()} == {n: 7 if n < 8 else 0 for n in range(10)}
    assert "Union" not in plan(out)


def test_tfidf_counts_only_terms_that_may_be_chosen(spark, monkeypatch):
    texts = [" ".join([f"rare{i}x{j}" for j in range(60)] + ["often"] * (i % 4) + ["common"] * 3 + ["now", "then"][: i % 3]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, t string")
    written = {}
    monkeypatch.setattr(ml, "materialize", lambda df, name, write=ml.materialize: written.setdefault(name, []).append(write(df, name)) or written[name][-1])
    rows = lambda **more: {(r["id"], r["term"]): r["weight"] for r in ml.tfidf(df, "id", "t", 3, **more).collect()}
    found = rows(max_df=1.0)
    assert written["terms"][0].count() < 400  # of some 5,000
    counts = [(r["id"], r["term"], r["n"]) for r in ml.term_counts(df, "id", "t").collect()]
    for most, got in ((1.0, found), (0.8, rows()), (1.0, rows(max_df=1.0, bins=2)), (0.8, rows(bins=50))):
        docs, total = {}, {}
        for _, t, n in counts:
            docs[t], total[t] = docs.get(t, 0) + 1, total.get(t, 0) + n
        chosen = sorted((t for t in docs if 3 <= docs[t] <= most * 41), key=lambda t: (-total[t], t))[:3]
        w = {(i, t): n * (np.log(42 / (1 + docs[t])) + 1) for i, t, n in counts if t in chosen}
        assert got == pytest.approx({(i, t): x / np.sqrt(sum(y * y for (j, _), y in w.items() if j == i)) for (i, t), x in w.items()})


def test_tasks_hold_a_fixed_share_of_pairs_and_bills(spark, sf):
    t = spark.createDataFrame([(m, b) for m in range(6) for b in range(m, 9)] * 2, "member_id long, bill_id long")
    near = spark.createDataFrame([(0, 1), (3, 2), (5, 9)], "member_id long, other_id long")
    out = graph.affinity(t, near)
    assert {(r["member_id"], r["other_id"]): r["affinity"] for r in out.collect()} == {(0, 1): pytest.approx(8 / 9), (3, 2): 1.0, (5, 9): 0.0}
    for df in (out, catalog.QUERIES["g2_committee_stats"](spark, sf)):
        assert "RepartitionByExpression" in plan(df)


def test_folds_are_fitted_side_by_side_in_tasks_by_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i * 7 % 10 < 3), float(i % 13), float(i * i % 17)) for i in range(400)], "id long, label double, x double, y double")
    rows = ml.assemble(rows, ["x", "y"]).repartition(30)
    model = ml.models("label", depth=2, rounds=2, weight="weight")["boosting"]
    data, judge = ml.folds(ml.class_weights(rows.coalesce(1), "label"), "label", "id"), BinaryClassificationEvaluator(labelCol="label")
    want = np.mean([judge.evaluate(model.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))) for k in range(5)])
    seen, met = [], threading.Barrier(5)

    def fit(self, df, *a, real=GBTClassifier.fit):
        met.wait(60)  # all five folds at once
        seen.append(df.rdd.getNumPartitions())
        return real(self, df, *a)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    for per_task, tasks in ((50_000, 1), (150, 3)):
        seen.clear()
        assert ml.compare(rows, "label", "id", candidates={"m": model}, per_task=per_task)["m"] == pytest.approx(want, abs=1e-9)
        assert seen == [tasks] * 5


def test_training_figures_by_matches_alone(spark, tmp_path, monkeypatch):
    texts = ["", None, "A#b $ C", "caf\u00e9 \u00c9 \U0001f600|\U0001f600!", "no\nsign\t here ", "ABC&%*"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    plans = []
    monkeypatch.setattr(catalog, "materialize", lambda df, name, write=catalog.materialize: plans.append(plan(df)) or write(df, name))
    got = {r["doc_id"]: (r["symbols"], r["capitals"]) for r in catalog._training(spark, str(tmp_path)).collect()}
    share = lambda t, of: None if t is None else sum(c in of for c in t) / max(len(t), 1)
    assert got == {i: (share(t, "#*$%&|!"), share(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for i, t in enumerate(texts)}
    assert "regexp_replace" not in plans[0]  # which copies a text, match by match
