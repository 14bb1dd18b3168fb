"""Bound queries over whole tables: no bound on ids or rows, shown on tables larger than any such bound."""

import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from test_oracle import duck

from rollcall.operators import graph, ml
from rollcall.plans import catalog_views
from rollcall.plans.catalog import QUERIES

assert catalog_views and duck  # one adds to the catalogue, the other is a fixture

def test_slips_and_zips_of_large_ids(spark, tmp_path):
    """More events and zips than the ids that were once read: none goes missing."""
    spark.range(6000).selectExpr("id event_id", "id % 40 user_id", "'click' event_type", "1.0D value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(700).selectExpr("id c_custkey", "cast(id % 2 as int) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(8).selectExpr("id s_suppkey", "cast(id % 2 as int) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert QUERIES["g15_slip_features"](spark, str(tmp_path)).agg({"total": "sum"}).first()[0] == 6000
    assert QUERIES["j15_zip_to_member"](spark, str(tmp_path)).count() == 700


def test_names_of_large_ids(spark, tmp_path):
    """Names from id 500 on are resolved too, and against members from there on."""
    spark.range(700).selectExpr("id c_custkey", "concat('Person#', id) c_name", "cast(id % 2 as int) c_nationkey", "'x' c_mktsegment", "0.0D c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).selectExpr("cast(id as int) n_nationkey", "cast(id as int) n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    assert {(r["member_id"], r["method"]) for r in QUERIES["e2_resolve_names"](spark, str(tmp_path)).collect()} == {(i, "exact") for i in range(700)}
    assert {r["method"]: r["n"] for r in QUERIES["g39_resolution_methods"](spark, str(tmp_path)).collect()} == {"non_member": 140, "exact": 560}


def test_clean_text_of_any_script(spark, tmp_path):
    """Against Python's white space, with every space, and line ends that . doesn't match."""
    white = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["caf\u00e9  \u201cau lait\u201d", "\u4f60\u597d\u3000\u4e16\u754c \U0001f600", "a b\u2028c\x85d", "\xa0lead\u2003\t\x0b trail\u202f", "", " \u3000 ", "zero\u200bwidth", *(f"x{w}{w}y{w}" for w in white)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["first_word"], r["n"]) for r in QUERIES["c16_clean_text"](spark, str(tmp_path)).collect()}
    clean = [" ".join(t.split()) for t in texts]
    assert got == {i: (t.split(" ")[0], len(t)) for i, t in enumerate(clean)}


def test_bill_detail_has_every_bill(spark, sf, duck):
    want = duck.execute("select o_orderkey from orders order by 1").fetchall()
    assert [(r[0],) for r in QUERIES["v5_bill_detail"](spark, sf).select("bill_id").orderBy("bill_id").collect()] == want


def test_graph_view_draws_all_members(spark, tmp_path):
    """A path of 100 members: every edge is one of its end's eight heaviest. A chair with 20 more peers keeps all its edges."""
    pairs = [(i, i + 1) for i in range(100)] + [(90, i) for i in range(20)]
    rows = [(2 * k + twice, n) for k, p in enumerate(pairs) for twice in (0, 1) for n in p]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(101).selectExpr("id s_suppkey", "0 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["a"], r["b"]) for r in QUERIES["h7_graph_view"](spark, str(tmp_path)).collect()}
    assert got == {(min(p), max(p)) for p in pairs}


def test_betweenness_counts_light_links(spark, tmp_path):
    """A path 0 - 1 - ... - 5 whose first link is heavy: the light ones carry paths too."""
    rows = [(g, n) for g, p in enumerate([(0, 1)] * 9 + [(i, i + 1) for i in range(1, 5)]) for n in p]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["s_suppkey"]: r["betweenness"] for r in QUERIES["h3_betweenness"](spark, str(tmp_path)).collect()}
    assert got == {i: round(max(2 * i * (5 - i), 0) / 30, 6) for i in range(7)}


def test_betweenness_by_counting_paths(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 14
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, n, (26, 2)) if p[0] != p[1]})
    near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in range(n)}
    want = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        level, seen = [[s]], {s}
        while level:  # all shortest paths from s, listed
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in seen]
            seen |= {p[-1] for p in level}
            for p in level:
                for v in p[1:-1]:
                    want[v] += 1 / sum(q[-1] == p[-1] for q in level)
    nodes = spark.range(n).toDF("n")
    got = {r["n"]: r["betweenness"] for r in graph.betweenness(nodes, spark.createDataFrame(pairs, "a long, b long"), "n").collect()}
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in want.items()}, abs=1e-6)


def test_walks_are_those_by_joins(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 1), ("a", "c", 2), ("c", "d", 9)], "a string, b string, weight long")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "n string")
    sets = [{(r["walk_id"]["at"], r["walk_id"]["k"], tuple(r["walk"])) for r in graph.walks(edges, nodes, "n", 6, 5, most_edges=m).collect()} for m in (9, 3)]
    assert sets[0] == sets[1] and len(sets[0]) == 30
    assert {len(w) for at, _, w in sets[0] if at != "e"} == {5} and {w for at, _, w in sets[0] if at == "e"} == {("e",)}


def test_node_vectors_of_reference_size(spark, sf):
    vectors = [r["vector"] for r in QUERIES["h5_node_vectors"](spark, sf).collect()]
    assert {len(v) for v in vectors} == {64} and all(any(v) for v in vectors)


@pytest.fixture(scope="module")
def labelled(spark):
    """One row in ten is 1; two features must agree for it, which trees see and a line doesn't."""
    rows = [(i, float(i % 10 == 0), float(i % 2 if i % 10 else k), float((i % 3 > 0) ^ (i % 2) if i % 10 else k)) for i in range(300) for k in [i // 10 % 2]]
    return ml.assemble(spark.createDataFrame(rows, "id long, label double, x double, y double"), ["x", "y"]).drop("x", "y")


def test_comparison_has_all_models_folds_and_weights(labelled, monkeypatch):
    seen = []
    for kind in {type(m) for m in ml.models("label").values()}:
        monkeypatch.setattr(kind, "fit", lambda self, rows, *a, f=kind.fit: (seen.append((type(self).__name__, self.getWeightCol(), {(r["label"], round(r["weight"], 6)) for r in rows.select("label", "weight").distinct().collect()})), f(self, rows, *a))[1])
    found = ml.compare(labelled, "label", "id")
    assert set(found) == {"boosting", "forest", "logistic", "stumps"} and all(0 <= x <= 1 for x in found.values())
    assert len(seen) == 20 and {x[1] for x in seen} == {"weight"} and all(x[2] == {(0.0, 0.555556), (1.0, 5.0)} for x in seen)


def test_tuned_depth_is_the_best_of_the_grid(labelled, monkeypatch):
    areas = {2: 0.6, 3: 0.9, 4: 0.7}
    monkeypatch.setattr(ml, "compare", lambda df, label, key, n, candidates: {"m": areas[candidates["m"].getMaxDepth()]})
    assert ml.tune(labelled, "label", "id") == (3, 0.9)


def boosted_by_hand(rows, rounds):
    """Adaptive boosting with the best single cut of all, on (x, y, label, weight) rows."""
    w, cuts = [r[3] for r in rows], []
    for _ in range(rounds):
        tried = []
        for c in (0, 1):
            for t in {r[c] for r in rows}:
                for low in (0, 1):
                    tried.append((sum(v for r, v in zip(rows, w) if (low if r[c] <= t else 1 - low) != r[2]) / sum(w), c, t, low))
        wrong, c, t, low = min(tried)
        if wrong >= 0.5:
            break
        vote = math.log((1 - wrong) / max(wrong, 1e-10))
        cuts.append((c, t, low, vote))
        if wrong == 0:
            break
        w = [v * (math.exp(vote) if (low if r[c] <= t else 1 - low) != r[2] else 1) for r, v in zip(rows, w)]
    total = sum(x[3] for x in cuts)
    return [sum(v * (2 * (low if r[c] <= t else 1 - low) - 1) for c, t, low, v in cuts) / total for r in rows]


def test_boosted_stumps_against_all_cuts(spark):
    rows = [(float(i % 7), float(i * 5 % 11), float((i % 7 > 3) != (i % 13 == 0)), 1.0 + (i % 3)) for i in range(200)]
    df = ml.assemble(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x double, y double, label double, v double"), ["x", "y"])
    fitted = ml.Stumps("label", "v", 1).fit(df)
    got = [r["s"] for r in fitted.transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1].alias("s")).collect()]
    assert got == pytest.approx(boosted_by_hand(rows, 1))
    area = BinaryClassificationEvaluator(labelCol="label")
    assert area.evaluate(ml.Stumps("label", "v", 12).fit(df).transform(df)) >= area.evaluate(fitted.transform(df))
    none = ml.Stumps("label").fit(df.limit(0)).transform(df).first()
    assert none["prediction"] == 0 and list(none["probability"]) == [0.5, 0.5]
    sure = ml.Stumps("x1").fit(df.withColumn("x1", (F.col("x") > 2).cast("double")))
    assert len(sure.trees) == 1


def test_random_search_draws_different_settings(labelled, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "compare", lambda df, label, key, n, candidates: (seen.append(candidates["m"]), {"m": 0.5 + 0.01 * (len(seen) == 7)})[1])
    setting, area = ml.random_search(labelled, "label", "id", "boosting")
    made = {tuple(m.getOrDefault(p) for p in ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode")) for m in seen}
    assert len(seen) == 20 and len(made) == 20 and area == 0.51
    assert tuple(setting.values()) == tuple(seen[6].getOrDefault(p) for p in setting)
    for kind, count in (("logistic", 10), ("forest", 20), ("stumps", 20)):
        seen.clear()
        ml.random_search(labelled, "label", "id", kind)
        assert len(seen) == count
    assert {m.weight for m in seen} == {"weight"} and len({(m.rounds, m.rate) for m in seen}) == 20


def test_random_search_fits(labelled):
    setting, area = ml.random_search(labelled, "label", "id", "forest", tries=2, n=2, space={"numTrees": [3, 5], "maxDepth": [None, 2]})
    assert set(setting) == {"numTrees", "maxDepth"} and 0.5 < area <= 1


def test_model_queries(spark, sf):
    assert {r["model"] for r in QUERIES["m6_model_comparison"](spark, sf).collect()} == {"boosting", "forest", "logistic", "stumps"}
    best = QUERIES["m7_tuned_depth"](spark, sf).collect()
    assert len(best) == 1 and best[0]["depth"] in (2, 3, 4)
