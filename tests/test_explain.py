"""Tree explanations against sums over all subsets of features."""

from itertools import combinations
from math import exp, factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rollcall.operators import explain

NAMES = ["kind_a", "kind_b", "size", "age"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((400, 4)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.8) ^ (rng.random(400) < 0.1)).astype(float)
    rows = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, kind_a double, kind_b double, size double, age double, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).cache()


def tree_value(e, x, known):
    """What the trees expect of a row of which only some features are known: elsewhere both children by their covers."""
    total = 0.0
    for p in e.paths:
        part = p.value
        for j, f in enumerate(p.features.tolist()):
            if f in known:
                part *= float(not x[f] <= p.low[j] and (x[f] <= p.high[j] or p.high[j] == np.inf))
            else:
                part *= p.share[j]
        total += part
    return total


MODELS = {
    "boosting": lambda: GBTClassifier(maxIter=8, maxDepth=4, seed=1),
    "weighted": lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1, weightCol="w"),
    "forest": lambda: RandomForestClassifier(numTrees=5, maxDepth=6, seed=1),
    "tree": lambda: DecisionTreeClassifier(maxDepth=5),
}


@pytest.mark.parametrize("kind", sorted(MODELS))
def test_effects_add_up_and_equal_subset_sums(spark, data, kind):
    rows = data.withColumn("w", 1 + F.col("id") % 3)
    model = MODELS[kind]().fit(rows)
    found = explain.explain(rows, model, "id")
    p = vector_to_array("probability")[1]
    scored = found.join(model.transform(rows).select("id", p.alias("p"), "features"), "id").orderBy("id").collect()
    assert len(scored) == 400
    for r in scored:  # on every row
        assert r["margin"] == pytest.approx(r["base"] + sum(r["effects"]), abs=1e-9)
        prob = 1 / (1 + exp(-r["margin"])) if kind in ("boosting", "weighted") else r["margin"]
        assert prob == pytest.approx(r["p"], abs=1e-9)
    e = explain.Explainer.of(spark, model)
    for r in scored[:6]:
        x = r["features"].toArray()
        worth = {s: tree_value(e, x, set(s)) for k in range(5) for s in combinations(range(4), k)}
        assert r["base"] == pytest.approx(worth[()], abs=1e-9)
        for i in range(4):
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (worth[tuple(sorted((*s, i)))] - worth[s]) for s in worth if i not in s)
            assert r["effects"][i] == pytest.approx(want, abs=1e-9)


def test_paths_longer_than_the_table():
    """Patterns that occur are worked out one by one where a path tests many features, with the same result."""
    rng = np.random.default_rng(0)
    m = explain.TABLE + 2
    p = explain.Path(np.arange(m), np.full(m, -np.inf), np.full(m, 0.5), rng.random(m), 3.0)
    x = rng.random((50, m))
    out = np.zeros((50, m))
    p.add(x, out)
    shown = p.patterns(x)
    assert np.allclose(out, p.effects(np.arange(1 << m))[shown])
    assert np.allclose(out.sum(1), 3.0 * (shown == (1 << m) - 1) - 3.0 * np.prod(p.share))


def test_odd_rows(spark, data):
    """NaN goes right as in the model, rows without a vector have no effects, other columns do no harm."""
    model = GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(data)
    rows = spark.createDataFrame([(1, 0.5, float("nan"), 0.2, 0.1), (2, float("inf"), float("-inf"), 0.0, -0.0)], "id long, kind_a double, kind_b double, size double, age double")
    rows = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(rows)
    rows = rows.unionByName(spark.createDataFrame([(3, None)], rows.select("id", "features").schema), allowMissingColumns=True).withColumn("margin", F.lit("x")).withColumn("effects", F.lit(1))
    got = {r["id"]: r for r in explain.explain(rows, model, "id").collect()}
    want = {r["id"]: r["p"] for r in model.transform(rows.where("id < 3")).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    for i in (1, 2):
        assert 1 / (1 + exp(-got[i]["margin"])) == pytest.approx(want[i])
    assert got[3]["effects"] is None and got[3]["margin"] is None
    listed = explain.factors(explain.impacts(explain.explain(rows, model, "id"), "id", NAMES), "id")
    assert {r["id"] for r in listed.collect()} == {1, 2}
    assert explain.explain(rows.limit(0), model, "id").count() == 0
    with pytest.raises(TypeError):
        explain.explain(data, LogisticRegression().fit(data), "id")


def test_pipelines_are_unwrapped(spark, data):
    model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="f2"), GBTClassifier(maxIter=2, maxDepth=2, featuresCol="f2", seed=1)]).fit(data)
    assert explain.Explainer.of(spark, model).n_features == 4


def test_impacts_are_steps_of_the_probability(spark):
    """Categories are added up, factors are ranked by size, at most so many each way."""
    rows = spark.createDataFrame([(1, 0.1, 0.4, [0.5, -0.3, 0.2, -0.1]), (2, 0.1, 0.1, [0.0, 0.0, 0.0, 0.0])], "id long, base double, margin double, effects array<double>")
    got = explain.impacts(rows, "id", NAMES, ("kind_", "none_"))
    one = got.where("id = 1").first()
    sig = lambda z: 1 / (1 + exp(-z))
    step = lambda e: sig(0.4) - sig(0.4 - e)
    assert one["base_prob"] == pytest.approx(sig(0.1)) and one["prob"] == pytest.approx(sig(0.4))
    assert [x["feature"] for x in one["impacts"]] == ["kind", "size", "age"]
    assert [x["impact"] for x in one["impacts"]] == pytest.approx([step(0.5) + step(-0.3), step(0.2), step(-0.1)])
    listed = [tuple(r)[:4] for r in explain.factors(got, "id").orderBy("id", "direction", "place").collect()]
    order = sorted([("kind", step(0.5) + step(-0.3)), ("size", step(0.2))], key=lambda x: -x[1])
    assert listed == [(1, "down", 1, "age"), *((1, "up", k + 1, n) for k, (n, _) in enumerate(order))]
    assert [r["feature"] for r in explain.factors(got, "id", 1).where("direction = 'up'").collect()] == [order[0][0]]
    plain = explain.impacts(rows, "id", NAMES, logit=False).first()
    assert [x["impact"] for x in plain["impacts"]] == [0.5, -0.3, 0.2, -0.1]
