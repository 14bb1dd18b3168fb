"""Explanations of tree models: Shapley values of every feature for every row, and what each does to the probability.

A model's trees are read from its saved nodes and turned into paths, one per leaf: the features it tests, the interval that
each of them has to lie in, the share of the training rows that each interval keeps, and the leaf's value. For one path the
Shapley value of a feature depends on nothing but which of its intervals hold the row, so each pattern of intervals that
occurs is worked out once, by subset weights over the path, and looked up for all rows that show it. Paths are bounded by the
model and go to the tasks; rows are scored in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import work_path

#: Paths of at most so many features have a table of all their patterns.
TABLE = 10


@dataclass
class Path:
    """One leaf. A feature's value has to be above low (null and NaN count as above everything) and at most high."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float
    table: np.ndarray | None = None

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """For each row which intervals hold it, as bits."""
        out = np.zeros(len(x), np.int64)
        for j, f in enumerate(self.features.tolist()):
            v = x[:, f]
            inside = (~(v <= self.low[j]) | np.isneginf(self.low[j])) & ((v <= self.high[j]) | np.isposinf(self.high[j]))
            out |= inside.astype(np.int64) << j
        return out

    def effects(self, patterns: np.ndarray) -> np.ndarray:
        """The Shapley values of the path's features for each pattern.

        With o = 1 where an interval holds and z its share, a coalition S keeps prod(o in S) prod(z elsewhere) of the leaf's
        value; by sizes of S these are the coefficients of prod(z + o t) over the other features.
        """
        m = len(self.features)
        held = (patterns[:, None] >> np.arange(m)) & 1
        weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        out = np.empty((len(patterns), m))
        for i in range(m):
            sizes = np.zeros((len(patterns), m))
            sizes[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    more = sizes[:, :-1] * held[:, j : j + 1]
                    sizes *= self.share[j]
                    sizes[:, 1:] += more
            out[:, i] = (sizes @ weight) * (held[:, i] - self.share[i]) * self.value
        return out

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds the path's effects on rows x to out."""
        if not len(self.features):
            return
        shown = self.patterns(x)
        if len(self.features) <= TABLE:
            if self.table is None:
                self.table = self.effects(np.arange(1 << len(self.features)))
            found = self.table[shown]
        else:
            kinds, back = np.unique(shown, return_inverse=True)
            found = self.effects(kinds)[back]
        out[:, self.features] += found


class Explainer:
    """The paths of a fitted model. margin is what the effects add up to, together with base: the log-odds of boosted trees
    (logit), else the probability itself."""

    def __init__(self, paths: list[Path], n_features: int, logit: bool, shift: float = 0.0):
        self.paths, self.n_features, self.logit = paths, n_features, logit
        self.base = shift + sum(p.value * float(np.prod(p.share)) for p in paths)

    @classmethod
    def of(cls, spark: SparkSession, model) -> Explainer:
        """From a boosted, forest or single tree classifier of two classes, or a pipeline that ends in one. Trees that split
        by categories, and models of other kinds, are refused."""
        if isinstance(model, PipelineModel):
            return cls.of(spark, model.stages[-1])
        if not isinstance(model, GBTClassificationModel | RandomForestClassificationModel | DecisionTreeClassificationModel):
            raise TypeError(f"no trees to explain in {type(model).__name__}")
        path = work_path(spark, "explained-model")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data")
        if "nodeData" in nodes.columns:
            nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
        else:
            nodes = nodes.withColumn("tree", F.lit(0))
        boosted = isinstance(model, GBTClassificationModel)
        weights = model.treeWeights if hasattr(model, "treeWeights") else [1.0]
        scale = [2 * w for w in weights] if boosted else [1 / len(weights)] * len(weights)  # a boosted score is half the log-odds
        trees: dict[int, dict] = {}
        for r in nodes.collect():  # as many as the model has
            trees.setdefault(r["tree"], {})[r["id"]] = r
        paths: list[Path] = []
        for t, tree in sorted(trees.items()):
            paths += _paths(tree, scale[t], boosted)
        return cls(paths, model.numFeatures, boosted)

    def values(self, x: np.ndarray) -> np.ndarray:
        """One Shapley value per row and feature."""
        out = np.zeros((len(x), self.n_features))
        for p in self.paths:
            p.add(x, out)
        return out


def _paths(tree: dict, scale: float, boosted: bool) -> list[Path]:
    """The paths of one tree, whose nodes are rows by id, 0 the root."""

    def cover(node) -> float:
        return float(node["impurityStats"][0] if boosted else sum(node["impurityStats"]))

    def value(node) -> float:
        return scale * float(node["prediction"] if boosted else node["impurityStats"][1] / max(cover(node), 1e-300))

    out: list[Path] = []
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while todo:
        at, tests = todo.pop()
        node = tree[at]
        if node["leftChild"] < 0:
            names = sorted(tests)
            low, high, share = (np.array([tests[f][k] for f in names], np.float64) for k in range(3))
            out.append(Path(np.array(names, np.int64), low, high, share, value(node)))
            continue
        split = node["split"]
        if split["numCategories"] != -1:
            raise ValueError("a tree splits by categories")
        f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        low, high, share = tests.get(f, (-np.inf, np.inf, 1.0))
        whole = max(cover(node), 1e-300)
        for child, a, b in ((node["leftChild"], low, min(high, cut)), (node["rightChild"], max(low, cut), high)):
            todo.append((child, tests | {f: (a, b, share * cover(tree[child]) / whole)}))
    return out


def explain(df: DataFrame, model, key: str, features: str = "features") -> DataFrame:
    """(key, base, margin, effects): per row one Shapley value per feature, in the order of the vector, which add up to
    margin - base. base is the expected margin over the training rows, as the trees' covers tell it.

    Rows without a vector have null effects and margin; NaN goes right at every split, as in the model.
    """
    spark = df.sparkSession
    made = Explainer.of(spark, model)
    shared = spark.sparkContext.broadcast(made)
    rows = df.select(F.col(key), F.when(F.col(features).isNotNull(), vector_to_array(features)).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e: Explainer = shared.value
        for batch in batches:
            given = batch.column("__x").to_pylist()
            some = [i for i, v in enumerate(given) if v is not None]
            x = np.array([[np.nan if c is None else c for c in given[i]] for i in some], np.float64).reshape(len(some), e.n_features)
            found = e.values(x)
            effects: list = [None] * len(given)
            margin: list = [None] * len(given)
            for i, row in zip(some, found, strict=True):
                effects[i], margin[i] = row.tolist(), e.base + float(row.sum())
            columns = [batch.column(key), pa.array([e.base] * len(given), pa.float64()), pa.array(margin, pa.float64()), pa.array(effects, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "base", "margin", "effects"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, base double, margin double, effects array<double>")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def impacts(explained: DataFrame, key: str, names: list[str], prefixes: tuple[str, ...] = (), logit: bool = True) -> DataFrame:
    """(key, base_prob, prob, impacts: array of feature and impact): each effect as a step of the probability,
    p - sigmoid(margin - effect); for models whose margin is a probability the effect itself. Features that begin with one of
    prefixes (columns made from one category) are added up under the prefix without its last underscore; these come first,
    in the order of prefixes."""
    link = sigmoid if logit else (lambda x: x)
    p = link(F.col("margin"))
    steps = F.transform("effects", lambda e: p - link(F.col("margin") - e)) if logit else F.col("effects")
    grouped: dict[str, list[int]] = {}
    for prefix in prefixes:
        if own := [i for i, n in enumerate(names) if n.startswith(prefix)]:
            grouped[prefix.rstrip("_")] = own
    taken = {i for own in grouped.values() for i in own}
    grouped |= {n: [i] for i, n in enumerate(names) if i not in taken}
    total = lambda own: F.aggregate(F.array(*(F.element_at("__s", i + 1) for i in own)), F.lit(0.0), lambda a, b: a + b)
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), total(own).alias("impact")) for n, own in grouped.items()))
    rows = explained.withColumn("__s", steps)
    return rows.select(key, link(F.col("base")).alias("base_prob"), p.alias("prob"), F.when(F.col("__s").isNotNull(), cells).alias("impacts"))


def factors(impacted: DataFrame, key: str, top: int = 3) -> DataFrame:
    """(key, direction, place, feature, impact): per row the features that raise its probability most ('up') and that lower
    it most ('down'), top of each; equal ones in order of their place. Rows without effects give none."""
    placed = F.transform("impacts", lambda x, i: F.struct((-F.abs(x["impact"])).alias("less"), i.alias("i"), x["feature"].alias("feature"), x["impact"].alias("impact")))
    part = lambda keep, name: F.transform(F.slice(F.array_sort(F.filter(placed, keep)), 1, top), lambda x, i: F.struct(F.lit(name).alias("direction"), (i + 1).alias("place"), x["feature"].alias("feature"), x["impact"].alias("impact")))
    both = F.concat(part(lambda x: x["impact"] > 0, "up"), part(lambda x: x["impact"] < 0, "down"))
    return impacted.select(key, F.explode(both).alias("x")).select(key, "x.*")
