"""Models: text vectors, classifiers with cross-validation and calibration, ridge, clusters and anomalies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..sources.scratch import discard, materialize
from .metrics import share
from .ranges import group_quantiles


def terms(df: DataFrame, key: str, text: str, grams: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(key, term) for each place: words without stop words, and their pairs."""
    words = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2).transform(df.fillna("", [text]))
    words = StopWordsRemover(inputCol="__w", outputCol="__s").transform(words)
    cols = []
    for n in grams:
        words = NGram(n=n, inputCol="__s", outputCol=f"__g{n}").transform(words)
        cols.append(F.col(f"__g{n}"))
    return words.select(key, F.explode(F.concat(*cols)).alias("term"))


def term_counts(df: DataFrame, key: str, text: str, grams: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(key, term, n): words without stop words, and their pairs."""
    return terms(df, key, text, grams).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf(df: DataFrame, key: str, text: str, features: int = 500, min_df: int = 3, max_df: float = 0.8, sublinear: bool = False, bins: int = 1 << 20) -> DataFrame:
    """(key, term, weight): smoothed inverse frequencies ln((1 + n) / (1 + df)) + 1, rows of length one; the terms are the
    most frequent of those in at least min_df documents and at most a share max_df of them.

    Places are counted by hash of their term first, in bins. A term is as frequent as its bin at most, so only terms of the
    fullest bins are counted by document; once these hold enough terms more frequent than any other bin, no other term can be
    among the chosen, else more bins are taken, all in the end.
    """
    places = terms(df, key, text)
    bin_of = F.pmod(F.xxhash64("term"), F.lit(bins))
    full = materialize(places.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("most")), "bins")
    n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("__n"))
    taken = 2 * features
    while True:
        first = full.orderBy(F.desc("most"), "bin").limit(taken + 1).collect()
        some = df.sparkSession.createDataFrame([(r["bin"],) for r in first[:taken]], "__bin long")
        counts = places.withColumn("__bin", bin_of).join(F.broadcast(some), "__bin").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts, "terms")
        per = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("__n")))
        chosen = per.orderBy(F.desc("total"), "term").limit(features).select("term", "total", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))
        chosen = materialize(chosen, "chosen")
        if len(first) <= taken:
            break
        found = chosen.agg(F.count(F.lit(1)), F.min("total")).first()
        if found[0] == features and found[1] > first[taken]["most"]:
            break
        discard(counts, chosen)
        taken *= 8
    tf = F.col("n").cast("double") if not sublinear else 1 + F.log("n")
    rows = counts.join(F.broadcast(chosen.drop("total")), "term").withColumn("w", tf * F.col("idf"))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def folds(df: DataFrame, label: str, key: str, n: int = 5) -> DataFrame:
    """Stratified folds by a hash of the key: no order over the table is needed."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.col(label).cast("int")), F.lit(n)).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c")).withColumn("__t", F.sum("__c").over(Window.partitionBy()))
    return df.join(F.broadcast(n), label).withColumn("weight", F.col("__t") / (2 * F.col("__c"))).drop("__c", "__t")


class Stumps:
    """Discrete adaptive boosting of small trees: each is fitted with the rows that the ones before it got wrong weighing
    more, and votes by the logarithm of its odds of being right. Every round is one distributed fit and one sum."""

    def __init__(self, label: str, weight: str | None = None, rounds: int = 10, rate: float = 1.0, depth: int = 1):
        self.label, self.weight, self.rounds, self.rate, self.depth = label, weight, rounds, rate, depth

    def getWeightCol(self) -> str | None:
        return self.weight

    def fit(self, df: DataFrame) -> Votes:
        """Fitting ends early when a tree is right on all rows, or no better than chance. Rows without any weight give no
        tree, and then every score is even."""
        rows = df.withColumn("__w", F.col(self.weight).cast("double") if self.weight else F.lit(1.0))
        trees: list[tuple] = []
        while len(trees) < self.rounds:
            said = f"__said{len(trees)}"
            maker = DecisionTreeClassifier(maxDepth=self.depth, labelCol=self.label, featuresCol="features", weightCol="__w", predictionCol=said, rawPredictionCol="", probabilityCol="", seed=1)
            if not trees and rows.isEmpty():
                break
            tree = maker.fit(rows)
            judged = tree.transform(rows)
            missed = (F.col(said) != F.col(self.label)).cast("double")
            wrong = judged.agg(F.sum(missed * F.col("__w")) / F.sum("__w")).first()[0]
            if wrong is None or wrong >= 0.5:
                break
            vote = self.rate * float(np.log((1 - wrong) / max(wrong, 1e-10)))
            trees.append((tree, said, vote))
            if wrong == 0:
                break
            rows = judged.withColumn("__w", F.col("__w") * F.exp(F.lit(vote) * missed)).drop(said)
        return Votes(trees)


class Votes:
    """Fitted trees with their votes. rawPrediction holds the sum of votes for 0 and 1, of -1 to 1, probability its sigmoid."""

    def __init__(self, trees: list[tuple]):
        self.trees = trees

    def transform(self, df: DataFrame) -> DataFrame:
        total = sum(vote for *_, vote in self.trees) or 1.0
        side = F.lit(0.0)
        for tree, said, vote in self.trees:
            df = tree.transform(df)
            side = side + F.lit(vote / total) * (2 * F.col(said) - 1)
        df = df.withColumn("__side", side).drop(*(said for _, said, _ in self.trees))
        one = 1 / (1 + F.exp(-F.col("__side")))
        out = df.withColumn("rawPrediction", array_to_vector(F.array(-F.col("__side"), F.col("__side")))).withColumn("probability", array_to_vector(F.array(1 - one, one)))
        return out.withColumn("prediction", (F.col("__side") > 0).cast("double")).drop("__side")


def models(label: str, depth: int = 3, rounds: int = 10, weight: str | None = None) -> dict:
    common = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    return {
        "boosting": GBTClassifier(maxDepth=depth, maxIter=rounds, seed=1, **common),
        "forest": RandomForestClassifier(maxDepth=depth + 2, numTrees=20, seed=1, **common),
        "logistic": LogisticRegression(maxIter=50, regParam=0.01, **common),
        "stumps": Stumps(label, weight, rounds),
    }


#: Values that a search may take by kind of model (fixed values). A strength C is the inverse of regParam times rows; None
#: stands for the deepest tree that Spark grows, 30.
SPACES = {
    "boosting": {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.8, 1.0], "minInstancesPerNode": [5, 10]},
    "forest": {"numTrees": [100, 200, 300, 500], "maxDepth": [5, 10, 15, 20, None], "minInstancesPerNode": [2, 5, 10], "featureSubsetStrategy": ["sqrt", "log2", "0.3"]},
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "elasticNetParam": [1.0, 0.0]},
    "stumps": {"rounds": [50, 100, 150, 200, 300], "rate": [0.01, 0.05, 0.1, 0.5, 1.0]},
}


def with_setting(kind: str, label: str, setting: dict, n_rows: int, weight: str = "weight"):
    """A model of this kind with the values of one setting."""
    if kind == "stumps":
        return Stumps(label, weight, **setting)
    values = {k: v for k, v in setting.items() if k != "C"}
    if "C" in setting:
        values["regParam"] = 1 / (setting["C"] * max(n_rows, 1))
    if values.get("maxDepth", 0) is None:
        values["maxDepth"] = 30
    return models(label, weight=weight)[kind].copy().setParams(**values)


def random_search(df: DataFrame, label: str, key: str, kind: str, tries: int = 20, n: int = 5, seed: int = 42, space: dict | None = None) -> tuple[dict, float]:
    """The setting with the best cross-validated area of up to `tries` different ones drawn from a space (by default that
    of the kind of model), and that area; of equal ones the first drawn."""
    space = space or SPACES[kind]
    every = list(product(*space.values()))
    drawn = np.random.default_rng(seed).permutation(len(every))[:tries]
    n_rows = df.count() if "C" in space else 0
    best: tuple[dict, float] | None = None
    for i in drawn:
        setting = dict(zip(space, every[i], strict=True))
        area = compare(df, label, key, n, {"m": with_setting(kind, label, setting, n_rows)})["m"]
        if best is None or area > best[1]:
            best = setting, area
    return best


def compare(df: DataFrame, label: str, key: str, n: int = 5, candidates: dict | None = None, per_task: int = 50_000) -> dict[str, float]:
    """The mean area under the curve of each model over stratified folds. Both classes weigh the same in fitting.

    Fits take hundreds of short passes, so rows are dealt by key to a task per `per_task` of them, however many files they
    come from, and the folds of a model are fitted side by side.
    """
    tasks = -(-df.count() // per_task) or 1
    data = folds(class_weights(df, label), label, key, n).repartition(tasks, key).sortWithinPartitions(key).persist()
    data.count()  # kept before several fits ask for it at once
    judge = BinaryClassificationEvaluator(labelCol=label)
    out = {}
    with ThreadPool(n) as pool:
        for name, model in (candidates or models(label, weight="weight")).items():

            @inheritable_thread_target(df.sparkSession)
            def score(k: int, model=model) -> float:
                return judge.evaluate(model.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)))

            out[name] = float(np.mean(pool.map(score, range(n))))
    data.unpersist()
    return out


def tune(df: DataFrame, label: str, key: str, n: int = 5) -> tuple[int, float]:
    """The tree depth with the best cross-validated area, of a small grid."""
    found = {d: compare(df, label, key, n, {"m": models(label, depth=d, weight="weight")["boosting"]})["m"] for d in (2, 3, 4)}
    best = max(found, key=found.get)
    return best, found[best]


def out_of_fold(df: DataFrame, label: str, key: str, model, n: int = 5) -> DataFrame:
    """Each row's probability by a model that didn't see it."""
    data = folds(df, label, key, n)
    parts = [model.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)) for k in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("prob", vector_to_array("probability")[1]).select(key, label, "prob")


def calibrate(scored: DataFrame, label: str):
    """An isotonic map of out-of-fold probabilities to frequencies."""
    rows = scored.select(F.col("prob").alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows.withColumn("features", array_to_vector(F.array("features"))))


def evaluate(df: DataFrame, label: str, prob: str, threshold: float = 0.5) -> dict[str, float]:
    """Area, accuracy, precision, recall and F1."""
    from .metrics import confusion

    raw = df.withColumn("rawPrediction", array_to_vector(F.array(1 - F.col(prob), F.col(prob))))
    area = BinaryClassificationEvaluator(labelCol=label).evaluate(raw)
    row = confusion(df.withColumn("__p", (F.col(prob) >= threshold).cast("int")), label, "__p").first()
    return {"auc": area, **{k: float(row[k]) for k in ("accuracy", "precision", "recall", "f1")}}


def importances(model, names: list[str], top: int = 15) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def contributions(df: DataFrame, model: LogisticRegression, names: list[str], key: str, top: int = 3) -> DataFrame:
    """Per row the features that move a linear model's probability most, up and down: p - sigmoid(margin - w * x)."""
    w = [float(x) for x in model.coefficients.toArray()]
    x = vector_to_array("features")
    margin = F.aggregate(F.zip_with(F.array(*(F.lit(v) for v in w)), x, lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, b: a + b)
    sig = lambda z: 1 / (1 + F.exp(-z))
    rows = df.select(key, margin.alias("m"), F.posexplode(x).alias("i", "x"))
    rows = rows.withColumn("effect", sig(F.col("m")) - sig(F.col("m") - F.element_at(F.array(*(F.lit(v) for v in w)), F.col("i") + 1) * F.col("x")))
    rows = rows.withColumn("feature", F.element_at(F.array(*(F.lit(n) for n in names)), F.col("i") + 1))
    place = lambda o: F.row_number().over(Window.partitionBy(key).orderBy(o, "i"))
    rows = rows.withColumns({"up": place(F.desc("effect")), "down": place(F.asc("effect"))})
    return rows.where(((F.col("up") <= top) & (F.col("effect") > 0)) | ((F.col("down") <= top) & (F.col("effect") < 0))).select(key, "feature", "effect")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; constant columns become 0."""
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: share(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}).drop(*(f"__{k}_{c}" for c in columns for k in "ms"))


def ridge_leave_one_out(df: DataFrame, key: str, columns: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(key, prediction, residual): each row predicted by a ridge model fitted on the others.

    The Gram matrix is summed in Spark: (columns + 1) squared numbers reach the driver, whatever the number of rows. The
    residual without a row is its residual over 1 minus its leverage.
    """
    df = materialize(df.select(*dict.fromkeys([key, *columns, target])), "ridge")  # summed, then predicted: made once
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    k = len(terms)
    sums = df.agg(*(F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)), *(F.sum(t * F.col(target)) for t in terms)).first()
    gram = np.zeros((k, k))
    it = iter(sums)
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = next(it) or 0.0
    right = np.array([next(it) or 0.0 for _ in range(k)])
    inverse = np.linalg.inv(gram + alpha * np.diag([0.0] + [1.0] * (k - 1)))
    beta = inverse @ right
    fit = sum((F.lit(float(b)) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0))
    leverage = sum((F.lit(float(inverse[i, j])) * terms[i] * terms[j] for i in range(k) for j in range(k)), F.lit(0.0))
    loo = (F.col(target) - fit) / (1 - leverage)
    return df.select(key, (F.col(target) - loo).alias("prediction"), loo.alias("residual"), F.col(target).alias("actual"))


def fit_quality(predicted: DataFrame) -> DataFrame:
    """R squared and the mean absolute error."""
    mean = predicted.agg(F.avg("actual").alias("__m"))
    p = predicted.crossJoin(F.broadcast(mean))
    return p.agg((1 - F.sum(F.col("residual") ** 2) / F.sum((F.col("actual") - F.col("__m")) ** 2)).alias("r2"), F.avg(F.abs("residual")).alias("mae"))


def clusters(df: DataFrame, key: str, vector: str, ks: range = range(2, 9)) -> tuple[int, float, DataFrame]:
    """(k, silhouette, assignments) of the cut of an average-linkage tree with the best cosine silhouette; a cluster is named
    by its least key. Vectors that are null, zero or not finite are in none."""
    from . import linkage

    v = F.col(vector).cast("array<double>")
    length = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    data = df.where(F.col(key).isNotNull() & v.isNotNull()).where((length > 0) & (length < float("inf")) & ~F.isnan(length)).dropDuplicates([key])
    data = materialize(data.select(key, array_to_vector(v).alias("features")), "vectors")
    merges = materialize(linkage.average_linkage(df, key, vector), "tree")
    judge = ClusteringEvaluator(distanceMeasure="cosine")
    n, ids = merges.count() + 1, data.select(key)
    cuts = [k for k in ks if n >= 2 and k <= n]
    data = materialize(data.join(linkage.cuts(ids, key, merges, cuts), key), "cuts") if cuts else data
    best = (0, -2.0, None)
    for k in cuts:
        out = data.withColumn("cluster", F.col(f"__cut{k}"))
        s = judge.evaluate(_numbered_clusters(out))
        if s > best[1]:
            best = (k, s, out.select(key, F.col("cluster").alias("coalition_id")))
    return best


def _numbered_clusters(out: DataFrame) -> DataFrame:
    """Clusters as numbers from 0, which the evaluator asks for; there are as many as a cut has."""
    names = sorted(r["cluster"] for r in out.select("cluster").distinct().collect())
    return out.withColumn("prediction", (F.array_position(F.array(*map(F.lit, names)), F.col("cluster")) - 1).cast("double"))


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 300, sample: int = 256, seed: int = 0) -> DataFrame:
    """(key, score) of an isolation forest: 0.5 is ordinary, towards 1 is rare.

    Each tree needs only `sample` rows, so the forest is grown on the driver from trees times sample rows at most, taken by
    hash; scoring is one Arrow pass.
    """
    x = df.select(F.col(key).alias("__k"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    wanted, total, place = min(trees * sample, 76_800), x.count(), F.xxhash64("__k", F.lit(seed))
    # twice the wanted share by hash, so that no task has to order all rows
    near = x.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * 2 * wanted / total)) if total > 2 * wanted else x
    pool = near.orderBy(place, "__k").limit(wanted).toPandas()[columns].to_numpy()
    rng = np.random.default_rng(seed)
    size = min(sample, len(pool))
    forest = [grow(pool[rng.choice(len(pool), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []
    norm = path_length(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = f[columns].to_numpy()
            depth = np.zeros(len(rows))
            for tree in forest:
                descend(tree, rows, np.arange(len(rows)), 0, depth)
            yield pd.DataFrame({key: f["__k"], "score": 2.0 ** (-depth / max(len(forest), 1) / max(norm, 1e-9))})

    return x.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double")


def path_length(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
    if depth == 0 or not len(wide):
        return (len(rows),)
    c = int(rng.choice(wide))
    cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
    left = rows[:, c] < cut
    return (c, cut, grow(rows[left], rng, depth - 1), grow(rows[~left], rng, depth - 1))


def descend(tree: tuple, rows: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + path_length(tree[0])
        return
    left = rows[at, tree[0]] < tree[1]
    descend(tree[2], rows, at[left], depth + 1, out)
    descend(tree[3], rows, at[~left], depth + 1, out)


def flag(scored: DataFrame, share_flagged: float = 0.08) -> DataFrame:
    """Scores from 0 to 1 and a flag for the share with the highest."""
    from .metrics import min_max

    cut = group_quantiles(scored, [], "score", {"__cut": 1 - share_flagged})
    out = scored.crossJoin(F.broadcast(cut)).withColumn("flagged", F.col("score") >= F.col("__cut")).drop("__cut")
    return min_max(out, "score", "score_share")


def best_share(scored: DataFrame, gold: DataFrame, key: str, options: tuple[float, ...] = (0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.15, 0.20)) -> float:
    """The flagged share with the best F1 on known labels."""
    from .metrics import confusion

    found = {}
    for s in options:
        rows = flag(scored, s).join(gold.select(key, "label"), key).withColumn("p", F.col("flagged").cast("int"))
        found[s] = confusion(rows, "label", "p").first()["f1"]
    return max(found, key=lambda s: (found[s], -s))


def count_vectors(df: DataFrame, words: str, size: int = 500, min_df: int = 3, max_df: float = 0.8):
    """Spark ML's own sparse counts, for models that take vectors."""
    return CountVectorizer(inputCol=words, outputCol="features", vocabSize=size, minDF=min_df, maxDF=max_df).fit(df)
