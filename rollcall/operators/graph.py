"""Co-occurrence graphs and what is measured on them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize
from .relational import dealt, running_total


def pair_counts(rows: DataFrame, group: str, node: str, least_size: int = 2, most_size: int | None = None, least: int = 1) -> DataFrame:
    """(a, b, weight) with a < b: how many groups hold both. Groups of fewer than least_size or, where most_size says so,
    of more nodes don't count; that bound keeps the pairs of a group finite and is part of the measure."""
    # Dealt by group once for all that follows, without joining small tasks: rows become pairs.
    d = dealt(rows.select(F.col(group).alias("__g"), F.col(node).alias("__n")), "__g").distinct()
    if least_size > 2 or most_size:  # a group of one has no pairs
        size = d.groupBy("__g").count().where(F.col("count") >= least_size)
        size = size.where(F.col("count") <= most_size) if most_size else size
        d = d.join(size.select("__g"), "__g", "left_semi")
    pairs = d.select("__g", F.col("__n").alias("a")).join(d.select("__g", F.col("__n").alias("b")), "__g").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *(c for c in edges.columns if c not in ("a", "b")))
    return edges.unionByName(flipped)


def degree_centrality(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Degree and degree / (n - 1), 0 for a single node; nodes without edges stay."""
    ends = edges.select(F.explode(F.array("a", "b")).alias(node))  # edges are made once, not once for each end
    degree = ends.groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("__n"))
    out = nodes.select(node).join(degree, node, "left").fillna(0, ["degree"]).crossJoin(F.broadcast(n))
    return out.select(node, "degree", F.when(F.col("__n") > 1, F.col("degree") / (F.col("__n") - 1)).otherwise(0.0).alias("centrality"))


def neighbours(edges: DataFrame, most_edges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids, bounds, near, weights) of a, b and, where there is one, weight: the neighbours of ids[i] in order are
    ids[near[bounds[i]:bounds[i + 1]]]. None for over most_edges edges."""
    pairs = edges.limit(most_edges + 1).toArrow().to_pandas()
    return None if len(pairs) > most_edges else near_lists(pairs)


def near_lists(pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What neighbours gives, of rows in one machine."""
    codes, ids = pd.factorize(pd.concat([pairs["a"], pairs["b"]], ignore_index=True), sort=True)
    x, y = codes[: len(pairs)], codes[len(pairs) :]
    start, end = np.concatenate([x, y]), np.concatenate([y, x]).astype(np.int32)
    order = np.lexsort((end, start))
    weights = np.tile(pairs["weight"].to_numpy(float), 2)[order] if "weight" in pairs else np.ones(len(order))
    return np.asarray(ids), np.searchsorted(start[order], np.arange(len(ids) + 1)), end[order], weights


def spread(nodes: DataFrame) -> DataFrame:
    """Few rows of much work each, dealt out to all cores."""
    return nodes.repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism)


def forest(frames: Iterator[pd.DataFrame], most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Links (a, b) as a row per node met: a, and as b the least node that it is linked with by them. Some `most` links more
    than nodes are held at a time."""
    a, b, kept = np.array([]), np.array([]), 0

    def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, ids = pd.factorize(np.concatenate([a, b]), sort=True)
        x, y, root = codes[: len(a)], codes[len(a) :], np.arange(len(ids))
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            x, y = root[x], root[y]
            x, y = x[x != y], y[x != y]
        return ids, ids[root]

    for f in frames:
        a, b = (np.concatenate([old, f[c].to_numpy()]) if len(old) else f[c].to_numpy() for old, c in ((a, "a"), (b, "b")))
        if len(a) > kept + most:
            a, b = trees(a, b)
            kept = len(a)
    if len(a):
        a, b = trees(a, b)
        yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """(node, component): the nodes of links and the least node of each one's component, as a written table. Tasks report
    forests, no links, and one task joins these: some rows per node."""
    kind = dict(links.dtypes)["a"]
    tasks = 2 * links.sparkSession.sparkContext.defaultParallelism
    trees = links.select("a", "b").coalesce(tasks).mapInPandas(forest, f"a {kind}, b {kind}")
    return materialize(trees.repartition(1).mapInPandas(forest, f"a {kind}, b {kind}").toDF("node", "component"), "components")


def in_shares(links: DataFrame, most_edges: int) -> DataFrame:
    """A written table of the nodes of links: node, component, nodes and links of the component, and the share of the graph that
    it is in. A share is whole components of some 2^20 links together, or fewer where all cores would not get some; null for
    components of over most_edges links."""
    found = components(links)
    sizes = links.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    sizes = materialize(sizes.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")), "component"), "sizes")
    total = sizes.agg(F.sum("links")).first()[0] or 0
    target = max(1, min(1 << 20, total // (4 * links.sparkSession.sparkContext.defaultParallelism)))
    sizes = running_total(sizes, [F.col("component")], F.col("links"), "upto")
    sizes = sizes.withColumn("share", F.when(F.col("links") <= most_edges, F.floor((F.col("upto") - F.col("links")) / target))).drop("upto")
    out = materialize(found.join(sizes, "component"), "shares")
    discard(found)
    return out


def by_shares(left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, *more: Column) -> DataFrame:
    """run of the rows of left and right with the same share and block; dealt out anew, as few rows may be much work. more:
    columns of right that its rows get where they are dealt to."""
    tasks = 8 * left.sparkSession.sparkContext.defaultParallelism
    left, right = (df.toDF(*df.columns).repartition(tasks, "share", "block") for df in (left, right))
    return left.groupBy("share", "block").cogroup(right.select("*", *more).groupBy("share", "block")).applyInPandas(run, schema)


def betweenness(nodes: DataFrame, edges: DataFrame, node: str, most_edges: int = 2_000_000) -> DataFrame:
    """Normalised betweenness of an unweighted graph, rounded to six digits; 0 for fewer than three nodes.

    Exact at any size. Shortest paths from each source are one unit of work, spread over tasks; each task gets the edges,
    whose number is checked against most_edges first. Of a larger graph no task and no driver gets the edges: see
    passed_by_shares.
    """
    edges = materialize(edges.select("a", "b"), "edges")  # made once, not once to be counted
    found = neighbours(edges, most_edges)
    kind = dict(nodes.dtypes)[node]
    if found is None:
        part = passed_by_shares(nodes, edges, node, most_edges)
    else:
        shared = edges.sparkSession.sparkContext.broadcast(found[:3])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, bounds, near = shared.value
            total = np.zeros(len(ids))
            for frame in frames:
                for source in pd.Index(ids).get_indexer(frame[node]):
                    if source >= 0:
                        total += dependencies(bounds, near, source)
            yield pd.DataFrame({node: ids, "part": total})

        part = spread(nodes.select(node)).mapInPandas(run, f"{node} {kind}, part double").groupBy(node).agg(F.sum("part").alias("part"))
    n = nodes.agg(F.count(F.lit(1)).alias("__n"))
    out = nodes.select(node).join(part, node, "left").crossJoin(F.broadcast(n))
    scale = (F.col("__n") - 1) * (F.col("__n") - 2)
    return out.select(node, F.when(F.col("__n") >= 3, F.round(F.coalesce("part", F.lit(0.0)) / scale, 6)).otherwise(0.0).alias("betweenness"))


def passed_by_shares(nodes: DataFrame, edges: DataFrame, node: str, most_edges: int) -> DataFrame:
    """(node, part): how many shortest paths from all nodes pass each one.

    Paths stay within a component, so a task gets whole components of up to most_edges links, and of those that take long
    only every so many sources. Larger components go by levels, with all their sources.
    """
    kind = dict(nodes.dtypes)[node]
    links = edges.where("a <> b")
    place = in_shares(links, most_edges)
    place = place.join(nodes.select(F.col(node).alias("node")).distinct().withColumn("source", F.lit(True)), "node", "left").fillna(False, ["source"])
    most = 4 * links.sparkSession.sparkContext.defaultParallelism
    cost = F.when(F.col("nodes") <= DENSE, 0).otherwise(F.col("nodes").cast("double") * F.col("links"))
    blocks = F.least(F.lit(most), 1 + F.floor(cost / (1 << 30))).cast("int")
    small = place.where("share is not null and nodes > 2").withColumn("blocks", blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = small.select("share", "block", "component", F.col("node").alias("a"))

    def run(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = members.groupby("component", sort=False).indices
        for component, at in pairs.groupby("component", sort=False).indices.items():
            mine = members.iloc[rows[component]]
            ids = pd.Index(mine["node"])
            x, y = ids.get_indexer(pairs["a"].iloc[at]), ids.get_indexer(pairs["b"].iloc[at])
            sources = np.flatnonzero(mine["source"])[mine["block"].iloc[0] :: mine["blocks"].iloc[0]]
            out.append(pd.DataFrame({node: ids, "part": passed_within(x, y, len(ids), sources)}))
        return pd.concat(out) if out else pd.DataFrame({node: members["node"].iloc[:0], "part": np.zeros(0)})

    parts = by_shares(links.join(ends, "a").select("share", "block", "component", "a", "b"), small.select("share", "block", "component", "node", "blocks", "source"), run, f"{node} {kind}, part double")
    parts = materialize(parts, "passed")
    large = place.where("share is null")
    if not large.isEmpty():
        ids = np.array([r[0] for r in large.select("node").orderBy("node").collect()])
        sources = np.array([r[0] for r in large.where("source").select("node").orderBy("node").collect()], ids.dtype)
        sums = _passed_by_levels(_links(links.join(large.select(F.col("node").alias("a")), "a", "left_semi")), ids, sources)
        parts = parts.unionAll(nodes.sparkSession.createDataFrame(pd.DataFrame({node: ids, "part": sums}), f"{node} {kind}, part double"))
    return parts.groupBy(node).agg(F.sum("part").alias("part"))


#: Components of so many nodes at most are multiplied as dense matrices (72 MB), if one entry in sixty-four is a link.
DENSE = 3_000


def passed_within(x: np.ndarray, y: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """How many shortest paths from the sources pass each of n nodes with the links x to y, repeated or not, in one machine."""
    if n <= DENSE and n * n <= 128 * len(x):
        matrix = np.zeros((n, n))
        matrix[x, y] = matrix[y, x] = 1.0
        return sum((_passed(matrix.__matmul__, sources[i : i + 512], n) for i in range(0, len(sources), 512)), np.zeros(n))
    start, end = np.divmod(np.unique(np.concatenate([x * n + y, y * n + x])), n)
    bounds = np.searchsorted(start, np.arange(n + 1))
    return sum((dependencies(bounds, end, s) for s in sources), np.zeros(n))


def _links(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sources_needed(n: int, error: float, confidence: float) -> int:
    """So many sources that with the given confidence no node's betweenness is off by more than error: a source's share of it
    lies between 0 and 1, so the mean over a sample keeps to Hoeffding's bound for each of n nodes. n at most."""
    return min(n, int(np.ceil(np.log(2 * max(n, 1) / (1 - confidence)) / (2 * error * error))))


def betweenness_by_levels(nodes: DataFrame, edges: DataFrame, node: str, error: float | None = None, confidence: float = 0.95, batch: int = 256, seed: int = 0) -> DataFrame:
    """Normalised betweenness of graphs whose edges no machine holds; exact, unless an error is asked for: then sources are taken
    by hash, as many as sources_needed says.

    Brandes's accumulation for a batch of sources at a time: a level of all their breadth-first searches is the matrix of
    the graph, a written table, times the paths that end in the level before; on the way back each level hands its
    dependencies to the one before by the same product. The driver holds a number per node and source of a batch, which is
    kept to some two million of these. Links to nodes that aren't among nodes count as paths, loops don't.
    """
    n = nodes.count()
    if n < 3:
        return nodes.select(node, F.lit(0.0).alias("betweenness"))
    links = materialize(_links(edges), "links")
    ends = nodes.select(node).unionByName(links.select(F.col("a").alias(node))).unionByName(links.select(F.col("b").alias(node))).where(F.col(node).isNotNull()).distinct()
    ids = np.array([r[0] for r in ends.orderBy(node).collect()])
    k = n if error is None else sources_needed(n, error, confidence)
    picked = [r[0] for r in nodes.select(node).orderBy(F.xxhash64(F.col(node), F.lit(seed)), node).limit(k).collect()]
    sums = _passed_by_levels(links, ids, np.array([x for x in picked if x is not None], ids.dtype), batch)
    discard(links)
    found = nodes.sparkSession.createDataFrame(pd.DataFrame({node: ids, "__sum": sums}), f"{node} {dict(nodes.dtypes)[node]}, __sum double")
    scale = n / k / ((n - 1) * (n - 2))
    return nodes.select(node).join(found, node, "left").select(node, F.round(F.coalesce("__sum", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _passed_by_levels(links: DataFrame, ids: np.ndarray, picked: np.ndarray, batch: int = 256) -> np.ndarray:
    """How many shortest paths from the picked of the sorted ids pass each of these."""
    matrix = adjacency(links.withColumn("weight", F.lit(1.0)), ids)
    sources = np.searchsorted(ids, picked)
    size = max(1, min(batch, (1 << 21) // len(ids)))
    product = lambda x: times(matrix, x)
    sums = sum((_passed(product, sources[i : i + size], len(ids)) for i in range(0, len(sources), size)), np.zeros(len(ids)))
    discard(matrix)
    return sums


def _passed(product: Callable[[np.ndarray], np.ndarray], sources: np.ndarray, n: int) -> np.ndarray:
    """How many shortest paths from the sources pass each of n nodes, summed over them; product: the graph's matrix times its
    argument."""
    column = np.arange(len(sources))
    front = np.zeros((n, len(sources)))
    front[sources, column] = 1.0
    paths, levels = front.copy(), [front > 0]
    while (paths == 0).any():
        front = np.where(paths > 0, 0.0, product(front))
        if not front.any():
            break
        paths += front
        levels.append(front > 0)
    passed = np.zeros_like(paths)
    for here, before in zip(levels[:1:-1], levels[-2:0:-1], strict=True):  # the sources' own level is not asked for
        part = np.divide(1 + passed, paths, out=np.zeros_like(paths), where=here)
        passed += np.where(before, paths * product(part), 0.0)
    passed[sources, column] = 0.0
    return passed.sum(1)


def dependencies(bounds: np.ndarray, near: np.ndarray, source: int) -> np.ndarray:
    """How many shortest paths from source pass each other node, by Brandes's accumulation, level by level."""
    n = len(bounds) - 1
    seen, paths, levels = np.zeros(n, bool), np.zeros(n), []
    seen[source], paths[source], front = True, 1.0, np.array([source])
    while len(front):
        sizes = bounds[front + 1] - bounds[front]
        tail = np.repeat(front, sizes)
        head = near[np.repeat(bounds[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(tail))]
        new = ~seen[head]
        tail, head = tail[new], head[new]
        paths += np.bincount(head, paths[tail], n)
        levels.append((tail, head))
        front = np.unique(head)
        seen[front] = True
    passed = np.zeros(n)
    for tail, head in reversed(levels):
        passed += np.bincount(tail, paths[tail] / paths[head] * (1 + passed[head]), n)
    passed[source] = 0.0
    return passed


def agreement(casts: DataFrame, least: int = 10) -> DataFrame:
    """(a, b, shared, agreed, weight) for members who cast yes or no on enough common events."""
    v = casts.where(F.col("vote").isin("Y", "N")).select("event_id", "member_id", "vote").distinct()
    x, y = v.select("event_id", F.col("member_id").alias("a"), F.col("vote").alias("va")), v.select("event_id", F.col("member_id").alias("b"), F.col("vote").alias("vb"))
    out = x.join(y, "event_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("va") == F.col("vb")).alias("agreed"))
    return out.where(F.col("shared") >= least).withColumn("weight", F.col("agreed") / F.col("shared"))


def blend(agreed: DataFrame, sponsored: DataFrame, bonus: float = 0.2, least: int = 3) -> DataFrame:
    """Agreement edges raised by co-sponsorship; pairs without common votes count from least common bills on."""
    top = sponsored.agg(F.max("weight").alias("__top"))
    s = sponsored.select("a", "b", F.col("weight").alias("bills")).crossJoin(F.broadcast(top))
    out = agreed.select("a", "b", "weight").join(s, ["a", "b"], "full_outer")
    extra = F.lit(bonus) * F.col("bills") / F.col("__top")
    weight = F.when(F.col("weight").isNotNull(), F.least(F.lit(1.0), F.col("weight") + F.coalesce(extra, F.lit(0.0)))).when(F.col("bills") >= least, 0.5 + extra)
    return out.select("a", "b", weight.alias("weight")).where("weight is not null")


def top_peers(edges: DataFrame, n: int = 8) -> DataFrame:
    """Edges that are among the n heaviest of either end."""
    w = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    best = both_ways(edges).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").distinct()


def graph_view(members: DataFrame, edges: DataFrame, relevant: DataFrame, important: DataFrame, peers: int = 8) -> DataFrame:
    """The edges to draw between relevant members: all of important ones, of others those to their heaviest peers."""
    keep = relevant.select(F.col("member_id")).distinct()
    inside = edges.join(keep.withColumnRenamed("member_id", "a"), "a", "left_semi").join(keep.withColumnRenamed("member_id", "b"), "b", "left_semi")
    special = important.select("member_id").distinct()
    touched = inside.join(special.withColumnRenamed("member_id", "a"), "a", "left_semi").select("a", "b", "weight").unionByName(inside.join(special.withColumnRenamed("member_id", "b"), "b", "left_semi").select("a", "b", "weight"))
    return touched.unionByName(top_peers(inside, peers)).distinct()


def affinity(touches: DataFrame, neighbours: DataFrame) -> DataFrame:
    """The share of a member's bills that a neighbour touches too. touches: member_id, bill_id; neighbours: member_id, other_id."""
    t = dealt(touches.select("member_id", "bill_id"), "member_id", "bill_id").distinct()
    mine = t.groupBy("member_id").agg(F.count(F.lit(1)).alias("bills"))
    both = neighbours.join(t, "member_id").join(t.select(F.col("member_id").alias("other_id"), "bill_id"), ["other_id", "bill_id"]).groupBy("member_id", "other_id").agg(F.count(F.lit(1)).alias("common"))
    return neighbours.join(both, ["member_id", "other_id"], "left").join(mine, "member_id", "left").select("member_id", "other_id", F.coalesce(F.col("common") / F.col("bills"), F.lit(0.0)).alias("affinity"))


def walks(edges: DataFrame, nodes: DataFrame, node: str, per_node: int = 10, length: int = 20, seed: int = 0, most_edges: int = 2_000_000) -> DataFrame:
    """Random walks by edge weight as a written table of arrays: walk_id, walk. A node without edges walks on the spot.

    Tasks get the edges where there are at most most_edges; in larger graphs they get whole components of up to so many, and
    in larger components each step is a join. The walks are the same.
    """
    now = nodes.select(F.col(node).alias("at")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_node))))
    draw = lambda step: F.pmod(F.xxhash64("at", "k", F.lit(seed), F.lit(step)), F.lit(1_000_003)) / 1_000_003.0
    u = F.array(*(draw(step) for step in range(1, length))).cast("array<double>").alias("u")
    schema = f"at {dict(nodes.dtypes)[node]}, k int, walk array<{dict(nodes.dtypes)[node]}>"
    edges = materialize(edges.select("a", "b", "weight"), "edges")  # made once, not once to be counted
    found = neighbours(edges, most_edges)
    if found is None:
        place = in_shares(edges, most_edges).select(F.col("node").alias("at"), "share")
        blocks = place.where("share is not null").groupBy("share").agg(F.ceil(F.count(F.lit(1)) * per_node / (1 << 17)).cast("int").alias("blocks"))
        at = materialize(now.join(place.join(blocks, "share", "left"), "at", "left"), "walkers")
        walkers = at.where("share is not null").withColumn("block", F.pmod(F.xxhash64("at", "k"), F.col("blocks")).cast("int")).drop("blocks")
        pairs = edges.join(place.join(blocks, "share").withColumnRenamed("at", "a"), "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        move = lambda rows, f: walked(near_lists(rows), f, length)
        out = by_shares(pairs.select("share", "block", "a", "b", "weight"), walkers, move, schema, u)
        rest = at.where("share is null").join(place, "at", "left_anti").select("at", "k", F.array("at").alias("walk"))
        out = out.unionAll(rest).select(F.struct("at", "k").alias("walk_id"), "walk")
        large = place.where("share is null").select("at")
        if not large.isEmpty():
            inside = edges.join(large.withColumnRenamed("at", "a"), "a", "left_semi")
            out = out.unionAll(walks_by_joins(inside, now.join(large, "at", "left_semi"), draw, length))
        out = materialize(out, "walks")
        discard(edges, at)
        return out
    shared = edges.sparkSession.sparkContext.broadcast(found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield walked(shared.value, f, length)

    out = spread(now).select("at", "k", u).mapInPandas(run, schema)
    return materialize(out.select(F.struct("at", "k").alias("walk_id"), "walk"), "walks")


def walked(graph: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], walkers: pd.DataFrame, length: int) -> pd.DataFrame:
    """The walks in a graph as by near_lists. walkers: at, k and u, the numbers from 0 to 1 that choose their steps."""
    ids, bounds, near, weights = graph
    upto = np.concatenate([[0.0], np.cumsum(weights)])
    at = pd.Index(ids).get_indexer(walkers["at"])
    linked = np.flatnonzero(at >= 0)
    u = np.array(walkers["u"].tolist()).reshape(len(walkers), length - 1)[linked]
    path = np.empty((len(linked), length), np.int64)
    path[:, 0] = x = at[linked]
    for step in range(1, length):
        lo, hi = bounds[x], bounds[x + 1]
        place = np.searchsorted(upto, upto[lo] + u[:, step - 1] * (upto[hi] - upto[lo]), "right") - 1
        path[:, step] = x = near[np.clip(place, lo, hi - 1)]
    walk = [[v] for v in walkers["at"]]
    for i, p in zip(linked, ids[path], strict=True):
        walk[i] = p
    return pd.DataFrame({"at": walkers["at"], "k": walkers["k"], "walk": walk})


def walks_by_joins(edges: DataFrame, starts: DataFrame, draw: Callable[[int], Column], length: int) -> DataFrame:
    """starts: at, k; draw: a number from 0 to 1 of them and the step. Each step is a written table of (at, k, last): walkers
    meet the part of the graph that has their node's neighbours, and no row is made for a neighbour. A
    walker without neighbours takes no step."""
    spark, kind = edges.sparkSession, dict(starts.dtypes)["at"]
    ends = both_ways(edges.select("a", "b")).select("a").distinct()
    ids = np.array([r[0] for r in ends.orderBy("a").collect()])
    matrix = adjacency(edges, ids)
    parts = max(1, -(-2 * edges.count() // (1 << 18)))
    shared = spark.sparkContext.broadcast(ids)

    def move(walkers: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(graph):
            return walkers[["at", "k", "last"]].iloc[:0]
        at, near, weight = np.frombuffer(graph["at"][0], np.int32), np.frombuffer(graph["near"][0], np.int32), np.frombuffer(graph["weight"][0])
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        x = np.searchsorted(shared.value, walkers["last"].to_numpy())
        x = np.where(shared.value[np.minimum(x, len(shared.value) - 1)] == walkers["last"].to_numpy(), x, -1)
        lo, hi = np.searchsorted(at, x), np.searchsorted(at, x, "right")
        linked = np.flatnonzero(hi > lo)
        lo, hi, f = lo[linked], hi[linked], walkers.iloc[linked]
        place = np.searchsorted(upto, upto[lo] + f["u"].to_numpy() * (upto[hi] - upto[lo]), "right") - 1
        return pd.DataFrame({"at": f["at"], "k": f["k"], "last": shared.value[near[np.clip(place, lo, hi - 1)]]})

    now = starts.select("at", "k", F.col("at").alias("last"))
    steps, written = [now.withColumn("step", F.lit(0))], [matrix]
    for step in range(1, length):
        dealt = now.withColumn("u", draw(step)).withColumn("part", F.pmod(F.xxhash64("last"), F.lit(parts)))
        now = materialize(dealt.groupBy("part").cogroup(matrix.groupBy("part")).applyInPandas(move, f"at {kind}, k int, last {kind}"), "step")
        steps.append(now.withColumn("step", F.lit(step)))
        written.append(now)
    every = reduce(DataFrame.unionAll, steps)
    walk = F.transform(F.sort_array(F.collect_list(F.struct("step", "last"))), lambda x: x["last"])
    out = materialize(every.groupBy("at", "k").agg(walk.alias("walk")), "walks")
    discard(*written)
    return out.select(F.struct("at", "k").alias("walk_id"), "walk")


def node_vectors(edges: DataFrame, nodes: DataFrame, node: str, dim: int = 64, window: int = 10, task_steps: int = 6_000_000, **kw) -> DataFrame:
    """Vectors of nodes that walk together, zeros for nodes without edges. Walks of over task_steps steps together are learned
    from in several tasks, whose vectors Word2Vec averages."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    corpus = walks(edges, nodes, node, **kw).select(F.transform("walk", lambda x: x.cast("string")).alias("walk"))
    parts = max(1, -(-(corpus.agg(F.sum(F.size("walk"))).first()[0] or 0) // task_steps))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, inputCol="walk", seed=1, numPartitions=parts).fit(corpus)
    vectors = model.getVectors().select(F.col("word").alias("__w"), vector_to_array("vector").alias("vector"))
    linked = both_ways(edges.select("a", "b")).select(F.col("a").alias("__a")).distinct()
    out = nodes.select(node).join(vectors, nodes[node].cast("string") == vectors["__w"], "left").join(linked, nodes[node] == linked["__a"], "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return out.select(node, F.when(F.col("__a").isNull(), zero).otherwise(F.coalesce("vector", zero)).alias("vector"))


def adjacency(edges: DataFrame, ids: np.ndarray, entries: int = 1 << 18) -> DataFrame:
    """The symmetric matrix of a, b and weight over the sorted ids as a written table: rows of about so many entries (of one
    node at least), which hold the numbers of their nodes and neighbours as 32-bit and the weights as 64-bit binaries; four to
    a file, so that what reads it holds as much of a large matrix as of a small one."""
    both = both_ways(edges.select("a", "b", F.col("weight").cast("double").alias("weight")))
    parts = max(1, -(-2 * edges.count() // entries))
    shared = edges.sparkSession.sparkContext.broadcast(ids)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        at = np.searchsorted(shared.value, f["a"].to_numpy()).astype(np.int32), np.searchsorted(shared.value, f["b"].to_numpy()).astype(np.int32)
        for found, column in zip(at, ("a", "b"), strict=True):
            if (shared.value[np.minimum(found, len(shared.value) - 1)] != f[column].to_numpy()).any():
                raise KeyError("an end of an edge is no node")
        order = np.lexsort((at[1], at[0]))
        return pd.DataFrame({"part": f["part"].iloc[:1].to_numpy(), "at": [at[0][order].tobytes()], "near": [at[1][order].tobytes()], "weight": [f["weight"].to_numpy(float)[order].tobytes()]})

    packed = both.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts))).groupBy("part").applyInPandas(pack, "part long, at binary, near binary, weight binary")
    return materialize(packed.repartition(-(-parts // 4)), "matrix")


def times(matrix: DataFrame, x: np.ndarray) -> np.ndarray:
    """The matrix of adjacency times x (nodes by columns), a job; a task sees x and a few rows of the matrix at a time: as
    plain rows these come by their size, while Arrow would put all that a task reads into one batch."""
    shared = matrix.sparkSession.sparkContext.broadcast(np.ascontiguousarray(x.T))

    def run(rows: Iterator[Row]) -> Iterator[tuple[bytes, bytes]]:
        for at, near, weight in rows:
            at, near, weight = np.frombuffer(at, np.int32), np.frombuffer(near, np.int32), np.frombuffer(weight)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sums = np.stack([np.add.reduceat(weight * c[near], first) for c in shared.value], 1)
            yield at[first].tobytes(), sums.tobytes()

    out = np.zeros(x.shape)
    for at, sums in matrix.select("at", "near", "weight").rdd.mapPartitions(run).collect():  # a row per node in all
        at = np.frombuffer(at, np.int32)
        out[at] = np.frombuffer(sums).reshape(len(at), -1)
    shared.destroy()
    return out


def leading(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, error: float = 1e-6, most: int = 160, passes: int = 600) -> np.ndarray:
    """The eigenvectors of the k largest eigenvalues of a symmetric matrix, given as what it makes of a block of vectors: block
    Lanczos with full orthogonalisation, restarted from the best 3k vectors at most columns. Ends when no residual is over
    error; after so many passes it warns."""
    v, mv = np.zeros((n, 0)), np.zeros((n, 0))
    new = np.linalg.qr(np.random.default_rng(0).standard_normal((n, min(n, k + 2))))[0]
    for _ in range(passes):
        v, mv = np.hstack([v, new]), np.hstack([mv, apply(new)])
        t = v.T @ mv
        values, s = np.linalg.eigh((t + t.T) / 2)
        best = s[:, ::-1][:, :k]
        left = np.linalg.norm(mv @ best - (v @ best) * values[::-1][:k], axis=0).max()
        if left <= error or v.shape[1] >= n:
            break
        new = mv[:, -new.shape[1] :]
        if v.shape[1] + new.shape[1] > most:
            s = s[:, ::-1][:, : 3 * k]
            v, mv = v @ s, mv @ s
            new = mv - v * values[::-1][: 3 * k]
            new = new[:, : k + 2]
        for _ in range(2):
            new = new - v @ (v.T @ new)
        new, r = np.linalg.qr(new)
        new = new[:, np.abs(np.diag(r)) > 1e-13]
        if not new.shape[1]:
            new = np.random.default_rng(v.shape[1]).standard_normal((n, 1))
            new = np.linalg.qr(new - v @ (v.T @ new))[0]
    else:
        warnings.warn(f"eigenvectors with a residual of {left:.1e} after {passes} passes", stacklevel=2)
    t = v.T @ mv
    return v @ np.linalg.eigh((t + t.T) / 2)[1][:, ::-1][:, :k]


def spectral(edges: DataFrame, nodes: DataFrame, node: str, k: int = 4, most_nodes: int = 5000) -> DataFrame:
    """Row-normalised eigenvectors of the least eigenvalues of the normalised Laplacian: of up to most_nodes nodes a dense
    problem of one task. Of more the matrix stays a table that each pass of Lanczos's method multiplies by a few vectors;
    the driver holds these, up to some sixteen million numbers or twenty-four per node, twice, and no edges."""
    ids = np.array([r[0] for r in nodes.select(node).distinct().orderBy(node).collect()])
    ends = edges.select("a", "b", "weight")
    if len(ids) <= most_nodes:
        at = {x: i for i, x in enumerate(ids.tolist())}
        a = np.zeros((len(ids), len(ids)))
        for x, y, w in ends.collect():  # at most most_nodes squared
            a[at[x], at[y]] = a[at[y], at[x]] = w
        d = a.sum(1)
        s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0)
        _, v = np.linalg.eigh(np.eye(len(ids)) - s[:, None] * a * s[None, :])
    else:
        ends = materialize(ends, "edges")  # made once, not once to be counted
        matrix = adjacency(ends, ids)
        discard(ends)
        d = times(matrix, np.ones((len(ids), 1)))
        s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0)
        v = leading(lambda x: s * times(matrix, s * x), len(ids), k, most=max(4 * (k + 2), min(160, (1 << 24) // len(ids))))
        discard(matrix)
    v = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(0), np.arange(min(k, len(ids)))])
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    rows = pd.DataFrame({node: ids, "vector": v.tolist()})
    return nodes.sparkSession.createDataFrame(rows, f"{node} {dict(nodes.dtypes)[node]}, vector array<double>")
