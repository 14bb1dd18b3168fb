"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize
from .tiles import Links, deal, groups

TILE = 512
#: Signs of a sketch, as so many 64-bit numbers.
SKETCH = 4


def plan(n: int, threshold: float, recall: float, per_group: int = 512) -> tuple[int, int]:
    """(tables, bits): bits so that a table's groups hold about per_group of n vectors, and as many tables as find a pair
    at the threshold itself with probability recall."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / per_group)), 2, 30))
    same = 1 - np.arccos(min(threshold, 1.0)) / np.pi
    return int(np.ceil(np.log(1 - recall) / np.log1p(-(same**bits)))), bits


def sketches(unit: np.ndarray, seed: int = 29) -> np.ndarray:
    """SKETCH * 64 signs of projections per vector, packed into unsigned numbers."""
    planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], SKETCH * 64))
    return np.packbits(unit @ planes >= 0, axis=1).view(np.uint64)


def sketch_radius(threshold: float) -> int:
    """Differing signs that a pair at the threshold exceeds with a chance below one in a million (five deviations)."""
    n, q = SKETCH * 64, np.arccos(min(threshold, 1.0)) / np.pi
    return int(np.ceil(n * q + 5 * np.sqrt(n * q * (1 - q))))


def sign_codes(unit: np.ndarray, tables: int, bits: int, seed: int = 17) -> np.ndarray:
    """Per vector and table the signs of bits projections as one number. The planes depend on seed and dimension only."""
    planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], tables * bits))
    signs = (unit @ planes >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, recall: float = 0.999, cap: int = 4096, per_group: int = 512) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept for every row.

    Vectors link at a cosine of threshold or more, computed in double precision for every pair that shares a group of one
    of the tables; plan() sets their number so that a pair at the threshold is missed with probability 1 - recall, and
    closer ones less. First a sketch of signs is dealt to the groups in place of the vector: only vectors that have another
    one near enough by sketch in a group are sent there. Equal vectors form a class that takes part once, with its number of rows. A pair of classes is
    counted in the first table that holds both, so that counts add up without listing pairs; groups are dealt out in pairs
    of tiles of about cap rows; links for components are a spanning forest per task.

    Null, zero and empty vectors and those with null, NaN or infinite components link with nothing; vectors of different
    length never link. Null ids are carried. Repeated rows are vectors of their own. An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    classes = rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    tables, bits = plan(classes.count(), threshold, recall, per_group)
    radius = sketch_radius(threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").to_pylist()
            sizes = np.array([len(x) for x in lists])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                v = np.array([lists[i] for i in at.tolist()], np.float64)
                v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                for x in range(0, len(at), 2000):
                    k, part = v[x : x + 2000], at[x : x + 2000]
                    lists_of = lambda m, kind: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(kind))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(batch.column(c).to_numpy()[part]) for c in ("cid", "n")), lists_of(k, pa.float64()), lists_of(sign_codes(k, tables, bits).astype(np.int32), pa.int32()), lists_of(sketches(k).view(np.int64), pa.int64())],
                        names=["cid", "n", "v", "codes", "sketch"],
                    )

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            size = group.num_rows
            sketch = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(size, SKETCH)
            left, right, same = sides(group)
            near = np.zeros(size, bool)
            for x in range(0, len(left), TILE):
                p = left[x : x + TILE]
                for y in range(x if same else 0, len(right), TILE):
                    q = right[y : y + TILE]
                    apart = sum(np.bitwise_count(sketch[p, k][:, None] ^ sketch[q, k][None, :]).astype(np.int16) for k in range(SKETCH))
                    i, j = np.nonzero(apart <= radius)
                    i, j = p[i], q[j]
                    near[i[i != j]] = True
                    near[j[i != j]] = True
            if near.any():
                yield pa.RecordBatch.from_arrays([group.column(c).combine_chunks().filter(pa.array(near)) for c in ("__group", "cid")], names=["key", "cid"])

    def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        tile = group.column("__tile").to_numpy()
        i, j = group.column("__i")[0].as_py(), group.column("__j")[0].as_py()
        return np.flatnonzero(tile == i), np.flatnonzero(tile == j), i == j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            size = group.num_rows
            flat = lambda k: group.column(k).combine_chunks().flatten().to_numpy().reshape(size, -1)
            v, codes, n, cid = flat("v"), flat("codes"), group.column("n").to_numpy(), group.column("cid").to_numpy()
            t = group.column("t")[0].as_py()
            left, right, same = sides(group)
            links, total = Links(size), np.zeros(size, np.int64)
            for a in range(0, len(left), TILE):
                p = left[a : a + TILE]
                for b in range(a if same else 0, len(right), TILE):
                    q = right[b : b + TILE]
                    x, y = np.nonzero(v[p] @ v[q].T >= threshold)
                    x, y = p[x], q[y]
                    if same:
                        x, y = x[x < y], y[x < y]
                    links.add(x, y)
                    if t and len(x):  # counted where an earlier table held both
                        new = ~(codes[x][:, :t] == codes[y][:, :t]).any(1)
                        x, y = x[new], y[new]
                    np.add.at(total, x, n[y])
                    np.add.at(total, y, n[x])
            at = np.flatnonzero((total > 0) | (links.label != np.arange(size)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[links.label[at]]), pa.array(total[at])], names=["src", "dst", "links"])

    coded = classes.select("cid", "n", "v").mapInArrow(code, "cid long, n long, v array<double>, codes array<int>, sketch array<long>")
    coded = materialize(coded, "vector-codes")
    key = ((F.col("code").cast("long") * tables + F.col("t")) * 65_537 + F.col("d")).alias("key")
    keyed = coded.select("cid", "sketch", F.size("v").alias("d"), F.posexplode("codes").alias("t", "code")).select(key, "cid", "sketch")
    near = deal(keyed, "key", "cid", cap).mapInArrow(likely, "key long, cid long").distinct()
    rows_near = near.join(coded, "cid").select("key", "cid", "n", F.expr(f"cast((key div 65537) % {tables} as int) t"), "codes", "v")
    found = materialize(deal(materialize(rows_near, "vectors-near"), "key", "cid", cap).mapInArrow(run, "src long, dst long, links long"), "vector-links")
    reach = components(found, "embeddings")
    counts = found.groupBy(F.col("src").alias("cid")).agg(F.sum("links").alias("links"))
    named = classes.join(counts, "cid", "left").join(reach, classes["cid"] == reach["node"], "left")
    named = named.select("v", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    # written, so that the rows of a large component can be split in the join
    roots = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "vector-roots")
    named = materialize(named.join(roots, "component").select("v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "vector-components")
    out = rows.where("fine").join(named, "v").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
