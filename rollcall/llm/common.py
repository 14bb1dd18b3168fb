"""What several operators share: tables cut from their lineage, Arrow columns as bytes, and grouping into components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, work_path

__all__ = ["components", "joined_least", "list_array", "materialize", "partitions", "slices", "texts", "work_path"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about limit bytes of a text column; a longer single text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        sizes = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.float64))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values cut into lists of the given counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def joined_least(both: DataFrame, low: DataFrame, n: int, hub: int, name: str) -> DataFrame:
    """both (u, v) with m, the value of low (u, m, d) for u; d counts u's rows.

    With more than hub rows in all (n), nodes of more than hub rows are looked up in a broadcast table instead, so that
    no task gathers the rows of one node. That table has n / hub rows at most.
    """
    if n <= hub:
        return both.join(low.select("u", "m"), "u")
    hot = materialize(low.where(F.col("d") > hub).select("u", F.col("m").alias("hm")), f"{name}-hubs")
    marked = both.join(F.broadcast(hot), "u", "left")
    far = marked.where("hm is null").select("u", "v").join(low.select("u", "m"), "u")
    return far.unionByName(marked.where("hm is not null").select("u", "v", F.col("hm").alias("m")))


def components(edges: DataFrame, name: str, max_rounds: int = 60, hub: int = 1_000_000) -> DataFrame:
    """Connected components of (src, dst) links by alternating large-star and small-star rounds.

    Returns (node, component) for each node that has a link to another one; component is the smallest node reachable.
    Every round is a few shuffles over distinct links and a written table; only a count and a checksum reach the driver.
    A node's links are never gathered: its smallest neighbour is a partially aggregated minimum that is joined back, for
    nodes of over hub links by a broadcast of bounded size. An empty input gives an empty result.
    """
    e = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).where("a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    before, n = None, e.count()
    count = F.count(F.lit(1)).alias("d")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), count)
        large = joined_least(both, low, 2 * n, hub, name).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), count)
        small = joined_least(large, low, 2 * n, hub, name).select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("x"))
        e = materialize(small.select("x.u", F.col("x.w").alias("v")).where("u <> v").distinct(), f"{name}-links")
        state = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, n = state, state[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
