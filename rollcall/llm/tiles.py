"""Groups of rows dealt out as pairs of bounded tiles, and links joined within a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

GROUP = ["__group", "__i", "__j"]


def deal(rows: DataFrame, group: str, spread: str, cap: int) -> DataFrame:
    """rows with __i, __j and __tile, dealt out so that the rows of one (group, i, j) are together and in order.

    A group of up to cap rows is one pair of tiles, (0, 0). A larger one is cut into tiles of about cap rows by a hash of
    the column spread, and each row goes to every pair of tiles that its own is part of: all pairs of rows meet, with at
    most 2 * cap or so rows at a time, in as many tasks as there are pairs of tiles. Sizes are counted, by partial
    aggregation. Groups of one row are left out.
    """
    sizes = rows.groupBy(group).count().where("count > 1").select(F.col(group), F.ceil(F.col("count") / cap).cast("int").alias("__tiles"))
    placed = rows.join(sizes, group)
    placed = placed.withColumn("__tile", F.pmod(F.xxhash64(spread, F.lit(11)), F.col("__tiles")).cast("int"))
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    placed = placed.withColumns({"__i": F.least("__tile", "__other"), "__j": F.greatest("__tile", "__other")}).drop("__other", "__tiles")
    return placed.withColumnRenamed(group, "__group").repartition(partitions(rows.sparkSession), *GROUP).sortWithinPartitions(*GROUP)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (group, i, j) of a dealt partition as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in GROUP]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(k[a]) for k in keys)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Links:
    """Rows joined by links as they are found: each row's label is the least row that it is known to reach."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.label[x], self.label[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            if not len(x):
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
