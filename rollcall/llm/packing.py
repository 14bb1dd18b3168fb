"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts


@dataclass
class Costs:
    """What a sequence of n positions costs: each position once, each pair of positions a little, and a fixed part."""

    fixed: float = 16.0
    linear: float = 1.0
    quadratic: float = 2e-5

    def __call__(self, n: int) -> float:
        return self.fixed + self.linear * n + self.quadratic * n * n


@dataclass
class Packed:
    """Per item its bin and offset; per bin its permitted length after downsizing and its contents."""

    bin: np.ndarray
    offset: np.ndarray
    capacity: list[int] = field(default_factory=list)
    filled: list[int] = field(default_factory=list)


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...], costs: Costs | None = None) -> Packed:
    """Packs items, longest first, each into the open bin that it leaves the least room in.

    Where none has room, a bin opens whose size costs least per position that it is likely to hold: the item, and as much
    of what is still to come as fits. At the end each bin shrinks to the smallest permitted size that holds it. Bins by
    free room are the set bits of one integer, so that the next larger room is found at once.
    """
    costs, sizes = costs or Costs(), tuple(sorted(sizes))
    n = len(lengths)
    out = Packed(np.zeros(n, np.int64), np.zeros(n, np.int64))
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    rooms: dict[int, list[int]] = {}
    bits = 0
    price = {s: costs(s) for s in sizes}
    for i in order.tolist():
        size = int(lengths[i])
        left -= size
        above = bits >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                bits &= ~(1 << room)
        else:
            whole = min((s for s in sizes if s >= size), key=lambda s: (price[s] / (size + min(s - size, left)), s))
            b, room = len(out.capacity), whole
            out.capacity.append(whole)
            out.filled.append(0)
        out.bin[i], out.offset[i] = b, out.filled[b]
        out.filled[b] += size
        room -= size
        if room:
            rooms.setdefault(room, []).append(b)
            bits |= 1 << room
    out.capacity = [min(s for s in sizes if s >= f) for f in out.filled]
    return out


def word_count(text: bytes) -> int:
    return len(text.split())


def pack(docs: DataFrame, sizes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), doc_id: str = "doc_id", text: str = "text", shard_rows: int = 100_000, length=word_count) -> DataFrame:
    """A row per piece of a document: doc_id, piece, start and length in the document, bin_id, bin_capacity, bin_offset.

    A document's length is length(text) plus one for its end mark. One longer than the largest size is cut: whole pieces
    fill bins of their own at once, and only the rest is packed. Null and empty texts have length one; nothing is dropped.
    Only ids and lengths are shuffled, into about rows / shard_rows shards (counted, not capped) by a hash of the row and
    its input partition, so that even one row repeated in a third of the table spreads; each shard is packed by itself.
    bin_id is unique over shards. Ties are placed in order of doc_id and of the text's hash. Empty tables give no rows.
    """
    spark = docs.sparkSession
    largest = max(sizes)
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = np.array([length(x) + 1 for x in texts(batch.column("text"))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n)], names=["doc_id", "h", "n"])

    shards = max(1, -(-docs.select(F.lit(1)).count() // shard_rows))
    rows = frame.mapInArrow(measure, "doc_id long, h long, n long").withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "n", F.spark_partition_id()), F.lit(shards)).cast("int"))
    parts = max(1, min(shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if shard is not None and shard != ids[a]:
                        yield from packed(shard, held)
                        held = []
                    shard = int(ids[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from packed(shard, held)

    def packed(shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        docs_, n = table.column("doc_id").combine_chunks(), table.column("n").to_numpy()
        full, rest = n // largest, n % largest
        open_ = np.flatnonzero(rest)
        got = best_fit(rest[open_], sizes)
        base = shard << 40
        bins = len(got.capacity)
        capacity = np.array(got.capacity, np.int64)
        yield block(docs_.take(pa.array(open_)), full[open_], full[open_] * largest, rest[open_], base + got.bin, capacity[got.bin] if bins else got.bin, got.offset)
        which = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
        for i in range(0, len(which), 100_000):
            w, p = which[i : i + 100_000], piece[i : i + 100_000]
            same = np.full(len(w), largest, np.int64)
            yield block(docs_.take(pa.array(w)), p, p * largest, same, base + bins + i + np.arange(len(w)), same, np.zeros(len(w), np.int64))

    def block(ids: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.asarray(c, np.int64)) for c in columns)], names=["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset"])

    return rows.select("shard", "doc_id", "n").mapInArrow(run, "doc_id long, piece long, start long, length long, bin_id long, bin_capacity long, bin_offset long")
