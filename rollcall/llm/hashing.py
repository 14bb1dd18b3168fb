"""Hashed terms of words, computed for many words at once, and the labelled rows that models are fitted on."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def buckets(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Hashes of a kind of term as numbers below 2 ** bits."""
    h = (h + np.uint64(kind * int(STEP) % 2**64)) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Words:
    """Distinct words as one flat array of code points, each between < and >."""

    def __init__(self, words: list[str]):
        raw = "".join([f"<{w}>" for w in words])
        self.points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)

    def whole(self, least: int = 0) -> np.ndarray:
        """A hash of each word; with least only of its first so many code points (all, if it is shorter)."""
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.points)) - np.repeat(self.starts, self.sizes)
        powers = np.cumprod(np.full(int(self.sizes.max()), STEP, np.uint64))
        part = self.points * powers[place]
        if least:
            part = np.where(place <= least, part, np.uint64(0))
        return np.add.reduceat(part, self.starts)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every run of n code points, the marks included."""
        m = len(self.points) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.points[:m].copy()
        for k in range(1, n):
            h = h * STEP + self.points[k : k + m]
        inside = self.word[:m] == self.word[n - 1 :]
        return self.word[:m][inside], h[inside]


def numbered(docs: list[list]) -> tuple[list, list[np.ndarray]]:
    """The distinct items of many lists, and each list as numbers of them."""
    numbers: defaultdict = defaultdict(count().__next__)
    get = numbers.__getitem__
    lists = [np.fromiter(map(get, x), np.int64, len(x)) for x in docs]
    return list(numbers), lists


def fold_of(doc_id) -> "F.Column":
    """crc32 of the id as text modulo 5; rows where it is 0 are held out from learning."""
    return F.crc32(doc_id.cast("string")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, total_bytes: int, doc_id: str = "doc_id", text: str = "text") -> Iterator[tuple[bytes, int]]:
    """(text, 0 or 1) of at most rows labelled documents of the learning folds, of total_bytes together, by doc_id.

    Of the ids that have both a label and a document, those of least hash are taken, so that the sample doesn't depend on
    layout and labels of other documents take no place in it; one that no longer fits is passed over. Null labels and ids are
    left out; of conflicting labels the mean decides, one half counting as 1; of rows that repeat an id the least text is
    read. Both bounds hold before texts reach the driver, and they come partition by partition.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = materialize(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled-sample")
    sizes = found.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, ids = 0, []
    for doc, n in sizes:
        if total + n <= total_bytes:
            total += n
            ids.append(doc)
    if len(ids) < len(sizes):
        found = found.where(F.col("doc_id").isin(ids))
    for row in found.orderBy("doc_id").toLocalIterator():
        yield row["text"].encode("utf-8", "replace"), row["y"]


def chunks(rows: Iterable, n: int = 100) -> Iterator[list]:
    it = iter(rows)
    while part := list(islice(it, n)):
        yield part
