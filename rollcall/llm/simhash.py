"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, slices, texts
from .tiles import Links, deal, groups

TILE = 512


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash_of(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[width - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, len(ends), 1 << 16):
        h = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=False)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every whole text, null as empty; one Arrow pass."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(x, width) for x in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return frame.mapInArrow(run, frame.select("doc_id").schema.add("fp", "long"))


def blocks(n: int, radius: int, most: int = 2048) -> list[list[tuple[int, int]]]:
    """Tables of (shift, bits) runs. Fingerprints are cut into m > radius blocks; two within the radius agree on m - radius
    of them at least, so each choice of m - radius blocks is a table. m is the least for which a table's groups hold about
    most of n fingerprints or fewer, up to eight blocks."""
    for m in range(radius + 1, max(radius + 2, 9)):
        cuts = [64 * k // m for k in range(m + 1)]
        runs = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        if n >> (64 * (m - radius) // m) <= most:
            break
    return [list(c) for c in combinations(runs, m - radius)]


def near_pairs(a: np.ndarray, tile: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of pairs within the radius. Rows are sorted by population count and compared tile by tile; two
    tiles whose counts differ by more than the radius throughout hold no pair and are skipped. With tile (0 or 1 per row)
    only pairs of one of each are looked for."""
    pops = np.bitwise_count(a).astype(np.int64)
    sides = [np.arange(len(a))] * 2 if tile is None else [np.flatnonzero(tile == 0), np.flatnonzero(tile == 1)]
    sides = [s[np.argsort(pops[s], kind="stable")] for s in sides]
    for i in range(0, len(sides[0]), TILE):
        left = sides[0][i : i + TILE]
        lo, hi = pops[left[0]], pops[left[-1]]
        for j in range(i if tile is None else 0, len(sides[1]), TILE):
            right = sides[1][j : j + TILE]
            if pops[right[0]] - hi > radius:
                break
            if lo - pops[right[-1]] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[left][:, None] ^ a[right][None, :]) <= radius)
            x, y = left[x], right[y]
            if tile is None:
                x, y = x[x != y], y[x != y]
            if len(x):
                yield x, y


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, cap: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    component_id is the least doc_id that links reach; fingerprints link at radius or fewer differing bits, which is found
    without loss: each distinct fingerprint goes to the groups of the tables of blocks(), the groups are dealt out in pairs
    of tiles of at most about cap rows, and a task reports a spanning forest of the links that it finds, never all pairs.
    Copies share a fingerprint and take part once. Null and empty texts have fingerprint zero and link like any other;
    null ids are carried and count only if their whole component has no other; repeated rows stay; an empty table gives no
    rows.
    """
    prints = materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    tables = blocks(distinct.count(), radius)
    keys = []
    for t, runs in enumerate(tables):
        key = F.lit(t).cast("long")
        for shift, bits in runs:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(key)
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, held = [], [], 0
        for group in groups(batches):
            fp = group.column("fp").to_numpy().view(np.uint64)
            side = None if group.column("__i")[0].as_py() == group.column("__j")[0].as_py() else (group.column("__tile").to_numpy() != group.column("__i").to_numpy()).astype(np.int8)
            links = Links(len(fp))
            for x, y in near_pairs(fp, side, radius):
                links.add(x, y)
            at = np.flatnonzero(links.label != np.arange(len(fp)))
            if len(at):
                src.append(fp[at])
                dst.append(fp[links.label[at]])
                held += len(at)
            if held > 50_000:
                yield out(src, dst)
                src, dst, held = [], [], 0
        if held:
            yield out(src, dst)

    def out(src: list[np.ndarray], dst: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

    links = deal(rows, "key", "fp", cap).mapInArrow(run, "src long, dst long")
    reach = components(links, "simhash")
    classes = distinct.join(reach, distinct["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # written, so that the rows of a large component can be split in the join
    roots = materialize(classes.groupBy("component").agg(F.min("least").alias("component_id")), "fingerprint-roots")
    named = materialize(classes.join(roots, "component").select(F.col("fp").alias("__fp"), "component_id"), "fingerprint-components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, prints["fp"] == named["__fp"]).select("doc_id", digits.alias("fingerprint"), "component_id")
