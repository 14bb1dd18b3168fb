"""Suffix arrays by two-stage sorting, and removal of repeated byte strings from documents.

Every string of `length` bytes that occurs twice is found like this:

1. Each document is cut into runs of window starts that share a minimizer: the least hash of `gram` bytes inside the
   window of `length` bytes. Equal windows have equal minimizers at equal places, so they lie in runs of one group (the
   minimizer's hash). A run's context is its bytes from its first window's start to its last window's end.
2. Groups of one run hold no repeat. The contexts of all others are brought together group by group. Equal ones are found
   by their bytes and go on once; a suffix array over the different ones, built by two-stage sorting, puts equal windows
   next to each other: adjacent common prefixes of `length` bytes or more are repeats.
3. A group of more than `cap` runs is first dealt by content, copies of one context over many tasks, until each context
   stays once. If more than `different` are left (a common passage in ever new surroundings), runs are cut into shorter
   ones, which are grouped by the bytes that their windows share. All of them are compared as bytes.

Hashes only say what has to be compared: no byte goes because hashes agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard
from .common import materialize, partitions, slices, texts

BASE = 0x9E3779B97F4A7C15
POSITION_BITS = 24
#: Starts of windows that are worked on at a time.
PART = 1 << 20
SPANS = "d long, th long, a long, b long, size long"


def _table(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of the size bytes (a power of two) from each position on; shorter by size - 1."""
    h = _table()[text]
    k = 1
    while k < size:
        h = h[: len(h) - k] * np.uint64(pow(BASE, k, 1 << 64)) + h[k:]
        k *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each position on."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def places_of(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of the width hashes from each position on is, the first one of equal ones."""
    low = np.uint64((1 << POSITION_BITS) - 1)
    return (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs_of(flat: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, minimizer, its hash) of the runs in documents laid end to end (ends: where each ends)."""
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return none, none, none, none.view(np.uint64)
    h = mixed(window_hashes(flat, gram))
    place = places_of(h, length - gram + 1)
    n = len(place)
    fits = np.zeros(n + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    wide = ends - starts >= length
    np.add.at(fits, starts[wide], 1)
    np.add.at(fits, ends[wide] - length + 1, -1)
    fits = np.cumsum(fits[:n]) > 0
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (fits[1:] != fits[:-1])
    inner = starts[1:][starts[1:] < n]
    change[inner] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    good = fits[first]
    at = place[first[good]]
    return first[good], last[good], at, h[at]


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one counts as such, as it is sorted directly."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the byte changes
    out = np.ones(n, bool)
    inner = at < n - 1
    out[:-1][inner] = step[at[inner]] > 0
    return out


def two_stage(text: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start in the ranges first..last (and those needed to place them), in order of depth bytes.

    Suffixes smaller than their successor are sorted directly, by eight bytes at a time; a suffix larger than its
    successor is one byte before a suffix already in place, so scanning the buckets of first bytes upwards puts each
    behind those before it. Suffixes that agree in depth bytes end up next to each other.
    """
    n = len(text)
    small = suffix_types(text)
    following = np.where(small, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]  # the next suffix that is sorted directly
    need = np.zeros(n + 1, np.int32)
    np.add.at(need, first, 1)
    np.add.at(need, following[last] + 1, -1)
    need = np.cumsum(need[:n]) > 0
    direct = sort_directly(text, np.flatnonzero(need & small), depth)
    large = need & ~small
    by_byte = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def before(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[at > 0] - 1
        at = at[large[at]]
        return at, text[at]

    for c in range(256):
        queue = [np.concatenate(waiting[c])] if waiting[c] else []
        waiting[c] = []
        while queue:
            front = queue.pop()
            out.append(front)
            at, byte = before(front)
            if (again := at[byte == c]).size:
                queue.append(again)
            spread(at, byte, c, waiting)
        own = direct[by_byte[c] : by_byte[c + 1]]
        if own.size:
            out.append(own)
            at, byte = before(own)
            spread(at, byte, c, waiting)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def spread(at: np.ndarray, byte: np.ndarray, c: int, waiting: list[list[np.ndarray]]) -> None:
    up = byte > c
    at, byte = at[up], byte[up]
    if not at.size:
        return
    order = np.argsort(byte, kind="stable")
    at, byte = at[order], byte[order]
    cut = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        waiting[byte[a]].append(at[a:b])


def words_of(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zeros behind the end; pad more positions."""
    t = np.concatenate([text, np.zeros(pad + 8, np.uint8)])
    k = t[: len(text) + pad].astype(np.uint64)
    for i in range(1, 8):
        k = (k << np.uint64(8)) | t[i : i + len(text) + pad]
    return k


def sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the depth bytes from each on. Groups whose next 64 bytes are all alike are passed over."""
    if not len(at):
        return at
    word = words_of(text, depth + 64)
    block = window_hashes(np.concatenate([text, np.zeros(depth + 128, np.uint8)]), 64)
    at = at[np.argsort(word[at], kind="stable")]
    out = at.copy()
    # tied: places in out that share a group, group: a number for each
    new = np.append(True, word[at[1:]] != word[at[:-1]])
    group = np.cumsum(new)
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    group = group[tied]
    for far in range(8, depth, 64):
        if not len(tied):
            break
        h = block[out[tied] + far]
        head = np.append(True, group[1:] != group[:-1])
        start = np.flatnonzero(head)
        differ = np.append(h[1:] != h[:-1], False) & np.append(~head[1:], False)
        mixed = np.repeat(np.add.reduceat(differ.astype(np.int64), start) > 0, np.diff(np.append(start, len(tied))))
        calm, calm_group = tied[~mixed], group[~mixed]
        tied, group = tied[mixed], group[mixed]
        for d in range(far, min(far + 64, depth), 8):
            if not len(tied):
                break
            pos = out[tied]
            key = word[pos + d]
            order = np.lexsort((key, group))
            out[tied] = pos[order]
            key = key[order]
            new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
            alone = new & np.append(new[1:], True)
            # a number for each new group that keeps the order of the places in out
            group = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
            tied, group = tied[~alone], group[~alone]
        # numbers of both kinds become the first place of their group
        if len(calm):
            start = np.flatnonzero(np.append(True, calm_group[1:] != calm_group[:-1]))
            calm_group = np.repeat(calm[start], np.diff(np.append(start, len(calm))))
        if len(tied):
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            group = np.repeat(tied[start], np.diff(np.append(start, len(tied))))
        tied, group = np.concatenate([calm, tied]), np.concatenate([calm_group, group])
        order = np.argsort(tied, kind="stable")
        tied, group = tied[order], group[order]
    return out


def adjacent_repeats(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True for each neighbouring pair in order whose common prefix has length bytes or more (inside the text)."""
    word = words_of(text, length + 8)
    x, y = order[:-1], order[1:]
    alive = np.flatnonzero(np.maximum(x, y) + length <= len(text))
    for d in range(0, length - 7, 8):
        alive = alive[word[x[alive] + d] == word[y[alive] + d]]
        if not len(alive):
            break
    if length % 8 and len(alive):
        d = max(0, length - 8)
        if length >= 8:
            alive = alive[word[x[alive] + d] == word[y[alive] + d]]
        else:
            shift = np.uint64(8 * (8 - length))
            alive = alive[word[x[alive]] >> shift == word[y[alive]] >> shift]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def repeated_starts(contexts: list[bytes], spans: list[int], length: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per context the starts below its span whose window of length bytes also starts in another place among them all, and
    those whose window of reach bytes does. One suffix array serves both."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(size) - size
    span = np.array(spans, np.int64)
    order = two_stage(text, base, base + span - 1, reach)
    owner = np.searchsorted(base, order, side="right") - 1
    inside = order - base[owner] < span[owner]
    order, owner = order[inside], owner[inside]
    hits = []
    for n in (length, reach):
        whole = order[order + n <= (base + size)[owner]]
        same = adjacent_repeats(text, whole, n)
        hit = np.zeros(len(text), bool)
        hit[whole[:-1][same]] = True
        hit[whole[1:][same]] = True
        hits.append(hit)
    return [tuple(np.flatnonzero(hit[b : b + s]) for hit in hits) for b, s in zip(base.tolist(), span.tolist(), strict=True)]


def intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as runs (first, last)."""
    cut = np.append(True, np.diff(starts) != 1) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] if len(starts) else starts


def find_runs(docs: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """The runs of all documents: d, th, a, b, p (the minimizer), h (its hash) and sure. Neighbouring runs of equal bytes up
    to reach, as in periodic texts, repeat each other: the first of them (2) is compared for all, the others (1) are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raw = [x if len(x) >= length else b"" for x in texts(batch.column("text"))]
            if not any(raw):
                continue
            d, th = batch.column("d").to_numpy(), batch.column("th").to_numpy()
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            whole = b"".join(raw)
            flat, ends = np.frombuffer(whole, np.uint8), np.cumsum(size)
            for x in range(0, len(flat), PART):  # one part but for texts of megabytes
                stop = min(len(flat), x + PART + length - 1)
                cuts = np.unique(np.clip(ends, x, stop)) - x
                a, b, p, h = runs_of(flat[x:stop], cuts[cuts > 0], length, gram)
                if len(a):
                    yield judged(whole, d, th, ends, a + x, b + x, p + x, h.view(np.int64))

    def judged(whole: bytes, d: np.ndarray, th: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        doc = np.searchsorted(ends, a, side="right")
        view, sure = memoryview(whole), np.zeros(len(a), np.int8)
        alike = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (b[1:] - a[1:] == b[:-1] - a[:-1]) & (p[1:] - a[1:] == p[:-1] - a[:-1]) & (b[1:] + reach <= ends[doc[1:]])
        for i in np.flatnonzero(alike).tolist():
            if view[a[i] : b[i] + reach] == view[a[i + 1] : b[i + 1] + reach]:
                sure[i] = sure[i] or 2
                sure[i + 1] = 1
        # sure runs that touch become one
        touch = np.append(False, (sure[1:] == 1) & (sure[:-1] == 1) & (doc[1:] == doc[:-1]) & (a[1:] <= b[:-1] + 1))
        first = np.flatnonzero(~touch)
        b = np.maximum.reduceat(b, first)
        a, p, h, sure, doc = (v[first] for v in (a, p, h, sure, doc))
        begin = np.concatenate([[0], ends[:-1]])[doc]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (d[doc], th[doc], a - begin, b - begin, p - begin, h, sure)], names=["d", "th", "a", "b", "p", "h", "sure"])

    return docs.mapInArrow(run, "d long, th long, a long, b long, p long, h long, sure byte")


#: A run's bytes up to reach behind its last start: e is the last start with reach bytes, o the minimizer's place, n the size
#: of the group; known ones need no answer. kind: 0 for both lengths, 1 for windows of length bytes, 2 for those of reach.
CONTEXTS = "h long, d long, th long, a long, b long, e long, o long, n long, known boolean, kind long, bytes binary"
FIELDS = [x.split()[0] for x in CONTEXTS.split(", ")]


def context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


def contexts_of(asked: DataFrame, docs: DataFrame, reach: int, few: bool = False) -> DataFrame:
    """The CONTEXTS of the runs asked for (h, d, th, a, b, p, n, known); if they are few they are broadcast."""
    asked = asked.groupBy("d", "th").agg(F.collect_set(F.struct("a", "b", "p", "h", "n", "known")).alias("rs"))
    held = docs.join(F.broadcast(asked) if few else asked, ["d", "th"]).select("d", "th", "text", "rs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for d, th, raw, rs in zip(batch.column("d").to_pylist(), batch.column("th").to_pylist(), texts(batch.column("text")), batch.column("rs").to_pylist(), strict=True):
                for r in rs:
                    a, b = r["a"], r["b"]
                    rows.append((r["h"], d, th, a, b, max(a - 1, min(b, len(raw) - reach)), r["p"] - a, r["n"], r["known"], 0, raw[a : b + reach]))
                    if len(rows) == 20_000:
                        yield context_batch(rows)
                        rows = []
            if rows:
                yield context_batch(rows)

    return held.mapInArrow(cut, CONTEXTS)


def whole_spans(rows: DataFrame, length: int, reach: int) -> DataFrame:
    """SPANS of runs (d, th, a, b, e, kind) that repeat throughout."""
    long = F.when((F.col("kind") != 1) & (F.col("e") >= F.col("a")) & F.lit(reach > length), F.struct("a", F.col("e").alias("b"), F.lit(reach).cast("long").alias("size")))
    short = F.when(F.col("kind") != 2, F.struct("a", "b", F.lit(length).cast("long").alias("size")))
    return rows.select("d", "th", F.explode(F.array_compact(F.array(short, long))).alias("s")).select("d", "th", "s.a", "s.b", "s.size")


def compare_groups(contexts: DataFrame, length: int, reach: int, shard_bytes: int) -> DataFrame:
    """SPANS of windows repeated among the contexts of a group; groups are brought together here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["h"] != last and size >= shard_bytes:
                    yield from answer(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row["bytes"])
                last = row["h"]
        if rows:
            yield from answer(rows)

    def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[int, int, int, bytes], int] = {}
        which = [numbers.setdefault((r["h"], r["kind"], r["b"] - r["a"], r["bytes"]), len(numbers)) for r in rows]
        copies = np.bincount(which, minlength=len(numbers))
        different = Counter(h for h, *_ in numbers)
        asked = [(i, x, last + 1) for i, (h, kind, last, x) in enumerate(numbers) if different[h] > 1 and kind == 0]
        starts = dict(zip((i for i, *_ in asked), repeated_starts([x for _, x, _ in asked], [n for *_, n in asked], length, reach), strict=True)) if asked else {}
        out = []
        for r, k in zip(rows, which, strict=True):
            if r["known"]:
                continue
            at = (r["d"], r["th"])
            if copies[k] > 1:
                if r["kind"] != 2:
                    out.append((*at, r["a"], r["b"], length))
                if r["kind"] != 1 and r["e"] >= r["a"] and reach > length:
                    out.append((*at, r["a"], r["e"], reach))
            elif k in starts:
                for size, found in zip((length, reach) if reach > length else (length,), starts[k], strict=False):
                    out += [(*at, r["a"] + i, r["a"] + j, size) for i, j in zip(*(x.tolist() for x in intervals(found)), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["d", "th", "a", "b", "size"])

    rows = contexts.select("h", "d", "th", "a", "b", "e", "known", "kind", "bytes")
    return rows.repartition(partitions(contexts.sparkSession), "h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def drop_copies(contexts: DataFrame, salted: bool) -> DataFrame:
    """CONTEXTS and told. Equal contexts of a group, dealt by content, and if salted over about the root of the group's size,
    are compared as bytes. All but one that meet are told to be repeats and need no more; that one goes on, known."""
    salt = F.pmod(F.xxhash64("d", "th", "a", F.lit(23)), F.ceil(F.sqrt("n")).cast("long")) if salted else F.lit(0).cast("long")
    dealt = contexts.select(*FIELDS, F.xxhash64("kind", "bytes").alias("key"), salt.alias("salt"))
    dealt = dealt.repartition(partitions(contexts.sparkSession), "h", "key", "salt").sortWithinPartitions("h", "key", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if group != (r["h"], r["key"], r["salt"]):
                    out += [(x, False) for x in firsts]
                    group, firsts = (r["h"], r["key"], r["salt"]), []
                first = next((x for x in firsts if (x["kind"], x["b"] - x["a"], x["bytes"]) == (r["kind"], r["b"] - r["a"], r["bytes"])), None)
                if first is None:
                    firsts.append(r)
                    continue
                if not first["known"]:
                    out.append((dict(first), True))
                    first["known"] = True
                if not r["known"]:
                    out.append((r, True))
            if out:
                yield told(out)
        if firsts:
            yield told([(x, False) for x in firsts])

    def told(rows: list[tuple[dict, bool]]) -> pa.RecordBatch:
        batch = context_batch([(*(r[k] for k in FIELDS[:-1]), b"" if done else r["bytes"]) for r, done in rows])
        return batch.append_column("told", pa.array([done for _, done in rows]))

    return dealt.mapInArrow(run, f"{CONTEXTS}, told boolean")


def cut_finer(contexts: DataFrame, length: int, reach: int, step: int) -> DataFrame:
    """CONTEXTS of shorter runs: step neighbouring windows by their distance to the minimizer, in groups by the bytes that
    these windows share. Equal windows have equal distances and share those bytes, so they still meet. With a step of one
    only equal windows do, and windows of length and of reach bytes go apart."""

    def pieces(r: dict) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(hash, first start, last start, kind, bytes)"""
        x, span, o = r["bytes"], r["b"] - r["a"] + 1, r["o"]
        for k in range((o - span + 1) // step, o // step + 1):
            at = o - k * step  # the last of the windows, whose bytes they all share but for the last step - 1
            i, j = max(0, at - step + 1), min(span - 1, at)
            if step > 1 or reach == length:
                yield xxhash.xxh3_64_intdigest(x[at : at - step + 1 + length], k), i, j, 0, x[i : j + reach]
                continue
            yield xxhash.xxh3_64_intdigest(x[i : i + length], 1), i, i, 1, x[i : i + length]
            if r["a"] + i <= r["e"]:
                yield xxhash.xxh3_64_intdigest(x[i : i + reach], 2), i, i, 2, x[i : i + reach]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for h, i, j, kind, x in pieces(r):
                    a, b = r["a"] + i, r["a"] + j
                    rows.append((h - (1 << 64) if h >> 63 else h, r["d"], r["th"], a, b, max(a - 1, min(b, r["e"])), r["o"] - i, r["n"], r["known"], kind, x))
                if len(rows) >= 10_000:
                    yield context_batch(rows)
                    rows = []
            if rows:
                yield context_batch(rows)

    return contexts.select(*FIELDS).mapInArrow(run, CONTEXTS)


def repeated_spans(docs: DataFrame, length: int, reach: int, gram: int, cap: int, different: int, shard_bytes: int, few: int = 200_000) -> DataFrame:
    """SPANS of the window starts of docs (d, th, text) whose window of size (length or reach) bytes also starts elsewhere."""
    runs = materialize(find_runs(docs, length, gram, reach), "runs")
    compared = runs.where("sure <> 1")
    # sizes are written, so that a frequent group's rows can be split in the join
    sizes = materialize(compared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "group-sizes")
    asked = materialize(compared.join(sizes, "h").select("h", "d", "th", "a", "b", "p", "n", (F.col("sure") == 2).alias("known")), "asked")
    sure = materialize(runs.where("sure > 0").select("d", "th", "a", "b", F.col("b").alias("e"), F.lit(0).cast("long").alias("kind")), "sure")
    discard(runs)
    spans = [whole_spans(sure, length, reach), compare_groups(contexts_of(asked.where(F.col("n") <= cap), docs, reach), length, reach, shard_bytes)]
    n_wide = sizes.where(F.col("n") > cap).agg(F.sum("n")).first()[0]
    wide = materialize(contexts_of(asked.where(F.col("n") > cap), docs, reach, n_wide <= few), "contexts") if n_wide else None
    used = [sizes, asked, sure, *([wide] if n_wide else [])]
    for step in (16, 4, 1, None):
        if wide is None:
            break
        for salted in (True, False):
            told = materialize(drop_copies(wide, salted), "contexts-once")
            used.append(told)
            spans.append(whole_spans(told.where("told"), length, reach))
            wide = told.where("not told").drop("told")
        sizes = materialize(wide.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "group-sizes")
        used.append(sizes)
        wide = wide.drop("n").join(sizes, "h")
        spans.append(compare_groups(wide if step is None else wide.where(F.col("n") <= different), length, reach, shard_bytes))
        rest = None if step is None or sizes.where(F.col("n") > different).isEmpty() else wide.where(F.col("n") > different)
        wide = None if rest is None else materialize(cut_finer(rest, length, reach, step), "contexts-cut")
        used += [] if wide is None else [wide]
    found = materialize(reduce(DataFrame.unionByName, spans), "repeats")
    discard(*used)
    return found


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 400, gram: int = 128, least_words: int = 0, always: int | None = None, passage: int | None = None, cap: int = 4096, different: int = 16_384, shard_bytes: int = 2 << 20) -> DataFrame:
    """The columns of keep, n_bytes, spans (array of start and end of the maximal removed runs) and kept (the other bytes).

    A byte goes if some string of length bytes over it also starts anywhere else in the texts, in the same one included;
    strings overlap freely and are judged on the input. Texts are UTF-8 bytes or binary, null is empty. Repeated rows
    repeat each other. Other columns don't matter, and those of keep may have any name but n_bytes, spans, kept and
    passages, which raise; an empty table gives no rows. gram is a power of two below length.

    With least_words a maximal run of so many words or fewer stays, unless it has always bytes or more. With passage,
    a shorter length, there is a further column passages: the maximal runs of repeats of passage bytes that have over
    least_words words or length bytes; spans and kept aren't changed by it. Both come from the same suffix arrays.

    Memory per task: a batch of about a megabyte of text or one longer text, the runs of one document, or one shard of
    contexts: shard_bytes and a group of at most different contexts of less than twice the longer length (13 MB, for which
    the suffix array takes about 0.3 GB).
    """
    if taken := {"n_bytes", "spans", "kept", "passages"} & set(keep):
        raise ValueError(f"columns of the result can't be kept: {sorted(taken)}")
    if always is None:
        always = length
    base = docs.select(F.struct(*keep).alias("keep") if keep else F.struct(F.lit(0)).alias("keep"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    base = base.withColumns({"th": F.xxhash64("text"), "d": F.xxhash64("keep", F.lit(3))})
    keyed = base.select("d", "th", "text")
    short = length if passage is None else passage
    hits = repeated_spans(keyed, short, length, gram if passage is None else min(gram, 1 << (short // 5).bit_length() - 1), cap, different, shard_bytes)
    hits = hits.groupBy("d", "th").agg(F.collect_set(F.struct("size", "a", "b")).alias("hits"))
    joined = base.join(hits, ["d", "th"], "left").select("keep", "text", "hits")
    span = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = joined.select("keep").schema.add("n_bytes", "long").add("spans", span).add("kept", "binary").add("passages", span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text", 4 << 20):
            raw, spans, kept, passages = texts(batch.column("text")), [], [], []
            for x, found in zip(raw, batch.column("hits").to_pylist(), strict=True):
                cut = [merged([(h["a"], h["b"] + size) for h in found or () if h["size"] == size]) for size in (length, passage)]
                enough = [(a, b) for a, b in cut[0 if passage is None else 1] if not least_words or b - a >= always or len(x[a:b].split()) > least_words]
                if passage is None:
                    cut[0] = enough
                edges = [0, *(v for s in cut[0] for v in s), len(x)]
                kept.append(b"".join(x[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if cut[0] else x)
                spans.append([{"start": a, "end": b} for a, b in cut[0]])
                passages.append([{"start": a, "end": b} for a, b in enough])
            yield pa.RecordBatch.from_arrays([batch.column("keep"), pa.array([len(x) for x in raw], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(passages, kind)], names=["keep", "n_bytes", "spans", "kept", "passages"])

    out = joined.mapInArrow(run, schema)
    columns = [*(F.col("keep")[c].alias(c) for c in keep), "n_bytes", "spans", "kept"]
    return out.select(*columns) if passage is None else out.select(*columns, "passages")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching (start, end) as maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
