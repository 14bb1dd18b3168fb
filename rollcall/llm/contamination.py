"""Documents that hold passages of a benchmark, by suffix arrays over shards of the documents.

A window is 10 consecutive words of an item, or all of an item that has fewer. Items are read in blocks of bounded size;
for each block the documents are read once, in shards of a few megabytes:

1. The words of a shard become numbers of the block's words, 0 for others. Words are looked up by a hash and then compared
   byte by byte, so equal numbers mean equal words.
2. The shard's suffixes that begin with enough known words (others can't hold a window) are sorted into a suffix array, by
   packing several words into one key and sorting the ranks again.
3. Every suffix of every item is looked up in it by binary search, all of them at once, which gives the range of its
   occurrences: their places are the hits.
4. For longest matches the windows take the place of words: where windows follow each other in a shard as they do in an
   item, the match goes on. A second, small array over those places is searched in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard
from .common import materialize, slices, texts

WINDOW = 10
#: Bytes of document text that make a shard, and of item text that make a block.
SHARD, BLOCK = 4 << 20, 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: where they are in the bytes, and which text each is of."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray

    def eight(self, k: int, which: np.ndarray) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of some words as numbers, zeros behind the end."""
        rows = np.lib.stride_tricks.sliding_window_view(self.flat, 8)[self.start[which] + 8 * k]
        have = np.minimum(self.size[which] - 8 * k, 8).astype(np.uint64)
        return (rows.view(">u8")[:, 0].astype(np.uint64) >> (np.uint64(64) - np.uint64(8) * have)) << (np.uint64(64) - np.uint64(8) * have)

    def hashes(self, seed: int) -> np.ndarray:
        h = (self.size.astype(np.uint64) + np.uint64(seed)) * MIX
        which, k = np.arange(len(self.size)), 0
        while len(which):
            x = (h[which] ^ self.eight(k, which)) * MIX
            h[which] = x ^ (x >> np.uint64(31))
            k += 1
            which = which[self.size[which] > 8 * k]
        return h


def words_of(docs: list[bytes]) -> Words:
    """A-Z count as a-z; runs of digits, a-z and bytes of code points from U+0080 on are words."""
    raw = b"\0".join(docs) + b"\0" * 16
    flat = LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate([[False], IS_WORD[flat]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
    return Words(flat, start, stop - start, np.searchsorted(ends, start, side="right"))


def laid_out(numbers: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words in one array with a 0 behind each text, and the places of the words in it."""
    at = np.arange(len(numbers)) + owner
    out = np.zeros(len(numbers) + n + WINDOW, np.int64)
    out[at] = numbers
    return out, at


def suffix_order(symbols: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places at in order of depth symbols from each on (places with equal ones next to each other, ascending).

    Several symbols are packed into a key; the ranks of the keys are the symbols of the next round, which covers as many
    times more.
    """
    if not len(at):
        return at
    live = np.flatnonzero(symbols)
    rank, covered = symbols, 1
    while True:
        bits = max(int(rank.max()).bit_length(), 1)
        many = min(63 // bits, -(-depth // covered))
        last = covered * many >= depth
        rows = at if last else live
        key = np.zeros(len(rows), np.int64)
        for j in range(many):
            place = rows + j * covered
            there = place < len(rank)
            key = (key << bits) | np.where(there, rank[np.minimum(place, len(rank) - 1)], 0)
        order = np.argsort(key, kind="stable")
        if last:
            return rows[order]
        key = key[order]
        dense = np.cumsum(np.append(True, key[1:] != key[:-1]))
        rank = np.zeros(len(symbols), np.int64)
        rank[rows[order]] = dense
        covered *= many


def compared(symbols: np.ndarray, at: np.ndarray, wanted: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-1, 0 or 1 as the suffix at each place is below, begins with, or is above wanted[start : start + size]; and how many
    symbols agree."""
    sign, same = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    open_, j = np.arange(len(at)), 0
    while len(open_ := open_[size[open_] > j]):
        place = at[open_] + j
        have = np.where(place < len(symbols), symbols[np.minimum(place, len(symbols) - 1)], 0)
        want = wanted[start[open_] + j]
        sign[open_] = np.sign(have - want)
        open_ = open_[have == want]
        same[open_] += 1
        j += 1
    return sign, same


def search(symbols: np.ndarray, order: np.ndarray, wanted: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string wanted[start : start + size] the range of the suffix array whose suffixes begin with it."""
    found = []
    for side in (0, 1):  # the first suffix that isn't below; the first that is above
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) // 2
            sign, _ = compared(symbols, order[mid], wanted, start[busy], size[busy])
            right = sign < side
            low[busy[right]] = mid[right] + 1
            high[busy[~right]] = mid[~right]
        found.append(low)
    return found[0], found[1]


class Suite:
    """A block of items, ready to be looked for: its distinct words and windows, and the items of each window.

    Items of one id are one item. items are (id, text) with ids as text.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.ids)}
        words = words_of([x for _, x in items])
        for seed in range(64):  # a seed under which the block's own words don't collide
            h = words.hashes(seed)
            order = np.argsort(h, kind="stable")
            first = np.append(True, h[order][1:] != h[order][:-1]) if len(h) else np.zeros(0, bool)
            kind = np.zeros(len(h), np.int64)
            kind[order] = np.cumsum(first)
            lead = order[first]
            if len(h) == 0 or _alike(words, np.arange(len(h)), words, lead[kind - 1]).all():
                break
        else:
            raise RuntimeError("no seed tells all words of the block apart")
        self.seed = seed
        self.hash = h[order][first]
        self.lead = Words(words.flat, words.start[lead], words.size[lead], words.owner[lead])  # a place of each distinct word
        self.symbols, at = laid_out(kind, words.owner, len(items))
        count = np.bincount(words.owner, minlength=len(items))
        place = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(count[words.owner], window)
        whole = (place + size <= count[words.owner]) & ((size == window) | (place == 0))
        self.item = np.array([number[i] for i, _ in items], np.int64)[words.owner[whole]] if len(kind) else np.zeros(0, np.int64)
        self.place = place[whole]  # word of its item at which each window starts
        at, size = at[whole], size[whole]
        # equal windows: neighbours in the suffix array of the block's own words
        same = suffix_order(self.symbols, at, window)
        long = np.zeros(len(self.symbols), np.int64)
        long[at] = size
        here, there = same[1:], same[:-1]
        _, agree = compared(self.symbols, here, self.symbols, there, long[there])
        new = np.append(True, (long[here] != long[there]) | (agree < long[there])) if len(same) else np.zeros(0, bool)
        name = np.zeros(len(self.symbols), np.int64)
        name[same] = np.cumsum(new)
        self.start, self.size = same[new], long[same[new]]  # the distinct windows, numbered from 1 in name
        self.shortest = int(self.size.min()) if len(self.size) else window
        self.names = np.where(long == window, name, 0)  # windows of full length, in place of words
        self.at, self.name = at, name[at]
        # the items of each window as one of few distinct sets
        sets: dict[bytes, int] = {}
        pairs = np.unique(self.name * max(len(self.ids), 1) + self.item) if len(self.item) else np.zeros(0, np.int64)
        owner, item = pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)
        cut = np.searchsorted(owner, np.arange(1, len(self.start) + 2))
        self.set_of = np.fromiter((sets.setdefault(item[a:b].tobytes(), len(sets)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), np.int64, len(self.start))
        self.sets = [np.frombuffer(x, np.int64) for x in sets]

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word among the block's, 0 for words that it doesn't have."""
        if not len(self.hash) or not len(words.start):
            return np.zeros(len(words.start), np.int64)
        h = words.hashes(self.seed)
        near = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        found = np.flatnonzero(self.hash[near] == h)
        out = np.zeros(len(h), np.int64)
        real = _alike(words, found, self.lead, near[found])
        out[found[real]] = near[found[real]] + 1
        return out

    def occurrences(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; places of its words in the array of the shard; and for each place where a window starts the
        window, the text and the word."""
        words = words_of(docs)
        symbols, at = laid_out(self.numbers(words), words.owner, len(docs))
        count = np.bincount(words.owner, minlength=len(docs))
        known = np.minimum.accumulate(np.where(symbols == 0, np.arange(len(symbols)), len(symbols))[::-1])[::-1] - np.arange(len(symbols))
        order = suffix_order(symbols, at[known[at] >= self.shortest], self.window)
        low, high = search(symbols, order, self.symbols, self.start, self.size)
        many = high - low
        window = np.repeat(np.arange(len(many)), many)
        inner = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
        place = order[np.repeat(low, many) + inner]
        first = np.cumsum(count + 1) - (count + 1)  # where each text starts in symbols
        doc = np.searchsorted(first, place, side="right") - 1
        return count, place, window, doc, place - first[doc]

    def hits(self, docs: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its words, the first and the end of each maximal run of hit words, and the numbers of its items."""
        count, _, window, doc, word = self.occurrences(docs)
        if not len(doc):
            none = np.zeros(0, np.int64)
            return [(n, none, none, none) for n in count.tolist()]
        base = np.cumsum(count + 1) - (count + 1)
        cover = np.zeros(int(count.sum()) + len(docs) + 1, np.int64)
        np.add.at(cover, base[doc] + word, 1)
        np.add.at(cover, base[doc] + word + self.size[window], -1)
        inside = np.concatenate([[False], np.cumsum(cover) > 0])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edge[0::2], edge[1::2]
        owner = np.searchsorted(base, first, side="right") - 1
        cut = np.searchsorted(owner, np.arange(len(docs) + 1))
        pairs = np.unique(doc * len(self.sets) + self.set_of[window])
        of = np.searchsorted(pairs // len(self.sets), np.arange(len(docs) + 1))
        out = []
        for i, n in enumerate(count.tolist()):
            sets = [self.sets[s] for s in (pairs[of[i] : of[i + 1]] % len(self.sets)).tolist()]
            spans = slice(cut[i], cut[i + 1])
            out.append((n, first[spans] - base[i], end[spans] - base[i], np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)))
        return out

    def longest(self, docs: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, its word, words, doc id, its word) of the longest match of each suffix of an item that has a window here;
        of equally long ones that with the least id and place."""
        count, place, window, doc, word = self.occurrences(docs)
        shard = np.zeros(int(count.sum()) + len(docs) + self.window, np.int64)
        full = self.size[window] == self.window
        shard[place[full]] = window[full] + 1
        by = np.lexsort((word, ids[doc]))  # of equal suffixes the one with the least id comes first
        value = np.zeros(len(place), np.int64)
        value[by] = np.arange(len(place))
        best = np.zeros(len(shard), np.int64)
        best[place[full]] = value[full]
        run = np.minimum.accumulate(np.where(self.names == 0, np.arange(len(self.names)), len(self.names))[::-1])[::-1] - np.arange(len(self.names))
        here = np.isin(self.name - 1, window)  # windows of items that occur in the shard
        asked = self.at[here & (self.names[self.at] > 0)]
        order = suffix_order(shard, np.flatnonzero(shard), int(run.max(initial=1)))
        low, _ = search(shard, order, self.names, asked, run[asked])
        reach = np.zeros(len(asked), np.int64)
        for side in (low - 1, low):
            there = (side >= 0) & (side < len(order))
            _, same = compared(shard, order[side[there]], self.names, asked[there], run[asked][there])
            reach[there] = np.maximum(reach[there], same)
        a, b = search(shard, order, self.names, asked, reach)
        rows = [(a, b, asked, reach + self.window - 1, best[order])]
        short = self.at[here & (self.names[self.at] == 0)]
        if len(short):  # items that are one window of fewer words
            at_window = np.zeros(len(self.symbols), np.int64)
            at_window[self.at] = self.name - 1
            sorted_ = np.argsort(window, kind="stable")
            a = np.searchsorted(window[sorted_], at_window[short])
            b = np.searchsorted(window[sorted_], at_window[short], side="right")
            rows.append((a, b, short, self.size[at_window[short]], value[sorted_]))
        item, start = np.zeros(len(self.symbols), np.int64), np.zeros(len(self.symbols), np.int64)
        item[self.at], start[self.at] = self.item, self.place
        out = []
        for a, b, of, size, values in rows:
            if not len(a):
                continue
            pair, back = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
            least = np.fromiter((values[x:y].min() for x, y in pair.T.tolist()), np.int64, pair.shape[1])[back.reshape(-1)]
            out.append((item[of], start[of], size, ids[doc[by[least]]], word[by[least]]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _alike(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b have the same bytes."""
    same, k = a.size[i] == b.size[j], 0
    open_ = np.flatnonzero(same)
    while len(open_):
        equal = a.eight(k, i[open_]) == b.eight(k, j[open_])
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal]
        open_ = open_[a.size[i[open_]] > 8 * k]
    return same


def pieces(text: bytes, limit: int, window: int) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces of about limit bytes, or as many more as window words take, that share window - 1 words, with
    the number of each one's first word. A word is never cut."""
    begin = end = first = 0
    while len(text) - max(begin, end - 1) > limit:
        end = max(begin, end) + limit
        while end < len(text) and IS_WORD[LOWER[text[end]]]:
            end += 1
        words = words_of([text[begin:end]])
        n = len(words.start)
        if n >= window:
            yield first, text[begin:end]
            first += n - window + 1
            begin, end = begin + int(words.start[n - window + 1]) if window > 1 else end, 0
        elif not n:
            begin, end = end, 0
    yield first, text[begin:]


def joined(parts: list[tuple[int, tuple]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Hits of the pieces of one text as those of the text."""
    n = max(at + x[0] for at, x in parts)
    first = np.concatenate([x[1] + at for at, x in parts])
    end = np.concatenate([x[2] + at for at, x in parts])
    return n, *merged(first, end), np.unique(np.concatenate([x[3] for _, x in parts]))


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch as one."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    return first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, limit: int) -> Iterator[Suite]:
    """The items in blocks of about limit bytes, dealt by a hash of the id. Rows without words are no items; those without an
    id share the empty one."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)).collect()
        yield Suite([(r["id"], r["text"].encode("utf-8", "replace")) for r in rows], window)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """docs with n_words (long), spans (array of start and end: maximal runs of hit words) and items (sorted array of the ids,
    as text, of items with a window in the document).

    Null texts have no words. Every window that occurs counts, also in texts longer than a shard, which are read in pieces.
    A benchmark of over block bytes is looked for in several passes. The added names must not be among docs' columns.
    """
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    if clash := {f.name for f in added} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are what scan adds")
    out = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    schema, before = out.schema, None
    for suite in blocks(benchmark, item_id, item_text, window, block):
        if before is not None:
            out = materialize(out, "contamination")
            if before is not docs:
                discard(before)
        before = docs if before is None else out
        shared = spark.sparkContext.broadcast(suite)
        out = out.mapInArrow(_pass(shared, text, window, shard), schema)
    return out


def _pass(shared, text: str, window: int, shard: int):
    """One block's hits added to what n_words, spans and items hold already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suite: Suite = shared.value
        for batch in slices(batches, text, shard):
            raw = texts(batch.column(text))
            if len(raw) == 1 and len(raw[0]) > shard:
                found = [joined([(at, suite.hits([part])[0]) for at, part in pieces(raw[0], shard, window)])]
            else:
                found = suite.hits(raw)
            spans, items = [], []
            held_spans, held_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for (_, first, end, own), old, known in zip(found, held_spans, held_items, strict=True):
                if old:
                    first, end = merged(np.append(first, [s["start"] for s in old]), np.append(end, [s["end"] for s in old]))
                spans.append((first, end))
                items.append(sorted({*(suite.ids[k] for k in own.tolist()), *(known or ())}, key=lambda s: s.encode()))
            counts = np.array([len(a) for a, _ in spans], np.int64)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([s[k] for s in spans]), pa.int64()) for k in (0, 1)], names=["start", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            new = {"n_words": pa.array([x[0] for x in found], pa.int64()), "spans": pa.ListArray.from_arrays(offsets, flat), "items": pa.array(items, pa.list_(pa.string()))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def covered(spans) -> "F.Column":
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs less those that hold a window of an item; columns as they were. See scan for the options."""
    return scan(docs, benchmark, **options).where(F.size("spans") == 0).select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """For each suffix of an item (item_id as text, start: its first word) that a document holds from that word on over a
    window or more, the longest match: words, and doc_id and at (its first word there) of the place, the least of equally
    long ones. doc_id is a whole number; documents without one and texts without words match nothing. In texts longer than
    a shard a match ends with its piece (pieces share window - 1 words)."""
    spark = docs.sparkSession
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for suite in blocks(benchmark, item_id, item_text, window, block):
        shared = spark.sparkContext.broadcast(suite)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            suite: Suite = shared.value
            for batch in slices(batches, "text", shard):
                raw, ids = texts(batch.column("text")), batch.column("doc_id").to_numpy()
                if len(raw) == 1 and len(raw[0]) > shard:
                    todo = [([part], at) for at, part in pieces(raw[0], shard, window)]
                else:
                    todo = [(raw, 0)]
                for own, at in todo:
                    item, start, size, doc, word = suite.longest(own, ids)
                    name = pa.array([suite.ids[k] for k in item.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([name, *(pa.array(x, pa.int64()) for x in (start, size, doc, word + at))], names=["item_id", "start", "words", "doc_id", "at"])

        parts.append(own.mapInArrow(run, "item_id string, start long, words long, doc_id long, at long"))
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionAll(x)
    best = whole.groupBy("item_id", "start").agg(F.min(F.struct((-F.col("words")).alias("less"), "doc_id", "at")).alias("m"))
    return best.select("item_id", "start", (-F.col("m.less")).alias("words"), "m.doc_id", "m.at")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    hit = covered(F.col("spans"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (hit > 0).alias("contaminated"))
