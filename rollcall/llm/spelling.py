"""Spelling variants: words of a corpus that differ by one code point, and the common form that each leads to.

Near words are found by pivotal grams. All bigrams are ordered by how often they occur in the words; a word's prefix is its
three rarest ones (with all places of the third, as far as they can matter), its pivots are two of these three that don't
overlap and are rarest together, chosen by dynamic programming. One edit spoils at most one of two disjoint grams, so of two
near words the one whose prefix ends earlier in the order has a pivot that stands in the other's prefix, at the same distance
from the start (if the edit is behind it) or from the end (if it is before it). That limit on places is sharp: on the
pivot's other side the words are equal, and of the side with the edit one half is equal too. Both equal parts are hashed into
the key under which pivots are indexed and prefixes looked up, so that keys hold few words besides near ones. Every pair
found is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard
from .common import materialize
from .merkle import LOWER, UPPER

PREFIX = 3
#: Of the prefix's last gram the first three places count as its own. One edit adds at most two places of a gram, so a place
#: among a near word's first three is among the first five here.
PLACES = 5
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BATCH = 20_000


def runs(text: Column, least: int) -> Column:
    """The maximal runs of letters of at least so many code points, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))


def corpus_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, least_n: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): the words of at least `least` code points that occur at least least_n times.

    With slip, a run loses one code point where slip divides the crc32 of `<doc_id>:<run>`: planted misspellings by which the
    operator can be judged (0 for none). A null id reads as empty; null texts have no words.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col(text), least)).alias("run"))
    word = F.col("run")
    if slip:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = h % F.length("run")
        cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
        word = F.when(h % slip == 0, cut).otherwise(word)
    found = rows.select(word.alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


class Flat:
    """Some words as one array of code points (all below 256), and the grams in them."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, number below 65,536) of each bigram."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        at = np.flatnonzero(word[1:] == word[:-1])
        return word[at], at - self.start[word[at]], self.points[at].astype(np.int64) << 8 | self.points[at + 1]

    def sums(self) -> None:
        """Makes part() ready."""
        place = np.arange(len(self.points)) - np.repeat(self.start, self.size)
        longest, one = int(self.size.max(initial=1)) + 1, np.ones(1, np.uint64)
        self.power, self.back = (np.cumprod(np.append(one, np.full(longest, b, np.uint64))) for b in (BASE, INVERSE))
        mixed = (self.points.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        self.total = np.append(np.zeros(1, np.uint64), np.cumsum(mixed * self.power[place]))

    def part(self, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of code points a to b (not included) of words."""
        at = self.start[word]
        return (self.total[at + b] - self.total[at + a]) * self.back[a]


def prefixes(word: np.ndarray, place: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of grams (word by word): those of prefixes, as indexes; whether each is a pivot; and the rank at which its prefix ends.

    Words have three grams at least. A prefix is the first three by rank and place, and of the third gram further places.
    """
    order = np.lexsort((place, rank, word))
    w, r = word[order], rank[order]
    head = np.append(True, w[1:] != w[:-1])
    first = np.flatnonzero(head)
    k = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    lead = np.flatnonzero(head | np.append(True, r[1:] != r[:-1]))
    nth = np.arange(len(w)) - np.repeat(lead, np.diff(np.append(lead, len(w))))
    last = np.repeat(r[first + PREFIX - 1], np.diff(np.append(first, len(w))))
    mine = (k < PREFIX) | ((r == last) & (nth < PLACES))
    three = order[first[:, None] + np.arange(PREFIX)]
    three = np.take_along_axis(three, np.argsort(place[three], axis=1), axis=1)
    pivot = np.zeros(len(word), bool)
    pivot[pivots(place[three], weight[three], three)] = True
    chosen = order[mine]
    return chosen, pivot[chosen], last[mine]


def pivots(place: np.ndarray, weight: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The names of two grams per row that don't overlap and weigh least together, of grams in order of place.

    best[c] is the least weight of c disjoint grams among those passed so far; a gram can follow what ended two places before.
    """
    n, m = place.shape
    none = np.iinfo(np.int64).max // 4
    one = np.full((n, m + 1), none)  # least weight of one gram among the first j, and which
    pick = np.zeros((n, m + 1), np.int64)
    two, left, right = np.full(n, none), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for j in range(m):
        before = (place[:, :j] <= place[:, j : j + 1] - 2).sum(1)  # grams that end before this one begins
        with_it = one[rows, before] + weight[:, j]
        better = with_it < two
        two[better] = with_it[better]
        left[better], right[better] = pick[rows, before][better], j
        less = weight[:, j] < one[:, j]
        one[:, j + 1] = np.where(less, weight[:, j], one[:, j])
        pick[:, j + 1] = np.where(less, j, pick[:, j])
    return np.concatenate([name[rows, left], name[rows, right]])


def keys(flat: Flat, word: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """For grams at places of words, the keys under which near words meet: (rows, whether as the longer word, key).

    The edit is behind the gram or before it, in a rest of m code points. A word stands for itself among words of its length
    and as the shorter one (rest m), and as the longer one (m - 1 without the added code point). With h half of that rest,
    its first h code points are equal or the others are.
    """
    size = flat.size[word]
    for behind in (True, False):
        rest = size - place - 2 if behind else place
        for longer in (False, True):
            m = rest - longer
            rows = np.flatnonzero(m >= 0)
            w, p, s, m = word[rows], place[rows], size[rows], m[rows]
            h = m // 2
            for front in (True, False):
                if not front:  # without a rest both halves are the same
                    some = np.flatnonzero(m > 0)
                    rows, w, p, s, m, h = (x[some] for x in (rows, w, p, s, m, h))
                zero = np.zeros_like(p)
                if behind:
                    kept, other = (flat.part(w, zero, p + 2 + h), None) if front else (flat.part(w, zero, p + 2), flat.part(w, s - (m - h), s))
                else:
                    kept, other = (flat.part(w, p, s), flat.part(w, zero, h)) if front else (flat.part(w, p - (m - h), s), None)
                key = kept * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(32)
                if other is not None:
                    key += other
                far = p if behind else s - p  # the place limit: distance from the end that the edit leaves alone
                tag = ((m * 4 + 2 * behind + front) << 32) + far
                key = (key + tag.astype(np.uint64) * np.uint64(BASE)) * np.uint64(0x94D049BB133111EB)
                yield rows, longer, key ^ (key >> np.uint64(31))


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            yield batch.slice(a, BATCH)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the 65,536 bigrams of code points below 256 occurs in distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches_of(batches):
            n += np.bincount(Flat(batch.column("word").to_pylist()).grams()[2], minlength=1 << 16)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["gram", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        out[r["gram"]] = r["n"]
    return out


def index(words: DataFrame) -> DataFrame:
    """words (word, n) as (key, word, n, last, pivot, longer): a row per gram of a prefix and key."""
    counts = gram_counts(words)
    rank = np.empty(1 << 16, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            flat = Flat(batch.column("word").to_pylist())
            if not len(flat.size):
                continue
            flat.sums()
            word, place, gram = flat.grams()
            chosen, pivot, last = prefixes(word, place, rank[gram], counts[gram])
            word, place = word[chosen], place[chosen]
            for rows, longer, key in keys(flat, word, place):
                of = pa.array(word[rows])
                columns = [pa.array(key.view(np.int64)), batch.column("word").take(of), batch.column("n").take(of), pa.array(last[rows], pa.int32()), pa.array(pivot[rows]), pa.array(np.full(len(rows), longer))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n", "last", "pivot", "longer"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, last int, pivot boolean, longer boolean")


def one_edit(a: Column, b: Column) -> Column:
    """Whether a and b differ by one inserted, deleted or replaced code point. Spark's edit distance takes time with the square
    of the length; words of over 64 code points are compared from where they part."""
    characters = lambda x: F.split(x, "")
    at = F.array_position(F.zip_with(characters(a), characters(b), lambda x, y: x.eqNullSafe(y)), False)
    n, m = F.length(a), F.length(b)
    tail = lambda x, skip: F.substring(x, at.cast("int") + F.when(skip, 1).otherwise(0), F.greatest(n, m))
    rest = (at > 0) & (F.abs(n - m) <= 1) & (tail(a, n >= m) == tail(b, m >= n))
    return F.when(F.greatest(n, m) <= 64, F.levenshtein(a, b, 1) == 1).otherwise(rest)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n) of all words (word, n) that differ by exactly one inserted, deleted or replaced code point, a < b.

    Words are distinct, of four code points at least, all below U+0100 (of letters, as corpus_words makes them).
    """
    rows = index(words)
    a = rows.where("pivot").select("key", *(F.col(c).alias(f"a_{c}") for c in ("word", "n", "last", "longer")))
    b = rows.select("key", *(F.col(c).alias(f"b_{c}") for c in ("word", "n", "last", "longer")))
    met = a.join(b, (a["key"] == b["key"]) & (F.col("a_last") <= F.col("b_last")) & ~(F.col("a_longer") & F.col("b_longer")) & (F.col("a_word") != F.col("b_word")))
    met = met.where(one_edit(F.col("a_word"), F.col("b_word")))
    less = F.col("a_word") < F.col("b_word")
    ends = {"a": ("a_word", "b_word"), "b": ("b_word", "a_word"), "a_n": ("a_n", "b_n"), "b_n": ("b_n", "a_n")}
    return met.select(*(F.when(less, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in ends.items())).distinct()


def roots(forms: DataFrame, name: str = "spelling-roots") -> DataFrame:
    """(word, root) of words with a form: each form's own form is followed to the last. n grows tenfold from word to form, so
    a chain has less than twenty words, and its unfinished part halves every round."""
    found = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), name)
    while True:
        up = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        later = materialize(found.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), name)
        discard(found)
        found = later
        if found.where("moved").isEmpty():
            return found.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of words (word, n).

    n_near counts the near words. form is the near word of largest n (of equals the smallest in code-point order) if that n
    is at least `times` the word's, else null; root is where the forms lead, the word itself if it has none. An empty table
    gives no rows.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    ways = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("form")).alias("to")) for x, y in ("ab", "ba"))))
    near = pairs.select(ways.alias("x")).groupBy("x.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x.to").alias("best"))
    out = words.join(near, "word", "left")
    real = -F.col("best.less") >= times * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(real, F.col("best.form")).alias("form"), F.when(real, -F.col("best.less")).alias("form_n"))
    out = materialize(out, "spelling-forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
