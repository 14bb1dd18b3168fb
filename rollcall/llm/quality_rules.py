"""Quality rules as weak supervision: votes, expectation-maximisation over vote patterns, posterior probabilities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_same", "n_plain"]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
BANG = np.zeros(256, bool)
BANG[ord("!")] = True
#: Ends of plain words: letters and digits (all bytes beyond ASCII count), or one mark behind one of these.
SOLID = LETTER.copy()
SOLID[48:58] = True
SOLID[128:] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:?!'\")")] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False
LEAD &= ~SPACE


def repeated(ids: np.ndarray) -> int:
    """Words that lie in some window of three words that the text holds twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if ids.max() >= 1 << 21:
        _, ids = np.unique(ids, return_inverse=True)
    if ids.max() >= 1 << 21:  # more distinct words than three fit into 63 bits: number the pairs first
        _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
        key = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    else:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def text_stats(docs: list[bytes], numbers: defaultdict) -> dict[str, np.ndarray]:
    """STATS of each text. Words are runs of bytes other than ASCII white space; numbers is the word numbering so far."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.frombuffer(b"".join(docs), np.uint8)
    starts = np.cumsum(sizes) - sizes

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[starts + sizes] - sums[starts]

    out = {"word_chars": total(LEAD[flat]), "n_symbols": total(SYMBOL[flat]), "n_upper": total(UPPER[flat]), "n_letters": total(LETTER[flat]), "n_bangs": total(BANG[flat])}
    blank = SPACE[flat]
    final = ~blank
    if len(flat):
        final[:-1] &= blank[1:]
    final[starts[sizes > 0] + sizes[sizes > 0] - 1] |= ~blank[starts[sizes > 0] + sizes[sizes > 0] - 1]  # a text's last byte ends its last word
    before = np.concatenate([np.zeros(1, np.uint8), flat[:-1]])
    begins = np.zeros(len(flat), bool)
    begins[starts[sizes > 0]] = True
    out["n_plain"] = total(final & (SOLID[flat] | (MARK[flat] & SOLID[before] & ~begins)))
    per_doc = np.zeros((len(docs), 5), np.int64)
    get = numbers.__getitem__
    for i, text in enumerate(docs):
        words = text.split()
        ids = np.fromiter(map(get, words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        per_doc[i] = len(words), len(lines) - len(set(lines)), repeated(ids), len(lines), (ids[1:] == ids[:-1]).sum()
    return out | {k: per_doc[:, i] for i, k in enumerate(("n_words", "n_dup_lines", "n_repeat_words", "n_lines", "n_same"))}


def stats_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and STATS of every whole text; null text counts as empty. One Arrow pass, no shuffle."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    for k in STATS:
        schema = schema.add(k, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict = defaultdict(count().__next__)
        for batch in slices(batches, "text"):
            if len(numbers) > 500_000:
                numbers = defaultdict(count().__next__)
            found = text_stats(texts(batch.column("text")), numbers)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k], pa.int64()) for k in STATS)], names=["doc_id", *STATS])

    return frame.mapInArrow(run, schema)


def votes() -> dict[str, tuple[Column, Column]]:
    """Each rule's (bad, good) condition; neither: it abstains."""
    c = F.col
    words, chars, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    return {
        "symbols": (c("n_symbols") > 0.05 * chars, c("n_symbols") < 0.01 * chars),
        "plain_words": (c("n_plain") < 0.75 * words, c("n_plain") > 0.9 * words),
        "capitals": (c("n_upper") > 0.5 * letters, c("n_upper") < 0.2 * letters),
        "shouting": (c("n_bangs") > 0.25 * words, c("n_bangs") < 0.03 * words),
        "repetition": (c("n_repeat_words") > 0.4 * words, c("n_repeat_words") < 0.15 * words),
        "stutter": (c("n_same") > 0.25 * words, c("n_same") < 0.05 * words),
        "lines": (c("n_dup_lines") > 0.4 * lines, c("n_dup_lines") <= 0.05 * lines),
        "word_length": ((c("word_chars") < 2.2 * words) | (c("word_chars") > 14 * words), (c("word_chars") > 3 * words) & (c("word_chars") < 11 * words)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation. patterns: rows of votes (0 abstains, 1 bad, 2 good); counts: documents of each.

    Returns the share of good documents and, by class (bad, good) and rule, the probability of each vote. The start says
    that a complaint is rarely wrong while an approval says little, since a rule looks for one kind of fault only:
    without this the bad class would settle on the one kind that breaks most rules at once. Pseudo-counts of the start keep
    a rule that rarely votes where it was.
    """
    n = patterns.shape[1]
    start = np.array([[0.1, 0.3, 0.6], [0.08, 0.02, 0.9]])
    table = np.repeat(start[:, None, :], n, 1)
    prior, prior_n = 0.8, 10.0
    total = counts.sum()
    for _ in range(rounds):
        post = posterior(patterns, prior, table)
        weight = counts * post
        fresh = np.stack([[[(w[patterns[:, j] == v]).sum() for v in range(3)] for j in range(n)] for w in (counts - weight, weight)])
        fresh = fresh + prior_n * start[:, None, :]
        fresh /= fresh.sum(2, keepdims=True)
        now = (weight.sum() + 8) / (total + 10)
        moved = abs(now - prior) + np.abs(fresh - table).max()
        prior, table = now, fresh
        if moved < 1e-9:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """The probability that a document with these votes is good."""
    rules = np.arange(patterns.shape[1])
    odds = np.log(prior) - np.log1p(-prior) + (np.log(table[1][rules, patterns]) - np.log(table[0][rules, patterns])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, STATS, base_failed, posterior (the probability that it is good) and kept of every document.

    base_failed: under 50 words, or over half of the words in repeated windows of three words; such documents aren't kept.
    The statistics are written once. Vote patterns are counted with map-side aggregation; with eight rules there are at
    most 3 ** 8 of them, which is what reaches the driver and is joined back. Empty and null texts have no words and
    fail; repeated rows are judged alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rules = votes()
    code = F.lit(0)
    for bad, good in rules.values():
        code = code * 3 + F.when(bad, 1).when(good, 2).otherwise(0)
    stats = materialize(stats_of(docs, doc_id, text).withColumn("pattern", code.cast("int")), "quality-stats")
    seen = stats.groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r[0] for r in seen], np.int64)
    patterns = np.stack([codes // 3 ** (len(rules) - 1 - j) % 3 for j in range(len(rules))], 1) if len(codes) else np.zeros((0, len(rules)), np.int64)
    good = posterior(patterns, *fit(patterns, np.array([r[1] for r in seen], np.float64))) if len(codes) else []
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, good, strict=True)], "pattern int, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("pattern")
