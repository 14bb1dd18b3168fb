"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax output, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices, texts
from .hashing import STEP, Words, buckets, chunks, fold_of, labelled_sample, numbered

SIZES = (3, 4, 5)
WORD, PAIR, SAME = 1, 2, 3


def terms(docs: list[bytes], bits: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], list[np.ndarray], list[np.ndarray]]:
    """The documents as word numbers; (word, bucket) of all words and their n-grams by kind; buckets of the documents'
    word pairs. A word that repeats the one before it makes the one pair term SAME, whatever the word."""
    distinct, lists = numbered([x.split() for x in docs])
    words = Words([w.decode("utf-8", "replace") for w in distinct])
    whole = words.whole()
    kinds = [(np.arange(len(distinct)), buckets(whole, WORD, bits))]
    for n in SIZES:
        word, h = words.ngrams(n)
        kinds.append((word, buckets(h, 10 + n, bits)))
    same = int(buckets(np.zeros(1, np.uint64), SAME, bits)[0])
    pairs = [np.where(x[1:] == x[:-1], same, buckets(whole[x[:-1]] * STEP + whole[x[1:]], PAIR, bits)) for x in lists]
    return lists, kinds, pairs, [np.bincount(w, minlength=len(distinct)) for w, _ in kinds]


class Model:
    """u: what each bucket adds to the difference of the two outputs; the score is the softmax of class 1."""

    def __init__(self, u: np.ndarray, bias: float, bits: int):
        self.u, self.bias, self.bits = u.astype(np.float32), float(bias), bits

    def score(self, docs: list[bytes]) -> np.ndarray:
        lists, kinds, pairs, counts = terms(docs, self.bits)
        value = sum(np.bincount(w, weights=self.u[b], minlength=len(c)) for (w, b), c in zip(kinds, counts, strict=True))
        number = sum(counts)
        out = np.empty(len(docs))
        for i, (x, p) in enumerate(zip(lists, pairs, strict=True)):
            n = number[x].sum() + len(p) if len(x) else 0
            out[i] = (value[x].sum() + self.u[p].sum(dtype=np.float64)) / n if n else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train(sample: Iterable[tuple[bytes, int]], bits: int = 18, dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, the rate falling to zero. Without both labels in the sample
    the model returns the share of label 1 for every text (one half without any). Texts become bucket numbers as they
    come, a hundred at a time."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    y: list[int] = []
    for part in chunks(sample):
        y += [v for _, v in part]
        lists, kinds, pairs, counts = terms([t for t, _ in part], bits)
        word = np.concatenate([w for w, _ in kinds])
        order = np.argsort(word, kind="stable")
        flat = np.concatenate([b for _, b in kinds])[order]
        ends = np.cumsum(sum(counts))
        for x, p in zip(lists, pairs, strict=True):
            size = (ends[x] - np.where(x > 0, ends[x - 1], 0)) if len(x) else x
            at = np.repeat(ends[x] - size - (np.cumsum(size) - size), size) + np.arange(size.sum()) if len(x) else x
            ids, n = np.unique(np.concatenate([flat[at], p]), return_counts=True)
            rows.append((ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
    share = (sum(y) + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(y)) < 2:
        return Model(np.zeros(1 << bits), prior, bits)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    o, b = np.zeros((dim, 2), np.float32), np.array([0, prior], np.float32)
    step, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            ids, w = rows[i]
            lr = np.float32(rate * (1 - step / total))
            step += 1
            h = w @ e[ids]
            z = h @ o + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = o @ g
            o -= lr * np.outer(h, g)
            b -= lr * 0.1 * g
            e[ids] -= (lr * dim) * w[:, None] * back
    return Model(e @ (o[:, 1] - o[:, 0]), b[1] - b[0], bits)


def with_score(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column, the model's score of text: one Arrow pass with the broadcast model, whose size its bits
    fix. A column of that name in docs must not exist."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        for batch in slices(batches, text, 4 << 20):
            score = scorer.score(texts(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scores(docs: DataFrame, model, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 5000, sample_bytes: int = 48 << 20, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    The model is fitted on at most sample_rows labelled rows of at most sample_bytes of text together, of the folds that
    aren't held out; it sees texts alone. Every whole text is scored; null and empty texts get the score of a text
    without terms; repeated rows get the same score; an empty table gives no rows.
    """
    return scores(docs, fit(docs, labels, label, sample_rows, sample_bytes), threshold)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 5000, sample_bytes: int = 48 << 20) -> Model:
    return train(labelled_sample(docs, labels, label, sample_rows, sample_bytes))
