"""Toxicity: a factorization machine over hashed terms, which learns what pairs of terms mean together."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .classifier import scores
from .hashing import Words, buckets, chunks, labelled_sample, numbered

#: A term is a word in lower case without the punctuation around it, or its first four or five letters.
WHOLE, STEMS = 1, (4, 5)
MARKS = ".,;:!?\"'()[]{}<>*#%&$|-_"


#: Two words are a pair if they stand at most so far apart.
NEAR = 5
PAIR_BITS = 22


def read(docs: list[bytes], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text its distinct terms, ascending, and the terms of its whole words in order."""
    distinct, lists = numbered([x.split() for x in docs])
    words = Words([w.decode("utf-8", "replace").lower().strip(MARKS) for w in distinct])
    kinds = [buckets(words.whole(), WHOLE, bits)]
    for n in STEMS:
        b = buckets(words.whole(n), n, bits)
        kinds.append(np.where(words.sizes - 2 >= n, b, -1))
    table = np.stack(kinds, 1)
    out = []
    for x in lists:
        ids = np.unique(table[np.unique(x)].ravel())
        out.append(ids[ids >= 0])
    return out, [table[x, 0].astype(np.int32) for x in lists]


def terms(docs: list[bytes], bits: int) -> list[np.ndarray]:
    """The distinct terms of each text, ascending."""
    return read(docs, bits)[0]


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of different words that stand near each other: hash bucket, lesser and greater term."""
    near = [(words[:-k], words[k:]) for k in range(1, min(NEAR, len(words) - 1) + 1)]
    if not near:
        return (np.zeros(0, np.int64),) * 3
    x, y = (np.concatenate(side).astype(np.uint64) for side in zip(*near, strict=True))
    key = np.unique((np.minimum(x, y) << np.uint64(32) | np.maximum(x, y))[x != y])
    return buckets(key, 0, PAIR_BITS), (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(2**32 - 1)).astype(np.int64)


def telling_terms(found: list[np.ndarray], words: list[np.ndarray], y: np.ndarray, bits: int, least_docs: int, least_z: float, pair_docs: int, pair_z: float) -> np.ndarray:
    """True for the terms worth a weight: those whose share of documents differs between the labels by least_z standard
    errors, and, whatever their own share, both members of a pair that occurs in pair_docs documents and whose share of
    label 1 is pair_z standard errors from that of each member: it says what neither says alone."""
    seen, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    seen2, toxic2 = np.zeros(1 << PAIR_BITS, np.int32), np.zeros(1 << PAIR_BITS, np.int32)
    for ids, sequence, v in zip(found, words, y.astype(int).tolist(), strict=True):
        seen[ids] += 1
        toxic[ids] += v
        h = pairs(sequence)[0]
        seen2[h] += 1
        toxic2[h] += v
    n1, n0, p = y.sum(), len(y) - y.sum(), seen / len(y)
    z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    telling = (seen >= least_docs) & (np.abs(z) >= least_z)
    share = (toxic + 1) / (seen + 2)
    error = np.sqrt(share * (1 - share))
    for sequence in words:
        h, *members = pairs(sequence)
        often = seen2[h] >= pair_docs
        h, members = h[often], [m[often] for m in members]
        root = np.sqrt(seen2[h])
        says = np.ones(len(h), bool)
        for m in members:
            says &= np.abs(toxic2[h] / seen2[h] - share[m]) * root >= pair_z * error[m]
        for m in members:
            telling[m[says]] = True
    return telling


class Machine:
    """score = sigmoid(bias + sum of w + sum over pairs of v_i . v_j) over the terms present. fitted: both labels were seen."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, bits: int, fitted: bool = True):
        self.fitted = fitted
        self.bias, self.w, self.v, self.bits = float(bias), w.astype(np.float32), v.astype(np.float32), bits

    def score(self, docs: list[bytes]) -> np.ndarray:
        out = np.array([self.raw(ids) for ids in terms(docs, self.bits)])
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

    def raw(self, ids: np.ndarray) -> float:
        ids = ids[self.w[ids] != 0]  # terms that the fit left out have no factors either
        v = self.v[ids]
        return self.bias + float(self.w[ids].sum()) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())


def train(sample: Iterable[tuple[bytes, int]], bits: int = 19, rank: int = 4, epochs: int = 16, rate: float = 0.2, decay: float = 2e-4, least_docs: int = 3, least_z: float = 3.5, pair_docs: int = 5, pair_z: float = 8.0, seed: int = 7) -> Machine:
    """Adaptive-rate stochastic gradient descent, one document at a time.

    Terms that tell nothing, neither alone nor beside another one (telling_terms), get no weight: without this the many
    chance terms of a long text outvote one insult. Without both labels the share of label 1 is the score of every text.
    """
    rows: list[np.ndarray] = []
    words: list[np.ndarray] = []
    y: list[int] = []
    for part in chunks(sample):
        found, sequences = read([t for t, _ in part], bits)
        rows += [ids.astype(np.int32) for ids in found]
        words += sequences
        y += [v_ for _, v_ in part]
    y = np.array(y, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, rank), np.float32)
    if len(set(y.tolist())) < 2:
        return Machine(bias, w, v, bits, fitted=False)
    telling = telling_terms(rows, words, y, bits, least_docs, least_z, pair_docs, pair_z)
    del words
    rows = [ids[telling[ids]] for ids in rows]
    rng = np.random.default_rng(seed)
    known = np.flatnonzero(telling)
    v[known] = rng.normal(0, 0.01, (len(known), rank))
    gw, gv = np.full(1 << bits, 1e-2, np.float32), np.full((1 << bits, rank), 1e-2, np.float32)
    gb = 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            ids = rows[i]
            vi = v[ids]
            s = vi.sum(0)
            z = bias + float(w[ids].sum()) + 0.5 * float((s * s - (vi * vi).sum(0)).sum())
            g = 1 / (1 + np.exp(-min(max(z, -30), 30))) - y[i]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            dw = g + decay * w[ids]
            gw[ids] += dw * dw
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            dv = g * (s - vi) + decay * vi
            gv[ids] += dv * dv
            v[ids] -= rate * 0.3 * dv / np.sqrt(gv[ids])
    return Machine(bias, w, v, bits)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 10_000, sample_bytes: int = 64 << 20, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    The machine is fitted on at most sample_rows labelled rows of at most sample_bytes of text together, of the folds that
    aren't held out; it sees texts alone. Every whole text is scored; null and empty texts get the score of a text
    without terms; repeated rows get the same score; an empty table gives no rows.
    """
    return scores(docs, fit(docs, labels, label, sample_rows, sample_bytes), threshold)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 10_000, sample_bytes: int = 64 << 20) -> Machine:
    return train(labelled_sample(docs, labels, label, sample_rows, sample_bytes))
