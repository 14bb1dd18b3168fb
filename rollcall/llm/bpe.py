"""Byte-level BPE encoding and decoding with batched numpy merge rounds."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import list_array, slices, texts

#: The published split pattern of this family of byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def unlike(spec: dict) -> list[str]:
    """What a vocabulary file asks for that merges of bytes within SPLIT don't give."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    found = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    found += ["model"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
    found += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space")) or not pre.get("use_regex", True))
    return found + [t["content"] for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"]]


class Remembered(dict):
    """What stays, and in rest what is held for the current batch."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.rest = limit, {}

    def __missing__(self, key):
        return self.rest[key]


class ByteBpe:
    """A vocabulary file as sorted pair keys. Up to word_cache pretokens, those met first, stay remembered with their ids;
    further ones are held for their batch. A vocabulary of another form (see unlike) is an error."""

    def __init__(self, data: bytes, word_cache: int = 500_000):
        spec = json.loads(data)
        if found := unlike(spec):
            raise ValueError(f"not a plain byte-level vocabulary: {', '.join(found)}")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = np.int64(1 + max(vocab.values()))
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, ranks = left * self.size + right, np.arange(len(merges), dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)  # a pair listed twice keeps its lower rank
        self.keys, self.ranks, self.made = keys, ranks[first], made[first]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: text.encode() for text, i in self.added.items()}
        self.added_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        self.cache: dict[str, bytes] = Remembered(word_cache)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. All words' symbols lie in one flat array; each round merges, in every word still open,
        all occurrences of its lowest-ranked pair, left to right."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_ids[flat]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        while len(sym):
            inside = word[1:] == word[:-1]
            pair = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = inside & (self.keys[at] == pair)
            rank = np.append(np.where(known, self.ranks[at], NONE), NONE)  # the last symbol of the array has no pair
            starts = np.flatnonzero(np.append(True, ~inside))
            counts = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                for s, n, w in zip(starts[done].tolist(), counts[done].tolist(), word[starts[done]].tolist(), strict=True):
                    out[w] = sym[s : s + n]
                stay = np.repeat(~done, counts)
                sym, word, rank, at = sym[stay], word[stay], rank[stay], np.append(at, 0)[stay]
                low, counts = low[~done], counts[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, counts)
            # of touching occurrences (the same symbol repeated) every second one starts a merge
            spot = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(spot) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
            sym = sym.copy()
            sym[spot] = self.made[at[spot]]
            keep = np.ones(len(sym), bool)
            keep[spot + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def learn(self, words: set[str]) -> None:
        cache = self.cache
        cache.rest = {}
        new = list(words.difference(cache))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            into = cache if len(cache) < cache.limit else cache.rest
            into.update((w, ids.astype("<i4").tobytes()) for w, ids in zip(part, self.merge([w.encode() for w in part]), strict=True))

    def pretokens(self, text: str) -> list[str]:
        if self.added_split is None or not any(x in text for x in self.added):
            return self.split.findall(text)
        out: list[str] = []
        for piece in self.added_split.split(text):
            if piece in self.added:
                out.append(piece)
            else:
                out.extend(self.split.findall(piece))
        return out

    def encode(self, docs: list[str]) -> list[bytes]:
        """Each document's ids as little-endian 32-bit integers."""
        lists = [self.pretokens(x) for x in docs]
        self.learn(set().union(*lists) - self.added.keys())
        self.cache.rest.update((x, np.array([i], "<i4").tobytes()) for x, i in self.added.items())
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_CODERS: dict[int, ByteBpe] = {}


def coder_of(data: bytes) -> ByteBpe:
    """This worker's tables for a vocabulary file, kept over its tasks."""
    key = zlib.crc32(data)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = ByteBpe(data)
    return _CODERS[key]


def encode_bpe(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """The columns of keep and the token ids of text as array<int>; one Arrow pass, no shuffle.

    Null text counts as empty, and an empty text has no ids. Rows repeat as often as in docs; other columns are dropped.
    Special strings of the vocabulary file are taken as their own id. Batches are cut to about 4 MB of text, and a longer
    text is processed whole by itself. The vocabulary travels with the task (its size is the file's, under 2 MB here).
    """
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    frame = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).schema.add(out, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(data.value)
        for batch in slices(batches, "__text", 4 << 20):
            coded = bpe.encode([x.decode("utf-8", "replace") for x in texts(batch.column("__text"))])
            ids = list_array(np.frombuffer(b"".join(coded), "<i4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids], names=[*keep, out])

    return frame.mapInArrow(run, schema)


def decode_bpe(coded: DataFrame, tokenizer_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """The columns of keep and the text of the token ids. Null or empty ids give an empty text; bytes that are not UTF-8
    become replacement characters; an unknown id is an error."""
    with open(tokenizer_path, "rb") as f:
        data = coded.sparkSession.sparkContext.broadcast(f.read())
    frame = coded.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    schema = coded.select(*keep).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(data.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                lists = batch.column("__ids")
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                decoded = [bpe.decode(x).decode("utf-8", "replace") for x in np.split(flat, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(decoded, pa.string())], names=[*keep, out])

    return frame.mapInArrow(run, schema)
