"""Token ids in files of independent zstandard frames with a seek table, and their reader.

A shard file is a run of frames followed by one skippable frame:

* frame: a zstandard frame of the ids of consecutive documents as little-endian unsigned 32-bit integers;
* table (skippable frame, magic 0x184D2A5E): the document index as a zstandard frame (per document its id, its frame and
  its number of ids as three little-endian 64-bit integers), then 16 bytes per frame (compressed size, raw size and the
  CRC-32 of the raw bytes as 32-bit integers, a zero), then a footer of 24 bytes: sizes of the index (raw and compressed),
  number of frames and documents, a version and the magic 0x8F92EAB1.

A reader fetches the footer and table from the end, then only the frames of the documents asked for, and checks each
frame's CRC-32.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, slices, texts, work_path

SKIPPABLE, MAGIC, VERSION = 0x184D2A5E, 0x8F92EAB1, 1
FOOTER = struct.Struct("<IIIIII")
TABLE = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("crc", "<u4"), ("zero", "<u4")])


class Writer:
    """Appends documents to an open binary file; frame_bytes is the raw size after which a frame is closed."""

    def __init__(self, out, frame_bytes: int = 1 << 20):
        self.out, self.frame_bytes, self.frames, self.index = out, frame_bytes, [], []
        self.parts: list[bytes] = []
        self.held = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((-(1 << 63) if doc_id is None else doc_id, len(self.frames), len(ids) // 4))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            raw = b"".join(self.parts)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), zlib.crc32(raw), 0))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        raw = np.array(self.index, "<i8").reshape(-1, 3).tobytes()
        index = self.pack.compress(raw)
        table = np.array(self.frames, TABLE).tobytes()
        body = index + table + FOOTER.pack(len(raw), len(index), len(self.frames), len(self.index), VERSION, MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Reads a shard from a seekable binary file: index first, frames on demand."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        raw, packed, frames, docs, version, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        file.seek(size - FOOTER.size - frames * TABLE.itemsize - packed)
        unpack = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(unpack.decompress(file.read(packed), max_output_size=raw), "<i8").reshape(docs, 3)
        self.frames = np.frombuffer(file.read(frames * TABLE.itemsize), TABLE)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        self.unpack = unpack

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.offsets[k]))
        raw = self.unpack.decompress(self.file.read(int(self.frames["packed"][k])), max_output_size=int(self.frames["raw"][k]))
        if zlib.crc32(raw) != int(self.frames["crc"][k]):
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc id, ids as bytes) in file order; with wanted only those, decompressing only their frames."""
        held, at, raw = -1, 0, b""
        for doc, k, n in self.index.tolist():
            if k != held:
                held, at = k, 0
                raw = b""
            if wanted is None or doc in wanted:
                raw = raw or self.frame(k)
                yield (None if doc == -(1 << 63) else doc), raw[at : at + 4 * n]
            at += 4 * n


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder's URI (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Remembered(dict):
    """Ids by chunk. A chunk that is met first is encoded then; up to limit chunks stay, further ones are held in rest
    until the batch is done."""

    def __init__(self, limit: int, encode):
        super().__init__()
        self.limit, self.encode_chunk, self.rest = limit, encode, {}

    def __missing__(self, key):
        ids = self.rest.get(key)
        if ids is None:
            ids = self.encode_chunk(key)
            (self if len(self) < self.limit else self.rest)[key] = ids
        return ids


class WordEncoder:
    """A tokenizers-library vocabulary applied chunk by chunk.

    White space of ASCII never lies inside a token of a vocabulary that drops it, so a text is cut there and a chunk's ids
    are remembered. Two more facts of this vocabulary save calls: it ignores case, so a text without a special string is
    lowered first (in ASCII), and marks of ASCII behind a letter or digit of ASCII are always a token run of their own, so a
    chunk that ends in marks is two chunks that are better known. A vocabulary file that doesn't say all this of itself
    (by_words) is applied to whole texts instead.
    """

    MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
    PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, data: bytes, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_words = by_words(json.loads(data))
        self.cache = Remembered(limit, self.chunk)

    def ids(self, text: bytes) -> bytes:
        ids = array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def chunk(self, word: bytes) -> bytes:
        core = word.rstrip(self.MARKS)
        if core and len(core) < len(word) and core[-1] in self.PLAIN and b"<|" not in word:
            return self.cache[core] + self.cache[word[len(core) :]]
        return self.ids(word)

    def encode(self, docs: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [self.ids(x) for x in docs]
        self.cache.rest = {}
        get = self.cache.__getitem__
        return [b"".join(map(get, (x if b"<|" in x else x.lower()).split())) for x in docs]


#: The split pattern and the normalizers of the vocabularies that go by words.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def by_words(spec: dict) -> bool:
    """Whether a vocabulary file drops white space, ignores case, splits marks from words, and has only special strings
    that begin with <| and hold no white space."""
    normal = spec.get("normalizer") or {}
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = normal.get("normalizers") == WORD_NORMALIZERS
    words = split[0].get("pattern") == {"Regex": WORD_SPLIT} and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
    level = len(split) == 2 and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space") and split[1].get("use_regex") is False
    plain = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
    return same and words and level and plain and not spec["model"].get("dropout")


_ENCODERS: dict[int, WordEncoder] = {}


def encoder_of(data: bytes) -> WordEncoder:
    """This worker's encoder for a vocabulary, kept over its tasks."""
    key = zlib.crc32(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(data)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, target: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", frame_bytes: int = 1 << 20) -> DataFrame:
    """Writes shard files of all documents in ascending doc_id order to target; returns (shard, path, n_docs, n_ids).

    The rows are dealt out by ranges of (doc_id, hash of the text), so that a doc_id that repeats is split over shards; null
    ids come first. Each task writes its shard under a name of its own attempt and then renames it, so that a task that
    runs again after a lost executor replaces it whole. Empty and null texts hold only end_id. Nothing is written for an
    empty range. Memory: one batch of texts, one frame and the index, a tuple of
    some 200 bytes per document of a shard.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, writer, total = TaskContext.get().partitionId(), None, None, 0
        fs, base = store(target)
        path = f"{base}/shard-{shard:06d}.tok.zst"
        own = f"{base}/.{shard:06d}-{uuid.uuid4().hex}"
        for batch in slices(batches, "text", 8 << 20):
            if writer is None:
                fs.create_dir(base, recursive=True)
                encoder, out = encoder_of(data.value), fs.open_output_stream(own)
                writer = Writer(out, frame_bytes)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch.column("text"))), strict=True):
                writer.add(doc, ids + end)
                total += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.index)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return rows.mapInArrow(run, "shard int, path string, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, shards: list[tuple[int, str, int]], target: str, digest: bool = False) -> DataFrame:
    """The documents of shard files, one task a shard: doc_id, start, n_tokens, and their ids (or with digest ids_crc32).

    shards holds (shard, path, start of its first document) per file: as many rows as there were tasks, not documents.
    """
    value = "ids_crc32 long" if digest else "ids array<long>"
    if not shards:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {value}")
    listed = spark.createDataFrame(shards, "shard int, path string, base long").repartition(len(shards), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(target)
        for batch in batches:
            for row in batch.to_pylist():
                start, held = row["base"], []
                with fs.open_input_file(row["path"]) as f:
                    for doc, ids in Reader(f, f.size()).documents():
                        n = len(ids) // 4
                        held.append((doc, start, n, zlib.crc32(ids) if digest else np.frombuffer(ids, "<u4").tolist()))
                        start += n
                        if len(held) >= (20_000 if digest else 500):
                            yield block(held)
                            held = []
                if held:
                    yield block(held)

    def block(held: list[tuple]) -> pa.RecordBatch:
        doc, start, n, last = zip(*held, strict=True)
        kind = pa.int64() if digest else pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(last, kind)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return listed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {value}")


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int = 1, target: str | None = None) -> DataFrame:
    """Writes the shards, then returns doc_id, start, n_tokens and ids_crc32 as read back from them."""
    spark = docs.sparkSession
    target = target or work_path(spark, "tokens")
    manifest = sorted(tuple(r) for r in write_tokens(docs, tokenizer_path, target, end_id).collect())  # a row per task
    starts = np.concatenate([[0], np.cumsum([n for *_, n in manifest])]).tolist()
    return read_tokens(spark, [(shard, path, starts[i]) for i, (shard, path, *_) in enumerate(manifest)], target, digest=True)
