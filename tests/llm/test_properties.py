"""Properties over random inputs."""

import io
import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import packing, simhash, suffix, token_files
from rollcall.llm.bpe import ByteBpe

P = pytest.importorskip("public_tokenizers")
BYTES = open(P.path("byte_bpe_50k.json"), "rb").read()
WORDS = open(P.path("word_bpe_49k.json"), "rb").read()
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdmtlrve.,!<|>aeiou1é")), max_size=80)


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(BYTES.decode()), ByteBpe(BYTES, word_cache=50), Tokenizer.from_str(WORDS.decode()), token_files.WordEncoder(WORDS, limit=50)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_encoders_equal_the_library(libraries, texts):
    byte_lib, byte_own, word_lib, word_own = libraries
    for lib, got in ((byte_lib, byte_own.encode(texts)), (word_lib, word_own.encode([t.encode() for t in texts]))):
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts, byte_own.encode(texts), strict=True):
        assert byte_own.decode(np.frombuffer(ids, "<i4")).decode() == t


def changed(data, path, value):
    spec = json.loads(data)
    at = spec
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return json.dumps(spec).encode()


ODD = [
    (["normalizer"], None),
    (["normalizer", "normalizers"], [{"type": "NFC"}]),
    (["pre_tokenizer", "pretokenizers", 0, "pattern"], {"Regex": r"[^\s]+ ?"}),
    (["pre_tokenizer", "pretokenizers", 1, "add_prefix_space"], True),
    (["added_tokens", 0, "content"], "end of text"),
]


@pytest.mark.parametrize(("path", "value"), ODD)
def test_words_of_another_vocabulary_are_encoded_whole(path, value):
    from tokenizers import Tokenizer

    data = changed(WORDS, path, value)
    lib, own = Tokenizer.from_str(data.decode()), token_files.WordEncoder(data)
    texts = ["", "Some TEXT, of two\u00a0 kinds!!", "an end of text here <|endoftext|>x", "\u00c9t\u00e9 1,234"]
    assert not own.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_vocabulary_of_words_is_known():
    assert token_files.WordEncoder(WORDS).by_words


@pytest.mark.parametrize(("path", "value"), [(["normalizer"], {"type": "NFC"}), (["pre_tokenizer", "add_prefix_space"], True), (["model", "end_of_word_suffix"], "</w>"), (["added_tokens", 0, "lstrip"], True)])
def test_bytes_of_another_vocabulary_are_refused(path, value):
    with pytest.raises(ValueError, match="not a plain byte-level vocabulary"):
        ByteBpe(changed(BYTES, path, value))


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 64), max_size=60), sizes=st.sets(st.integers(1, 63), max_size=3))
def test_bins_hold_what_they_say(lengths, sizes):
    sizes = tuple(sorted({*sizes, 64}))
    got = packing.best_fit(np.array(lengths, np.int64), sizes)
    total = np.bincount(got.bin, weights=lengths, minlength=len(got.capacity)) if lengths else []
    for filled, n, capacity in zip(got.filled, total, got.capacity, strict=True):
        assert filled == n <= capacity and capacity in sizes
        assert all(s < n for s in sizes if s < capacity)  # no smaller size would do


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.integers(0, 3), min_size=2, max_size=12), data=st.data())
def test_repeats_equal_a_count(parts, data):
    blocks = [bytes(data.draw(st.lists(st.integers(97, 98), min_size=1, max_size=9))) for _ in range(4)]
    contexts = [b"".join(blocks[p] for p in parts[i::2]) for i in range(2)]
    length = data.draw(st.integers(1, 12))
    reach = length + data.draw(st.integers(0, 6))
    contexts = [x for x in contexts if len(x) >= length]
    if not contexts:
        return
    spans = [len(x) - length + 1 for x in contexts]

    def counted(n):
        """Starts below the span whose n bytes also start at another such place; windows that don't fit are none."""
        seen = [[x[i : i + n] for i in range(s) if i + n <= len(x)] for x, s in zip(contexts, spans, strict=True)]
        every = Counter(w for x in seen for w in x)
        return [[i for i, w in enumerate(x) if every[w] > 1] for x in seen]

    got = suffix.repeated_starts(contexts, spans, length, reach)
    assert [a.tolist() for a, _ in got] == counted(length)
    assert [b.tolist() for _, b in got] == counted(reach)


@settings(max_examples=100, deadline=None)
@given(docs=st.lists(st.tuples(st.integers(-(2**62), 2**62), st.lists(st.integers(0, 2**32 - 1), max_size=30)), max_size=20), frame=st.integers(1, 200))
def test_token_files_round_trip(docs, frame):
    out = io.BytesIO()
    w = token_files.Writer(out, frame)
    for d, ids in docs:
        w.add(d, np.array(ids, "<u4").tobytes())
    w.close()
    got = [(d, np.frombuffer(b, "<u4").tolist()) for d, b in token_files.Reader(out, len(out.getvalue())).documents()]
    assert got == docs


@settings(max_examples=100, deadline=None)
@given(prints=st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=30), flips=st.lists(st.sets(st.integers(0, 63), max_size=6), max_size=10))
def test_near_pairs_equal_all_pairs(prints, flips):
    prints += [prints[0] ^ sum(1 << b for b in f) for f in flips]
    a = np.array(prints, np.uint64)
    got = {tuple(sorted(p)) for x, y in simhash.near_pairs(a, None, 4) for p in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert got == want
