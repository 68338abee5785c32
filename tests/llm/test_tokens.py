"""Token counts, BPE ids and decoding, and packing against the libraries."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairway.llm import bpe, bpe_codec, packing, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
ODD = ["", "  ", "a\x1cb \x85x\xa0y", "don't I'll we've 's", "x<|endoftext|>Y <|startoftext|><|end", "<|endoftext|>", "ΑΣ ΣΑΣ Straße İstanbul ﬁ ½ ²³ 三百 é ́x Å", "🙂👍🏽 hello🙂", "A" * 500, "ab" * 3000, "　全角　スペース", "1234567 3.14 x1y2", "word " * 5000]
SCHEMA = "doc_id long, text string, ids string, rank int"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    plain = "abcdefghijklmnopqrstuvwxyz'.,!0123456789éüßñ-<|>ABC\t\n  "
    made = ["".join(rnd.choice(plain) for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    made += ["".join(chr(rnd.choice([rnd.randint(32, 0x24F), rnd.randint(0x250, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(15)) for _ in range(200)]
    return [*ODD, None, *made]


@pytest.fixture(scope="module")
def df(spark, texts):
    rows = [(i, t, "", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 1), (0, "", "", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_ids_equal_the_library(texts):
    flat, bounds = bpe.piece_table(bpe.VOCABULARY).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == ids(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    flat, bounds = bpe.piece_table(bpe.VOCABULARY).encode(pa.array([text], pa.string()))
    assert flat.tolist() == ids(text)


def test_tables_start_anew(texts, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "WORDS", 15)
    table = bpe.PieceTable(bpe.piece_table(bpe.VOCABULARY).encoder)
    for i in range(0, len(texts), 7):
        flat, _ = table.encode(pa.array(texts[i : i + 7], pa.string()))
        assert flat.tolist() == [x for t in texts[i : i + 7] for x in ids(t)]


def test_strings_with_the_same_key_keep_their_own_ids(texts, monkeypatch):
    plain = bpe._keys
    monkeypatch.setattr(bpe, "_keys", lambda strings: plain(strings) % np.uint64(5))
    table = bpe.PieceTable(bpe.piece_table(bpe.VOCABULARY).encoder)
    for i in range(0, len(texts), 50):
        flat, _ = table.encode(pa.array(texts[i : i + 50], pa.string()))
        assert flat.tolist() == [x for t in texts[i : i + 50] for x in ids(t)]


def test_counts(df, texts):
    got = token_counts.token_counts(df, bpe.VOCABULARY).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "no id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(spark, name):
    texts = [t for t in ODD if len(t) < 600]
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.token_counts(df, name).orderBy("doc_id").collect()] == want


def test_codec(df, texts):
    for r in bpe_codec.round_trip(df, bpe.VOCABULARY).collect():
        own = ids("no id" if r.doc_id is None else texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_decode(df, texts):
    encoded = bpe_codec.encode(df, bpe.VOCABULARY)
    for r in bpe_codec.decode(encoded, bpe.VOCABULARY).where("doc_id > 0").collect():
        assert r.text == LIBRARY.decode(ids(texts[r.doc_id]), skip_special_tokens=False)


def test_packing(spark, df, texts):
    rows = packing.pack(df, bpe.VOCABULARY).collect()
    own = {i: [*ids(t), 0] for i, t in enumerate(texts)} | {None: [*ids("no id"), 0]}
    assert sum(r.length for r in rows) == sum(map(len, own.values())) + 1  # one row repeats
    places = {}
    for r in rows:
        part = own[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 2048 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA), bpe.VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plans_hold_every_length(hist):
    kinds = packing.pack_histogram(hist, 64, 8)
    got = {}
    for copies, items in kinds:
        assert copies > 0 and sum(a * b for a, b in items) <= 64
        for length, times in items:
            got[length] = got.get(length, 0) + copies * times
    assert got == hist
    used, least = sum(c for c, _ in kinds), -(-sum(a * b for a, b in hist.items()) // 64)
    assert used <= 2 * least


@pytest.mark.parametrize("low, high, most", [(1, 2048, 1.02), (1, 600, 1.003), (260, 1100, 1.02)])
def test_few_sequences(low, high, most):
    lengths = np.random.default_rng(1).integers(low, high, 40_000)
    hist = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    assert sum(c for c, _ in packing.pack_histogram(hist, 2048)) <= most * lengths.sum() / 2048


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.sampled_from(["", "<s>", " [MASK] ", "\u00ad", "İ"]))
def test_both_encoders_give_the_same_ids(text, extra):
    texts = pa.array([text + extra + text, extra], pa.string())
    one, two = bpe.piece_table(bpe.VOCABULARY).encode(texts), bpe.piece_table(bpe.VOCABULARY, bpe.LibraryBpe).encode(texts)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


@pytest.mark.parametrize("low, high, n", [(1000, 1048, 20_000), (1020, 1030, 5936), (1020, 1030, 50_010), (600, 1100, 20_000), (1, 2048, 20_000), (257, 2047, 10_000), (340, 1400, 20_000)])
def test_never_more_sequences_than_best_fit(low, high, n):
    hist = dict(Counter(np.random.default_rng(0).integers(low, high + 1, n).tolist()))
    plan = packing.pack_histogram(hist, 2048)
    held = Counter()
    for copies, items in plan:
        assert sum(length * times for length, times in items) <= 2048
        held.update({length: copies * times for length, times in items})
    assert held == Counter(hist)
    assert packing.sequences(plan) <= packing.sequences(packing._best_fit([], dict(hist), 2048))


def test_few_lengths_are_not_rounded():
    assert packing._grouped({1000 + k: 5 for k in range(49)}, 257, 96) == [(1048 - k, [[1048 - k, 5]]) for k in range(49)]
