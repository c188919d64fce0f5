from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, tokenizing

from .helpers import awkward, docs_table, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="abXYéßŉ  \n\t0²½.,-(){}<|>«“…'日", max_size=40), max_size=6))
def test_encoder_agrees_with_the_library(path, texts):
    own, ref = tokenizing.encoder(tokenizing.definition(path)), library(path)
    assert own.encode(texts) == [np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "endoftext|>", "a b", " ", "\n", "é", "日", "x's"]), max_size=8).map("".join), max_size=6))
def test_added_tokens(path, texts):
    """Strings of added tokens become these tokens, as the library has it by default."""
    own, ref = tokenizing.encoder(tokenizing.definition(path)), library(path)
    assert own.encode(texts) == [np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    name, number = ("<|endoftext|>", 49407) if path == WORD else ("<|endoftext|>", 50256)
    assert number in np.frombuffer(own.encode([f"a {name} b"])[0], "<u4")


def test_encoder_with_full_memory(monkeypatch):
    monkeypatch.setattr(tokenizing, "MEMORY", 50)
    own, ref = tokenizing.Encoder(tokenizing.definition(BYTE)), library(BYTE)
    texts = [prose(random.Random(i), 80) + f" word{i}" for i in range(20)]
    for _ in range(2):
        assert own.encode(texts) == [np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check(rows, texts, path=WORD, tokens=4096):
    ref = library(path)
    want = []
    for doc, text in texts:
        ids = np.array([*ref.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, n, a, len(ids[a : a + tokens]), zlib.crc32(ids[a : a + tokens].tobytes())) for n, a in enumerate(range(0, len(ids), tokens))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by_sequence), sum(w[3] for w in want)


def test_packed(spark):
    rng = random.Random(1)
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randint(1, 900)), "en", "a") for i in range(150)]
    found = packing.packed(docs_table(spark, rows), WORD).collect()
    used, total = check(found, [(r[0], r[1]) for r in rows])
    assert used <= -(-total // 4096) + 1
    again = packing.packed(docs_table(spark, rows), WORD).collect()
    assert len({r.sequence_id for r in again}) == used


def test_lanes(spark):
    items = spark.createDataFrame([(i, 1 + (i * 37) % 300) for i in range(3000)], "item long, length long")
    found = packing.pack(items, room=512, lane_rows=500).collect()
    used = len({r.sequence_id for r in found})
    assert len(found) == 3000 and used <= 1.03 * sum(r.length for r in found) / 512


def test_empty(spark):
    assert packing.packed(docs_table(spark, []), WORD).count() == 0


@given(st.lists(st.integers(1, 64), max_size=120))
def test_sum_of_squares(lengths):
    sizes = np.array(lengths, np.int64)
    for method in (packing.sum_of_squares, packing.best_fit, lambda s, r: (*packing.pack_lane(s, r), 0)):
        where, offset, _ = method(sizes, 64)
        for b in set(where.tolist()):
            own = sorted(zip(offset[where == b].tolist(), sizes[where == b].tolist()))
            assert [o for o, _ in own] == np.cumsum([0, *[s for _, s in own]])[:-1].tolist() and sum(s for _, s in own) <= 64


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 20, 200)
    where, _, _ = packing.sum_of_squares(sizes, 20)
    fill = {}
    for size, to in zip(sizes.tolist(), where.tolist()):

        def total(levels):
            return sum(levels.count(x) ** 2 for x in set(levels) if x < 20)

        options = [total([v + size * (b == k) for k, v in fill.items()]) for b in fill if fill[b] + size <= 20] + [total([*fill.values(), size])]
        fill[to] = fill.get(to, 0) + size
        assert total(list(fill.values())) == min(options)
