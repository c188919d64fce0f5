from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokenio
from tessera.llm.common import scratch

from .helpers import awkward, docs_table, prose

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_coding(values):
    ranks = np.array(values, np.uint32)
    control, data = tokenio.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tokenio.decode_ranks(control, data, len(values)).tolist() == values


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenio, "BLOCK_IDS", 2000)
    rng = random.Random(3)
    rows = awkward(rng) + [(20 + i, prose(rng, rng.randint(0, 120)), "en", "a") for i in range(80)]
    ref = Tokenizer.from_file(BYTE)
    want, start = [], 0
    keyed = [(r[0], np.array([*ref.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in rows]
    for doc, ids in sorted(keyed, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]))):
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder = scratch(spark, "tokens")
    manifest = tokenio.write_tokens(docs_table(spark, rows), BYTE, folder)
    got = [tuple(r) for r in tokenio.read_files(manifest, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    counts = np.bincount(np.concatenate([ids for _, ids in keyed]))
    ranks = np.fromfile(f"{folder.removeprefix('file://')}/ranks.u32", "<u4")
    assert (np.diff(counts[ranks]) <= 0).all() and len(ranks) == (counts > 0).sum()


def test_empty(spark):
    folder = scratch(spark, "tokens")
    assert tokenio.read_files(tokenio.write_tokens(docs_table(spark, []), BYTE, folder), folder).count() == 0
