from __future__ import annotations

import hashlib
import os
import random

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import fingerprint
from tessera.llm.fingerprint import PrefixHash, codes

from .helpers import awkward, docs_table, prose

TEXT = st.text(alphabet="ab😀é", max_size=30)


@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = PrefixHash(codes(a)), PrefixHash(codes(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    assert x.common_prefix(i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    assert (x.fingerprint() == y.fingerprint()) == (a == b)


@given(TEXT, TEXT)
def test_shared_head(a, b):
    head = PrefixHash(codes(a))
    assert PrefixHash(codes(a[:3] + b), head, min(3, len(a))).fingerprint() == PrefixHash(codes(a[:3] + b)).fingerprint()


def like(a, b):
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return (head + min(tail, min(len(a), len(b)) - head)) / longer


def brute(rows):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))  # rows of one doc_id are equal here
    out = []
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(text, edited), 9), round(like(text, after), 9)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(15)
    rows = awkward(rng) + [(50 + i, prose(rng, rng.randint(0, 40)), "en", "a") for i in range(60)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for size in (1, 5, 2048):
        found = fingerprint.fingerprints(docs_table(spark, rows), size).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.ends_edited, 9), round(r.ends_next, 9)) for r in found], key=key) == sorted(brute(rows), key=key)
        assert all(r.ends_edited - 1e-9 <= r.near_edited <= 1 and r.ends_next - 1e-9 <= r.near_next <= 1 for r in found)
    texts = dict(r[:2] for r in rows)
    for r, after in [(r, texts[d]) for r, d in zip(sorted((r for r in found if (r.doc_id or 0) >= 50), key=lambda r: r.doc_id), range(51, 110))]:
        own = texts[r.doc_id]
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        assert r.near_next <= max(longest_common(own, after) / max(len(own), len(after), 1), float(own == after)) + 1e-9
        assert r.near_edited <= max(longest_common(own, edited) / max(len(own), 1), float(own == edited)) + 1e-9
    prints = {}
    for r in found:
        prints.setdefault(r.fingerprint, r.n_chars)
    assert len(prints) == len({r[1] or "" for r in rows})


def test_small(spark):
    assert fingerprint.fingerprints(docs_table(spark, [])).count() == 0
    one = fingerprint.fingerprints(docs_table(spark, [(3, "abcdefgh", "en", "a")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for n, y in enumerate(b, 1):
            row[n] = before[n - 1] + 1 if x == y else max(before[n], row[n - 1])
    return row[-1]


@given(st.text(alphabet="ab", max_size=90), st.text(alphabet="ab", max_size=90))
def test_aligned_bounds(a, b):
    x, y = PrefixHash(codes(a)), PrefixHash(codes(b))
    longer = max(len(a), len(b), 1)
    assert like(a, b) - 1e-9 <= x.aligned(y) <= max(longest_common(a, b) / longer, float(a == b)) + 1e-9
    for i, j, n in x.runs(y).tolist():
        assert a[i : i + n] == b[j : j + n] and n >= fingerprint.SPAN


def test_scattered_edits(spark):
    rng = random.Random(16)
    text = prose(rng, 400)
    near, cuts = list(text), [5, 400, 900, 1500, len(text) - 6]
    for n, at in enumerate(reversed(cuts)):
        near[at : at + 1] = ["#", "", "##", near[at] + "+", "é"][n]
    near = "".join(near)
    lines = "the same line again\n" * 60
    rows = [(1, text, "en", "a"), (2, near, "en", "a"), (3, prose(rng, 400, "otra cosa que nada tiene con esto"), "es", "a"), (4, lines, "en", "a"), (5, lines[:7] + "#" + lines[8:-9] + "??" + lines[-9:], "en", "a")]
    found = {r.doc_id: r for r in fingerprint.fingerprints(docs_table(spark, rows)).collect()}
    assert found[1].ends_next < 0.05 and found[1].near_next >= (len(text) - 12) / (len(text) + 3)
    assert found[2].near_next < 0.1
    assert found[4].ends_next < 0.05 and found[4].near_next >= 0.95
