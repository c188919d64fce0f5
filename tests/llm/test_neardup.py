from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup

from .helpers import awkward, docs_table, prose, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = words_of((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """Smallest reachable doc_id of each row, by comparing all pairs."""
    sets = [shingles(r[1], k) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))]


def family(rng, start, n, size, edits):
    """A text and copies of earlier copies with some words changed."""
    texts = [prose(rng, size).split()]
    for _ in range(n - 1):
        words = list(rng.choice(texts))
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(size)] = f"edit{rng.randrange(10**6)}"
        texts.append(words)
    return [(start + i, " ".join(t), "en", "a") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    found = awkward(rng) + family(rng, 100, 60, 120, 3) + family(rng, 200, 40, 60, 4) + family(rng, 300, 30, 200, 9)
    shared = prose(rng, 25)
    found += [(400 + i, f"{shared} {prose(rng, 40)}", "en", "a") for i in range(50)] + [(500 + i, prose(rng, rng.randint(1, 6)), "en", "a") for i in range(40)]
    return found


@pytest.mark.parametrize("options", [{}, {"leaf": 8, "depth": 2}, {"leaf": 2, "depth": 0}])
@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, rows, k, options):
    found = neardup.groups(docs_table(spark, rows), k=k, **options).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=key) == sorted(brute(rows, k), key=key)


def test_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 10)
    found = neardup.groups(docs_table(spark, rows), k=4).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=key) == sorted(brute(rows, 4), key=key)


def test_deduplicate(spark, rows):
    table = docs_table(spark, rows)
    stay = neardup.deduplicate(table, k=5)
    assert stay.columns == table.columns
    kept = stay.select("doc_id", "text", "__row").collect()
    named = {c for _, n, c in brute(rows, 5) if n}
    with_words = [r for r in kept if words_of(r.text)]
    assert len(with_words) == len(named) and {r.doc_id for r in with_words} == named
    assert sum(not words_of(r[1]) for r in rows) == sum(not words_of(r.text) for r in kept)
    assert neardup.deduplicate(docs_table(spark, [])).count() == neardup.groups(docs_table(spark, [])).count() == 0


def test_shingle_sets():
    texts = ["A b  c\td e", "a B c d E", None, "", " \n", "one two", "ONE\x0btwo", "É x y z w", "é x y z w", "word " * 3000, "w" * 300_000 + " x"]
    for k in (1, 4, 5):
        got = neardup.shingle_sets(pa.array(texts), k)
        assert [len(s) for s in got] == [len(shingles(t, k)) for t in texts]
        assert (got[0] == got[1]).all() and (got[5] == got[6]).all() and not np.array_equal(got[7], got[8])
    sliced = neardup.shingle_sets(pa.array(texts).slice(5, 2), 4)
    assert np.array_equal(sliced[0], sliced[1])


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.row: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_recall_of_trees(spark):
    """Pairs right at the threshold stay together: 60 of 75 words of shingle length 1."""
    rng = random.Random(10)
    rows = []
    for p in range(60):
        common = [f"c{p}x{i}" for i in range(64)]
        rows += [(2 * p + s, " ".join(common + [f"o{p}s{s}x{i}" for i in range(8)]), "en", "a") for s in range(2)]
    rng.shuffle(rows)
    found = neardup.groups(docs_table(spark, rows), k=1, leaf=2, depth=6)
    assert found.filter(F.col("component_id") % 2 == 1).count() == 0


def test_rows_of_a_shared_line(spark, monkeypatch):
    """Documents that share a line and little else don't become many rows of the trees, and no link among them is lost."""
    made, descendants = spark.sparkContext.accumulator(0), neardup._descendants

    def counting(*options):
        run = descendants(*options)

        def counted(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return counted

    monkeypatch.setattr(neardup, "_descendants", counting)
    line, pool = " ".join(f"line{i}" for i in range(14)), [f"w{i}" for i in range(20_000)]
    rng = random.Random(11)
    rows = [(i, f"{line} {' '.join(rng.choices(pool, k=60))}", "en", "a") for i in range(380)]
    rows += [(400 + i, f"{r[1]} more", "en", "a") for i, r in enumerate(rows[:20])]
    found = neardup.groups(docs_table(spark, rows), k=4, leaf=60).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, 4))
    assert made.value <= 4 * len(rows)
