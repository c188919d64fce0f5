from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

from .helpers import awkward, docs_table, prose, words_of


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by dealing the excess out again and again."""
    total, fixed = share * sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in rest)
        left = total - sum(fixed.values())
        over = [i for i in rest if left * weights[i] / weight > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, left * weights[i] / weight if weight else 0.0) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_targets(spark):
    rng = random.Random(16)
    for _ in range(4):
        sizes = [rng.choice([0, 5, 40, 300, 2000]) for _ in range(rng.randint(1, 9))]
        table = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(sizes)], "skey string, words long")
        got = {r.skey: r.target for r in mixing.targets(table).collect()}
        if sum(sizes):
            assert [got[f"a{i}"] for i in range(len(sizes))] == pytest.approx(fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mix(spark):
    rng = random.Random(17)
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randint(0, 50)), "en", rng.choice(["hot"] * 6 + ["x", "y", None])) for i in range(500)]
    table = docs_table(spark, rows)
    found = mixing.mix(table).collect()
    assert len(found) == len(rows) and {r.copies for r in found} <= {0, 1, 2}
    assert sorted(r["size"] for r in found) == sorted(len(words_of(r[1])) for r in rows)
    taken, most, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        taken[r.skey] += r.copies * r["size"]
        most[r.skey] = max(most[r.skey], r["size"])
        target[r.skey] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * most[s] + 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))
    again = mixing.mix(table.repartition(7)).collect()
    assert Counter((r.doc_id, r["size"], r.copies) for r in again) == Counter((r.doc_id, r["size"], r.copies) for r in found)


def test_documents(spark):
    rng = random.Random(18)
    rows = awkward(rng) + [(100 + i, prose(rng, 10), "en", rng.choice("ab")) for i in range(50)]
    table = docs_table(spark, rows)
    many = mixing.mixed_documents(table)
    assert many.columns == table.columns
    counts = Counter(r.doc_id for r in many.select("doc_id").collect())
    want = Counter()
    for r in mixing.mix(table).collect():
        want[r.doc_id] += r.copies
    assert counts == +want
    empty = docs_table(spark, [])
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    nothing = docs_table(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert mixing.mix(nothing).agg(F.sum("copies")).first()[0] == 0
