from __future__ import annotations

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import resharding

from .helpers import awkward, docs_table, prose


def moved(transport):
    return sum(x for i, row in enumerate(transport) for j, x in enumerate(row) if i != j)


def test_flow():
    rng = random.Random(4)
    for _ in range(40):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        supply = [rng.randint(0, 50) for _ in range(n)]
        capacity = resharding.even(sum(supply), m)
        got = resharding.flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        assert [sum(r) for r in got] == supply and [sum(c) for c in zip(*got)] == capacity
        assert moved(got) == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))


def test_flow_with_costs():
    supply, capacity, cost = [3, 2], [2, 3], [[4, 1], [1, 3]]
    best = min(sum(x * c for x, c in zip(f, [4, 1, 1, 3])) for f in itertools.product(range(4), repeat=4) if f[0] + f[1] == 3 and f[2] + f[3] == 2 and f[0] + f[2] == 2 and f[1] + f[3] == 3)
    got = resharding.flow(supply, capacity, cost)
    assert sum(got[i][j] * cost[i][j] for i in range(2) for j in range(2)) == best
    with pytest.raises(ValueError, match="capacities"):
        resharding.flow([5], [2], [[0]])


def run(spark, rows, shards=4):
    table = docs_table(spark, rows)
    layout = resharding.write_layout(table, F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(3)))
    return resharding.reshard(layout, shards)


def test_reshard(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", "a") for i in range(600)] + [(1000 + i, "copied text", "en", "a") for i in range(200)]
    found = run(spark, rows).select("__doc.doc_id", "__doc.text", "__doc.rank", F.col("__shard").alias("s"), "__old", "__first").collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    sizes = [sum(len(r.text.encode()) + 1 for r in found if r.s == k) for k in range(4)]
    assert max(sizes) - min(sizes) < 100
    assert len({r.s for r in found if r.text == "copied text"}) == 1
    change = sum(len(r.text.encode()) + 1 for r in found if r.s != r["__old"])
    least = sum(sizes) - sum(min(sizes[k], sum(len(r[1].encode()) + 1 for r in rows if zlib.crc32(r[1].encode()) % 3 == k)) for k in range(3))
    assert change <= least + 2000


def test_hot_group_is_split(spark):
    rows = [(i, "one text for all " * 9, "en", "a") for i in range(900)] + [(2000 + i, f"t{i}", "en", "a") for i in range(100)]
    found = run(spark, rows).groupBy("__shard").agg(F.sum(F.length("__doc.text") + 1).alias("b")).collect()
    sizes = [r.b for r in found]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_awkward(spark):
    rows = awkward(random.Random(7))
    assert run(spark, rows).count() == len(rows)
    assert run(spark, []).count() == 0


def test_query(spark):
    """Every row with its size and checksum, bytes near equal, equal texts together, slots without gaps."""
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = resharding.op3_resharding(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in found) == sorted((d, len(t) + 1, zlib.crc32(t)) for d, t in docs)
    assert {r.shard for r in found} <= set(range(16)) and {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    sizes = [sum(r["size"] for r in found if r.shard == k) for k in range(16)]
    texts, where = dict(docs), {}
    for r in found:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    whole = {}
    for _, t in docs:
        whole[t] = whole.get(t, 0) + len(t) + 1
    mean = sum(sizes) / 16
    assert all(len(s) == 1 for t, s in where.items() if whole[t] < 0.5 * mean)
    assert max(sizes) - min(sizes) <= max(mean * 0.02, max(whole.values()))
