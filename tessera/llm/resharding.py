"""Resharding by minimum-cost flow.

Old shards hold files, files hold units, units hold documents; equal texts share an atom of one or more units. From the
bytes of the old shards and the capacities of the new ones a minimum-cost flow gives the bytes that each old shard
sends to each new one; atoms realise the flow, taken from as few files as possible. Only files that lose an atom are
written again; all others stay where they are under their new shard. Law of the result: near-equal bytes.

What the driver holds is bounded by parameters: at most old shards * BUCKETS + MAX_SUBS units, whatever the input.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import keep, scratch

OLD_SHARDS = 12
NEW_SHARDS = 16
BUCKETS = 1024
MAX_SUBS = 16384
FILE_BYTES = 64 << 20
_UNIT = ["__old", "__bucket", "__sub"]


def flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each old to each new shard: the cheapest transport of all supply, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities do not hold all bytes")
    source, sink = n + m, n + m + 1
    head, room, price, edges = [], [], [], defaultdict(list)

    def edge(a: int, b: int, most: int, c: int) -> None:
        for x, y, r, p in ((a, b, most, c), (b, a, 0, -c)):
            edges[x].append(len(head))
            head.append(y)
            room.append(r)
            price.append(p)

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    links = {}
    for i in range(n):
        for j in range(m):
            links[i, j] = len(head)
            edge(i, n + j, supply[i], cost[i][j])
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        far, back, todo = {source: 0}, {}, [(0, source)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for e in edges[a]:
                near = d + price[e] + potential[a] - potential[head[e]]
                if room[e] and near < far.get(head[e], near + 1):
                    far[head[e]], back[head[e]] = near, e
                    heapq.heappush(todo, (near, head[e]))
        for a, d in far.items():
            potential[a] += d
        amount, a = left, sink
        while a != source:
            amount, a = min(amount, room[back[a]]), head[back[a] ^ 1]
        a = sink
        while a != source:
            room[back[a]] -= amount
            room[back[a] ^ 1] += amount
            a = head[back[a] ^ 1]
        left -= amount
    return [[room[links[i, j] ^ 1] for j in range(m)] for i in range(n)]


def assign(atoms: list[tuple[int, int, int]], moves: list[list[int]], capacity: list[int]) -> list[int]:
    """The new shard of each atom (old shard, file, bytes) so that bytes follow the flow.

    What a shard keeps is filled file by file; from the boundary on, the largest atom goes where most is still to come.
    Then single atoms move from the fullest shard against its capacity to the emptiest while that narrows the gap.
    """
    shard = [0] * len(atoms)
    by_old = defaultdict(list)
    for k, (old, _, _) in enumerate(atoms):
        by_old[old].append(k)
    for old, own in by_old.items():
        need = list(moves[old])
        own.sort(key=lambda k: (atoms[k][1], k))
        held = 0
        for held, k in enumerate(own):
            if old >= len(need) or atoms[k][2] > need[old]:
                break
            shard[k], need[old] = old, need[old] - atoms[k][2]
        else:
            held = len(own)
        for k in sorted(own[held:], key=lambda k: (-atoms[k][2], k)):
            to = max(range(len(need)), key=lambda j: (need[j], -j))
            shard[k], need[to] = to, need[to] - atoms[k][2]
    size, to = np.array([a[2] for a in atoms], np.int64), np.array(shard)
    over = np.bincount(to, size, len(capacity)).astype(np.int64) - np.array(capacity) if len(atoms) else np.zeros(len(capacity), np.int64)
    for _ in range(20 * len(capacity)):
        high, low = int(np.argmax(over)), int(np.argmin(over))
        gap = over[high] - over[low]
        own = np.flatnonzero((to == high) & (size < gap))
        if not len(own):
            break
        k = own[np.argmin(np.abs(size[own] - gap / 2))]
        to[k] = low
        over[high] -= size[k]
        over[low] += size[k]
    return to.tolist()


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def text_bytes(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_layout(docs: DataFrame, old_shard, files: int | None = None) -> DataFrame:
    """Write docs as files of their old shards: each row as __doc, so that no column of theirs can clash, with __old, __file, __bucket, __sub.

    A bucket of equal texts with far more rows than the mean is cut into units by doc_id, so that no task meets an
    unbounded group. Null text counts as the empty one; null doc_ids are one value; repeated rows share a unit; an empty
    table gives an empty layout.
    """
    bucket = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(BUCKETS)).cast("int")
    tagged = docs.select(F.struct("*").alias("__doc"), old_shard.cast("int").alias("__old"), bucket.alias("__bucket"))
    sizes = tagged.groupBy("__old", "__bucket").agg(F.count("*").alias("rows"), F.sum(text_bytes(F.col("__doc.text"))).alias("bytes"))
    found = sizes.collect()  # at most old shards * BUCKETS rows
    a_unit = max(1, 4 * sum(r["rows"] for r in found) // MAX_SUBS, 4 * sum(r["rows"] for r in found) // max(1, len(found)))
    large = [(r["__old"], r["__bucket"], -(-r["rows"] // a_unit)) for r in found if r["rows"] > a_unit]
    many = docs.sparkSession.createDataFrame(large, "__old int, __bucket int, __subs int")
    files = files or min(BUCKETS, max(4, sum(r["bytes"] for r in found) // max(1, len({r["__old"] for r in found})) // FILE_BYTES))
    sub = F.pmod(F.xxhash64("__doc.doc_id"), F.coalesce("__subs", F.lit(1))).cast("int")
    placed = tagged.join(F.broadcast(many), ["__old", "__bucket"], "left").withColumn("__sub", sub).drop("__subs")
    placed = placed.withColumn("__file", F.pmod(F.col("__bucket") + F.col("__sub"), F.lit(files)).cast("int"))
    # beyond BUCKETS files of FILE_BYTES a shard, a file of the plan is several on disk, so that no task writes more
    slices = max(1, sum(r["bytes"] for r in found) // max(1, len({r["__old"] for r in found})) // files // FILE_BYTES)
    dealt = placed.repartition("__old", "__file", F.pmod(F.xxhash64("__doc.doc_id", F.lit(1)), F.lit(slices)))
    return keep(dealt.sortWithinPartitions("__old", "__file"), "shards-old", ["__old", "__file"])


def plan(layout: DataFrame, n_new: int = NEW_SHARDS, cost: list[list[int]] | None = None) -> tuple[DataFrame, int]:
    """One row a unit: its new shard, the slot of its first row, and whether its file must be written again. Also in how many files to write what a shard gets."""
    units = layout.groupBy(*_UNIT, "__file").agg(F.count("*").alias("rows"), F.sum(text_bytes(F.col("__doc.text"))).alias("bytes")).collect()
    units.sort(key=lambda r: (r["__old"], r["__bucket"], r["__sub"]))
    total = sum(r["bytes"] for r in units)
    n_old, capacity = max([0, *(r["__old"] for r in units)]) + 1, even(total, n_new)
    supply = [0] * n_old
    whole = defaultdict(int)
    for r in units:
        supply[r["__old"]] += r["bytes"]
        whole[r["__old"], r["__bucket"]] += r["bytes"]
    cost = cost or [[int(i != j) for j in range(n_new)] for i in range(n_old)]
    atoms, atom_of = {}, []
    for r in units:  # equal texts stay together unless they fill most of a shard
        key = (r["__old"], r["__bucket"]) if whole[r["__old"], r["__bucket"]] <= 0.8 * min(capacity) else (r["__old"], r["__bucket"], r["__sub"])
        old, file, size = atoms.get(key, (r["__old"], r["__file"], 0))
        atoms[key] = (old, file, size + r["bytes"])
        atom_of.append(key)
    to = dict(zip(atoms, assign(list(atoms.values()), flow(supply, capacity, cost), capacity), strict=True))
    shard = [to[k] for k in atom_of]
    again = {(r["__old"], r["__file"]) for r, s in zip(units, shard, strict=True) if s != r["__old"]}
    filled, rows = [0] * n_new, []
    for r, s in zip(units, shard, strict=True):
        rows.append((r["__old"], r["__bucket"], r["__sub"], s, filled[s], (r["__old"], r["__file"]) in again))
        filled[s] += r["rows"]
    files = max(8, total // n_new // FILE_BYTES)
    return layout.sparkSession.createDataFrame(rows, "__old int, __bucket int, __sub int, __shard int, __first long, __again boolean"), files


def reshard(layout: DataFrame, n_new: int = NEW_SHARDS, cost: list[list[int]] | None = None) -> DataFrame:
    """The documents under their new shards, read from the files: __doc, __shard, and the slot __first of their unit's first row.

    Null text has size 1 and counts as the empty text's group; a null doc_id is a value like others; rows equal in
    doc_id and text may swap slots; an empty layout gives an empty result.
    """
    spark = layout.sparkSession
    moves, files = plan(layout, n_new, cost)
    placed = layout.join(F.broadcast(moves), _UNIT)
    path = scratch(spark, "shards-new")
    changed = placed.filter("__again").withColumn("__part", F.pmod(F.xxhash64("__bucket", "__sub"), F.lit(files)))
    changed.repartition("__shard", "__part").sortWithinPartitions("__shard", *_UNIT).drop("__again", "__part").write.option("compression", "zstd").partitionBy("__shard").parquet(path)
    names = [c for c in placed.columns if c != "__again"]
    rewritten = spark.read.schema(placed.select(*names).schema).parquet(path).select(*names)
    everything = placed.filter(~F.col("__again")).select(*names).unionByName(rewritten)
    return everything


def op3_resharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    old = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    new = reshard(write_layout(docs, old))
    slim = new.select("__doc.doc_id", text_bytes(F.col("__doc.text")).alias("size"), F.crc32(F.coalesce("__doc.text", F.lit("")).cast("binary")).alias("text_crc32"), *_UNIT, "__shard", "__first")
    place = F.row_number().over(Window.partitionBy(*_UNIT).orderBy("doc_id", "text_crc32"))
    return slim.withColumn("__place", place).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), (F.col("__first") + F.col("__place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
