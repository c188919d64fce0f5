"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets form a class. Each class descends TREES trees. A root is named by the tokens at ROOT
coordinates of a minwise signature, so that documents which share no more than a line part at once: a node of a large group
makes BRANCHES**2 rows of each of its rows. Below, a node chooses BRANCHES coordinates, and a document goes to the child
named by its token there, so a similar pair stays together in a child with its similarity as the chance. A node of at most
LEAF documents is compared exhaustively by signature. A larger one branches again, two levels at a time, unless half of it
is likely similar to its first document: such a group would not split, so it becomes candidate edges as a whole. The trees
share COORDINATES coordinates, and leaves drop pairs under LIKELY of them. With ideal minwise tokens a pair at 0.8 is missed
with a chance of 3.2 * 10**-7 by that cut, and beyond it of 6 * 10**-10 where the roots are leaves, 2.5 * 10**-7 after DEPTH
branchings and 8 * 10**-7 with levels without end.

Leaves give edges of a candidate graph, enough to connect what may be similar. Its components are then joined exactly:
whole shingle sets meet once in each component, an inverted index gives true intersection sizes, and links are followed
until nothing is left to reach. In a component that is too large for one task each document is first compared with a
pivot; those that it links to are one group, and only the others are joined, block by block, with all of the component.
What reaches the driver is counts, and a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, key_runs, spans_of, text_batches, watched

SHINGLE = 5
PERCENT = 80
TREES = 32
#: Coordinates that name a root; with TREES of them each coordinate serves one root.
ROOT = 2
BRANCHES = 2
LEAF = 2048
#: Times that a node branches after its root, two levels each.
DEPTH = 3
COORDINATES = 64
#: Share of equal signature coordinates from which a pair may be similar: over five deviations under 0.8.
LIKELY = 0.53
#: Documents and shingles of a candidate component that one task joins.
BLOCK_DOCS, BLOCK_SHINGLES = 2000, 2_000_000
#: Bytes of a table that every task may hold; beyond it rows are dealt out to meet.
HELD_BYTES = 8 << 20
#: Edges that a task contracts at a time.
CONTRACT_EDGES = 1_000_000
_BITS = 1 << 26
_PROFILE = "row long, doc_id long, text_hash long, n_shingles long, h1 long, h2 long, signature binary"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


_seed = np.random.default_rng(20240917)
_FACTORS = _seed.integers(0, 1 << 32, COORDINATES, np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _seed.integers(0, 1 << 32, COORDINATES, np.uint64).astype(np.uint32)
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_power = [_powers(256)]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word, and how many words lie before each offset. Bytes are taken a few MB at a time."""
    blank = _SEPARATOR[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = ~blank[edges]
    starts = np.flatnonzero(first)
    hashes = np.zeros(len(starts), np.uint64)
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + (2 << 20)))))
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(raw)
        own = starts[a:b] - low
        place = np.arange(high - low) - np.repeat(own, np.diff(np.append(own, high - low)))
        if (longest := int(place.max(initial=0)) + 1) > len(_power[0]):
            _power[0] = _powers(2 * longest)
        values = np.where(blank[low:high], np.uint64(0), _LOWER[raw[low:high]].astype(np.uint64) + np.uint64(1))
        hashes[a:b] = mix(np.add.reduceat(values * _power[0][place], own))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k words, or the whole sequence where there are fewer."""
    raw, offsets = _column_bytes(texts)
    words, before = word_hashes(raw, offsets)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled[: max(0, n - j)] += words[j:] * _PLACES[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(before.tolist(), before.tolist()[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES affine maps of 32 bits."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 1 << 14):
        np.minimum(out, (short[a : a + (1 << 14), None] * _FACTORS + _SHIFTS).min(0), out=out)
    return out


def _identities(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two hashes that name a shingle set."""
    h1 = np.array([int((s * _M2).sum()) & 0xFFFFFFFFFFFFFFFF for s in sets], np.uint64).view(np.int64)
    h2 = np.array([int(mix(s ^ _M1).sum()) & 0xFFFFFFFFFFFFFFFF for s in sets], np.uint64).view(np.int64)
    return pa.array(h1), pa.array(h2)


def _profiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), *_identities(sets), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                ["row", "doc_id", "text_hash", "n_shingles", "h1", "h2", "signature"],
            )

    return run


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _rows(rows: np.ndarray, nodes: np.ndarray, signatures: pa.Array | None) -> pa.RecordBatch:
    columns = [pa.array(nodes.view(np.int64)), pa.array(rows)]
    return pa.RecordBatch.from_arrays(columns, ["node", "row"]) if signatures is None else pa.RecordBatch.from_arrays([*columns, signatures], ["node", "row", "signature"])


def _roots(trees: int, signed: bool):
    """The root of each tree that each row goes to, with its signature or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows = _signatures(batch.column("signature")), batch.column("row").to_numpy()
            for n in range(trees):
                nodes = np.full(len(rows), n + 1, np.uint64)
                for j in range(ROOT):
                    nodes = mix(mix(nodes) ^ tokens[:, (n * ROOT + j) % COORDINATES].astype(np.uint64))
                yield _rows(rows, nodes, batch.column("signature") if signed else None)

    return run


def _descendants(branches: int, signed: bool):
    """The nodes two levels below that each row of a node goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows = _signatures(batch.column("signature")), batch.column("row").to_numpy()
            nodes = [batch.column("node").to_numpy().view(np.uint64)]
            for _ in range(2):
                chosen = [mix(n + _PLACES[j]) for n in nodes for j in range(branches)]
                nodes = [mix(c ^ tokens[np.arange(len(rows)), (c % np.uint64(COORDINATES)).astype(np.int64)].astype(np.uint64)) for c in chosen]
            for n in nodes:
                yield _rows(rows, n, batch.column("signature") if signed else None)

    return run


def _near_pivot(signature: Column, pivot: Column) -> Column:
    """1 where so many coordinates are equal that the two may be similar. Stays in the plan: a task that sends rows to Python twice holds twice the workers."""
    at = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
    same = F.aggregate(at, F.lit(0), lambda n, i: n + (F.substring(signature, 4 * i + 1, F.lit(4)) == F.substring(pivot, 4 * i + 1, F.lit(4))).cast("int"))
    return (same >= F.lit(LIKELY * COORDINATES)).cast("int")


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(likely: float):
    """Edges that connect the documents of each leaf as far as their signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _contracted(compared(batches))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "node"):
            rows, tokens = table["row"].to_numpy(), _signatures(table["signature"])
            spans = spans_of(table["node"].to_numpy())
            pairs = np.array([a for a, b in spans if b - a == 2], np.int64)
            close = pairs[(tokens[pairs] == tokens[pairs + 1]).mean(1) >= likely] if len(pairs) else pairs
            yield _edges(rows[close], rows[close + 1])
            for a, b in spans:
                if b - a < 3:
                    continue
                own = tokens[a:b]
                near = np.stack([(own == own[i]).mean(1) >= likely for i in range(b - a)])
                label = np.arange(b - a)
                while True:
                    least = np.where(near, label[None, :], b - a).min(1)
                    if (least == label).all():
                        break
                    label = least
                more = np.flatnonzero(label != np.arange(b - a))
                yield _edges(rows[a + more], rows[a + label[more]])

    return run


def links(sets: list[np.ndarray], percent: int, asked) -> Iterator[tuple[int, np.ndarray]]:
    """For each index that asked yields, the indexes of all sets of at least percent similarity, by exact intersection sizes."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])[: len(every)]
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(every)))
    ids = np.empty(len(every), np.int32)
    ids[order] = np.cumsum(new, dtype=np.int32) - 1
    by_id = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    del every, order, new
    for i in asked:
        own = ids[edges[i] : edges[i + 1]]
        lengths = often[own]
        at = np.repeat(first[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        shared = np.bincount(by_id[at], minlength=n)
        yield i, np.flatnonzero((100 * shared >= percent * (sizes + sizes[i] - shared)) & (shared > 0))


def link_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index that links reach."""
    label, todo = np.full(len(sets), -1), []

    def order() -> Iterator[int]:
        for root in range(len(sets)):
            if label[root] < 0:
                label[root] = root
                todo.append(root)
            while todo:
                yield todo.pop()

    for i, linked in links(sets, percent, order()):
        new = linked[label[linked] < 0]
        label[new] = label[i]
        todo.extend(new.tolist())
    return label


def _verify(percent: int):
    """From each cell (a whole component), an edge of every row to the least row that links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "cell"):
            rows = table["row"].to_numpy()
            once = np.append(True, rows[1:] != rows[:-1])  # a class whose text is there again
            table, rows = table.filter(pa.array(once)), rows[once]
            blobs = table["shingles"].to_pylist()
            left, right = [], []
            for a, b in spans_of(table["cell"].to_numpy()):
                if b - a > 1:
                    label = link_components([np.frombuffer(x, np.uint64) for x in blobs[a:b]], percent)
                    more = np.flatnonzero(label != np.arange(b - a))
                    left.extend(rows[a + more].tolist())
                    right.extend(rows[a + label[more]].tolist())
            yield _edges(left, right)

    return run


def _reached(percent: int):
    """Whether the pivot of its component links to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, known = [], (None, None)
            for own, pivot in zip(batch.column("shingles").to_pylist(), batch.column("pivot").to_pylist(), strict=True):
                if known[0] != pivot:
                    known = (pivot, np.frombuffer(pivot, np.uint64))
                own = np.frombuffer(own, np.uint64)
                shared = len(np.intersect1d(own, known[1], assume_unique=True))
                near.append(100 * shared >= percent * (len(own) + len(known[1]) - shared))
            names = ["row", "component", "blocks", "shingles"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near, pa.bool_())], [*names, "near"])

    return run


def _verify_far(percent: int):
    """From each cell, the edges of its far rows: to every row that the pivot doesn't link to, and to one of those it does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _contracted(compared(batches))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "cell"):
            rows, asks, near = (table[c].to_numpy(zero_copy_only=False) for c in ("row", "asks", "near"))
            blobs = table["shingles"].to_pylist()
            for a, b in spans_of(table["cell"].to_numpy()):
                own, to, reached = rows[a:b], ~asks[a:b], near[a:b]
                found = np.zeros(b - a, bool)
                for i, linked in links([np.frombuffer(x, np.uint64) for x in blobs[a:b]], percent, np.flatnonzero(asks[a:b])):
                    found[:] = False
                    found[linked] = True
                    found &= to & (own != own[i])
                    one = np.flatnonzero(found & reached)[:1]
                    every = np.concatenate([one, np.flatnonzero(found & ~reached)])
                    if len(every):
                        yield _edges(np.maximum(own[every], own[i]), np.minimum(own[every], own[i]))

    return run


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the least one that the given edges reach; those that are least have none."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while ((up := label[label]) != label).any():
            label = up
        if (label[x] == label[y]).all():
            break
    more = np.flatnonzero(label != np.arange(len(ids)))
    return ids[more], ids[label[more]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, contracted so many at a time."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return _edges(*contract(table["a"].to_numpy(), table["b"].to_numpy()))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= CONTRACT_EDGES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def stars(edges: DataFrame) -> DataFrame:
    """a and up, the least row that edges (a, b) reach, of every row but those that are least themselves.

    A round joins each edge with the least neighbour of its smaller end (large star; the table of least neighbours is
    written, so a hub's rows can be split), then tasks that hold all smaller neighbours of a row contract their edges
    (small star), until every row has one neighbour that has none. A task leaves a row in one edge at most, so rows don't
    gather many neighbours.
    """
    edges = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        least, seen = watched(edges.groupBy("a").agg(F.min("b").alias("up"), (F.max("b") > F.min("b")).alias("many")), "least", many=F.count_if("many"))
        if not seen["many"] and edges.join(least.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return least.select("a", "up")
        raised = edges.join(least.select(F.col("a").alias("b"), "up"), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        before, edges = edges, keep(raised.repartition("a").sortWithinPartitions("a").mapInArrow(_contracted, "a long, b long"), "edges")
        forget(before)
        forget(least)


def components(edges: DataFrame) -> DataFrame:
    """row and component (its least row) of every row with an edge (a, b) to another."""
    found = stars(edges)
    return found.select(F.col("a").alias("row"), F.col("up").alias("component")).unionByName(found.select(F.col("up").alias("row"), F.col("up").alias("component")).distinct())


def _candidate_edges(classes: DataFrame, trees: int, branches: int, leaf: int, depth: int) -> DataFrame:
    """Edges of the candidate graph over classes (row, signature)."""
    source, step, leaves, found = classes.select("row", "signature"), lambda signed: _roots(trees, signed), None, []
    signed = classes.select("row", "signature")

    def members(chosen: DataFrame, size: int) -> DataFrame:
        """The rows of the chosen nodes with their signatures and what chosen says of a node."""
        if size <= HELD_BYTES:
            return source.mapInArrow(step(True), "node long, row long, signature binary").join(F.broadcast(chosen), "node")
        return source.mapInArrow(step(False), "node long, row long").join(chosen, "node").join(signed, "row")

    for at in range(depth + 1):
        nodes = source.mapInArrow(step(False), "node long, row long")
        counts, seen = watched(nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("row").alias("least")).filter("n > 1"), f"counts-{at}", nodes=F.count("*"), large=F.count_if(F.col("n") > leaf))
        small = members(counts.filter(F.col("n") <= leaf).select("node"), 16 * (seen["nodes"] - seen["large"])).select("node", "row", "signature")
        leaves = small if leaves is None else leaves.unionByName(small)
        if not seen["large"]:
            break
        firsts = signed.withColumnsRenamed({"row": "least", "signature": "pivot"})
        pivots = keep(counts.filter(F.col("n") > leaf).select("node", "least").join(firsts, "least"), f"pivots-{at}")
        judged = members(pivots, 300 * seen["large"]).select("node", "row", "signature", "least", _near_pivot(F.col("signature"), F.col("pivot")).alias("near"))
        judged = keep(judged, f"judged-{at}")
        shares, seen = watched(judged.groupBy("node").agg(F.avg("near").alias("share")), f"shares-{at}", loose=F.count_if(F.col("share") < 0.5))
        tight = F.col("share") >= 0.5 if at < depth else F.lit(True)
        found.append(judged.join(shares.filter(tight), "node", "left_semi").select(F.col("row").alias("a"), F.col("least").alias("b")))
        if at == depth or not seen["loose"]:
            break
        source = judged.join(shares.filter(~tight), "node", "left_semi").select("node", "row", "signature")
        step = lambda signed: _descendants(branches, signed)
    edges = leaves.repartition("node").sortWithinPartitions("node", "row").mapInArrow(_compare(LIKELY), "a long, b long")
    for more in found:
        edges = edges.unionByName(more)
    return edges


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """h1, h2, shingles of the rows of docs whose doc_id may be in wanted: a bitmap of fixed size goes to every task, so
    texts aren't shuffled. Rows beyond those wanted do no harm; the join that follows is exact."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_BITS))
    bits = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    tagged = docs.select("doc_id", "text", F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.expr("(byte >> cast(at % 8 as int)) & 1") == 1
    some = tagged.join(F.broadcast(bits), "bucket").withColumn("byte", byte).filter(there).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([*_identities(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "shingles"])

    return some.mapInArrow(run, "h1 long, h2 long, shingles binary")


def _linked(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """a and up: each class of a candidate component (row, component) that true links join to an earlier one, with the earliest."""
    members = keep(clusters.join(classes.select("row", "h1", "h2", "doc_id", "n_shingles"), "row"), "members")
    size = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    large, seen = watched(size.select("component", blocks.alias("blocks")).filter("blocks > 1"), "large", n=F.count("*"))
    # the same text may be there as several rows: each class takes one set
    own = members.select("row", "h1", "h2", "component").join(_sets_of(docs, members.select("doc_id"), k), ["h1", "h2"]).drop("h1", "h2")

    def whole(rows: DataFrame) -> DataFrame:
        ordered = rows.select(F.col("component").alias("cell"), "row", "shingles").repartition("cell").sortWithinPartitions("cell", "row")
        return keep(ordered.mapInArrow(_verify(percent), "a long, b long").select("a", F.col("b").alias("up")), "links")

    if not seen["n"]:
        return whole(own)
    own = keep(own.join(large, "component", "left"), "sets")
    pivots = keep(own.filter("row = component AND blocks IS NOT NULL").select("component", F.col("shingles").alias("pivot")).dropDuplicates(["component"]), "pivot-sets")
    asked = own.filter("blocks IS NOT NULL").join(pivots, "component").select("row", "component", "blocks", "shingles", "pivot")
    judged = keep(asked.mapInArrow(_reached(percent), "row long, component long, blocks int, shingles binary, near boolean"), "judged")
    far = judged.filter("NOT near").groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.octet_length("shingles")) / (8 * BLOCK_SHINGLES))).cast("int").alias("far"))
    far, seen = watched(far, "far", n=F.count("*"))
    edges = judged.filter("near AND row <> component").select(F.col("row").alias("a"), F.col("component").alias("b"))
    if seen["n"]:
        block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
        placed = judged.join(far, "component").withColumn("f", block("far", 1)).withColumn("b", block("blocks", 2))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = placed.filter("NOT near").withColumn("b", each("blocks")).withColumn("asks", F.lit(True))
        asked = placed.withColumn("f", each("far")).withColumn("asks", F.lit(False))
        cells = asking.unionByName(asked).select(F.xxhash64("component", "f", "b").alias("cell"), "row", "asks", "near", "shingles")
        edges = edges.unionByName(cells.repartition("cell").sortWithinPartitions("cell", "row").mapInArrow(_verify_far(percent), "a long, b long"))
    return whole(own.filter("blocks IS NULL")).unionByName(stars(edges))


def groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, branches: int = BRANCHES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, component_id, keeper (the row of the group that stays) of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. Text without words has no shingles and is a group of its own.
    Null doc_ids are grouped but never smallest unless all are null. Repeated rows are one group. An empty table gives
    an empty result. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    with text_batches(docs.sparkSession):
        profile = keep(rows.mapInArrow(_profiles(k), _PROFILE), "profile")
        some = profile.filter("n_shingles > 0")
        ordered = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        by_set = some.groupBy("h1", "h2").agg(F.min("row").alias("row"), F.min(ordered).alias("least"), F.min_by("doc_id", "row").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.min_by("signature", "row").alias("signature"))
        classes = keep(by_set, "classes")
        linked = _linked(docs, classes, components(_candidate_edges(classes, trees, branches, leaf, depth)), k, percent)
    labelled = keep(classes.select("row", "h1", "h2", "least").join(linked.withColumnRenamed("a", "row"), "row", "left").withColumn("component", F.coalesce("up", "row")), "labelled")
    least = keep(labelled.groupBy("component").agg(F.min("least").alias("of_all"), F.count("*").alias("n")).filter("n > 1"), "named")  # a table, so that the join can split a hot component
    of_class = labelled.join(least, "component", "left").select("h1", "h2", F.coalesce("of_all", "least").alias("of_all"))
    named = some.join(of_class, ["h1", "h2"]).select("row", "doc_id", "text_hash", "n_shingles", F.col("of_all.doc_id").alias("component_id"), F.col("of_all.row").alias("keeper"))
    alone = profile.filter("n_shingles = 0").select("row", "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("keeper"))
    return named.unionByName(alone)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without all but one of each group; rows without words stay. All columns are kept."""
    found = groups(docs, **options)
    stay = found.filter("row = keeper").filter("n_shingles > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.filter(words).select(F.struct("*").alias("__doc"), F.col("doc_id").cast("long").alias("__own"), F.xxhash64("text").alias("__text"))
    joined = own.join(stay, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    one = joined.withColumn("__n", F.row_number().over(Window.partitionBy("__own", "__text").orderBy(F.lit(1)))).filter("__n = 1")
    return one.select("__doc.*").unionByName(docs.filter(~words))


def op4_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
