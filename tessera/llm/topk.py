"""Exact top-k inner product search with a KD-tree for each shard.

Queries are taken in blocks of bounded size, which every task gets whole; vectors never move. What a task reads is cut
into shards of bounded size. For each a tree is built by median splits with tight bounding boxes, and walked best-first
for each query: the largest inner product that a box allows orders the visits, and the walk ends when it falls under the
kth score so far. Vectors are searched in rounds, each ROUND_GROWTH times larger than all before it; the kth score of a
query after a round is where its next one starts, so most shards of the last round end at their first boxes.

Scores are exact for all finite components. While sums stay under 2**53 floating point has them exactly; a shard beyond
that is searched with a margin for rounding, and whatever comes within it is added up again in whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

K = 5
SHARD_ROWS = 16384
#: Queries of a block; a block of longer vectors has fewer, as BLOCK_BYTES says.
BLOCK_ROWS, BLOCK_BYTES = 65536, 64 << 20
LEAF_ROWS = 256
ROUND_GROWTH = 16
#: Relative error of a sum of up to a million rounded products, with room.
_ROUNDING = 2.0**-30
_FOUND = "query_id long, vec_id long, score long"
_MOST = (1 << 63) - 1
_PLACES = 1 << 30


class KDTree:
    """Median splits along the widest side of a tight box, down to leaves; rows of a leaf are contiguous."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(ids))
        self.low, self.high, self.first_id, self.rows, self.children = [], [], [], [], []
        self._vectors, self._ids, self._leaf = vectors, ids, leaf_rows
        self._build(0, len(ids))
        self.vectors, self.ids = vectors[self.order], ids[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, a: int, b: int) -> int:
        node, own = len(self.rows), self._vectors[self.order[a:b]]
        low, high = own.min(0), own.max(0)
        self.low.append(low)
        self.high.append(high)
        self.first_id.append(int(self._ids[self.order[a:b]].min()))
        self.rows.append((a, b))
        self.children.append(())
        if b - a > self._leaf:
            side, half = int(np.argmax(high - low)) if low.size else 0, (b - a) // 2
            if low.size:
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], half)]
            self.children[node] = (self._build(a, a + half), self._build(a + half, b))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in each node's box, with room for rounding where there is any."""
        top = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        return top if self.exact(queries) else np.nan_to_num(top + _ROUNDING * self._size(queries), nan=np.inf, posinf=np.inf)

    def _size(self, queries: np.ndarray) -> np.ndarray:
        """What the absolute values of a product's terms can add up to, by query and node."""
        return np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T

    def exact(self, queries: np.ndarray) -> bool:
        """Whether floating point has every sum exactly."""
        with np.errstate(over="ignore", invalid="ignore"):
            return bool(self._size(queries)[:, :1].max(initial=0.0) < 2.0**53)

    def search(self, query: np.ndarray, own: int, k: int, bound: np.ndarray, least: float | int, exact: bool = True) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without id own; only scores of at least `least` are needed."""
        best: list[tuple[float, int]] = []  # (score, -id), the worst first
        todo = [(-float(bound[0]), 0)]
        while todo:
            top, node = heapq.heappop(todo)
            if -top < least or len(best) == k and -top < best[0][0]:
                break
            if len(best) == k and -top == best[0][0] and self.first_id[node] > -best[0][1]:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(todo, (-float(bound[child]), child))
                continue
            a, b = self.rows[node]
            floor = max(least, best[0][0]) if len(best) == k else least
            for entry in self._leaf_scores(a, b, query, own, k, floor, exact):
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]

    def _leaf_scores(self, a: int, b: int, query: np.ndarray, own: int, k: int, floor: float | int, exact: bool) -> list[tuple[float, int]]:
        """(score, -id) of the rows of a leaf that may be among the k best."""
        ids = self.ids[a:b]
        if exact:
            scores = self.vectors[a:b] @ query
            good = np.flatnonzero((ids != own) & (scores >= floor))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -scores[good]))[:k]]
            return [(scores[i], -int(ids[i])) for i in good]
        rows = self.vectors[a:b]
        with np.errstate(over="ignore", invalid="ignore"):
            upper = np.nan_to_num(rows @ query + _ROUNDING * (np.abs(rows) @ np.abs(query)), nan=np.inf, posinf=np.inf)
        whole = [int(x) for x in query]
        good = [i for i in np.flatnonzero(ids != own).tolist() if float(upper[i]) >= floor]  # Python compares a float with a whole number exactly
        return [(sum(int(x) * y for x, y in zip(rows[i].tolist(), whole, strict=True) if x), -int(ids[i])) for i in good]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to the given width."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task reads, cut into shards."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHARD_ROWS - sum(h.num_rows for h in held))
            batch = batch.slice(part.num_rows)
            held.append(part)
            if sum(h.num_rows for h in held) >= SHARD_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search(shared, k: int):
    """The best of each shard for each query of a block: ids, vectors, and the kth score so far (None where there is none yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries, least = shared.value
        for shard in _shards(batches):
            lists = shard.column("vector")
            width = max(queries.shape[1], int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
            asked = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
            tree = KDTree(_matrix(lists, width), shard.column("vec_id").to_numpy())
            exact, bounds, found = tree.exact(asked), None, []
            for n, q in enumerate(own.tolist()):
                if n % 1024 == 0:
                    bounds = tree.bounds(asked[n : n + 1024])
                found += [(q, i, max(-_MOST - 1, min(_MOST, s))) for s, i in tree.search(asked[n], q, k, bounds[n % 1024], -np.inf if least[n] is None else least[n], exact)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector: floor(256 * x) of each component x as a double; rows with a null id or vector, or a null or non-finite component, are left out.

    A product beyond the largest double is that double, of its sign.
    """
    largest = 1.7976931348623157e308
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= largest) & ~F.isnan(x))

    def scaled(x):
        y = x.cast("double") * 256.0
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(largest)), F.lit(-largest)))

    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", scaled).alias("vector")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest integer inner products for each query; both inputs are (vec_id, vector) of whole numbers.

    A query's own row is every row with its vec_id. Ties go to the smaller vec_id; repeated vectors are candidates each;
    repeated query ids are searched once, with the smallest of their vectors. Shorter vectors count as padded with
    zeros. A score that a long cannot hold is the nearest long, and ties with others of its kind. Empty inputs give an empty result.

    The driver holds one block of queries at a time, with their kth scores. Vectors are written once and read once a
    block and round; a block is the only thing that all tasks get.
    """
    spark = vectors.sparkSession
    place = lambda *by: F.pmod(F.xxhash64(*by), F.lit(_PLACES))
    vectors = keep(vectors.select("vec_id", "vector").withColumn("place", place("vec_id", "vector")), "topk-vectors")
    queries = keep(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("place", place("vec_id")), "topk-queries")
    n, asked, width = vectors.count(), queries.count(), queries.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-asked // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))))
    edges = [0]
    while edges[-1] < _PLACES:
        share = SHARD_ROWS / max(1, n) if len(edges) == 1 else ROUND_GROWTH * edges[-1] / _PLACES
        edges.append(min(_PLACES, max(edges[-1] + 1, int(share * _PLACES))) if share < 0.6 else _PLACES)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    answers = spark.createDataFrame([], f"{_FOUND}, rank int")
    for block in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)) == block).select("vec_id", "vector").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids, matrix = rows["vec_id"].to_numpy(), _matrix(rows["vector"].combine_chunks(), width)
        kth: dict[int, int] = {}
        found = None
        for low, high in zip(edges, edges[1:], strict=False):
            shared = spark.sparkContext.broadcast((ids, matrix, [kth.get(i) for i in ids.tolist()]))
            more = vectors.filter((F.col("place") >= low) & (F.col("place") < high)).select("vec_id", "vector").mapInArrow(_search(shared, k), _FOUND)
            found = keep(ranked(more if found is None else found.select("query_id", "vec_id", "score").unionByName(more)), "topk-found")
            if high < _PLACES:
                kth = {r["query_id"]: r["score"] for r in found.filter(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query of the block
        answers = answers.unionByName(found)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = _usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256.0::DOUBLE)::BIGINT) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vector, c.vector), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
