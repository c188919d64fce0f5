"""Packing documents into sequences by the sum-of-squares rule.

A document's pieces are dealt at random into lanes of bounded size. A lane keeps only the number of open sequences of
each fill level; a piece goes where the sum of the squares of these numbers becomes smallest (ties: the fullest), or
opens a sequence if that is smaller still. What is left in open sequences when a lane ends is packed once more, largest
piece first into the fullest sequence with room. Lanes are independent, so any number of tasks can run them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, key_runs, spans_of, text_batches
from .tokenizing import definition, encoder

TOKENS = 4096
LANE_ROWS = 8192
END_ID = 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 (and ids) of docs (doc_id, text): token ids and then end_id, cut only beyond `tokens`."""
    shared = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([r[5] for r in rows], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item in the order given, and the number of bins."""
    counts = np.zeros(room + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    where, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for item, size in enumerate(lengths.tolist()):
        levels = np.flatnonzero(counts[1 : room - size + 1]) + 1
        pick = 0
        if len(levels):
            change = 2 * (counts[levels + size] - counts[levels]) + 2
            if levels[-1] + size == room:
                change[-1] = 1 - 2 * counts[levels[-1]]
            least = change.min()
            if least <= 2 * counts[size] + 1:
                pick = int(levels[np.flatnonzero(change == least)[-1]])
        if pick:
            counts[pick] -= 1
            to = open_bins[pick].pop()
        else:
            to, bins = bins, bins + 1
        where[item], offset[item] = to, pick
        if pick + size < room:
            counts[pick + size] += 1
            open_bins[pick + size].append(to)
    return where, offset, bins


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, largest first into the fullest bin with room."""
    counts = np.zeros(room + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    where, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        levels = np.flatnonzero(counts[1 : room - size + 1]) + 1
        pick = int(levels[-1]) if len(levels) else 0
        if pick:
            counts[pick] -= 1
            to = open_bins[pick].pop()
        else:
            to, bins = bins, bins + 1
        where[item], offset[item] = to, pick
        if pick + size < room:
            counts[pick + size] += 1
            open_bins[pick + size].append(to)
    return where, offset, bins


def pack_lane(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of a lane."""
    where, offset, bins = sum_of_squares(lengths, room)
    fill = np.bincount(where, lengths, bins)
    left = np.flatnonzero(fill[where] < room)
    if len(left):
        again, at, _ = best_fit(lengths[left], room)
        where[left], offset[left] = bins + again, at
    return where, offset


def pack(items: DataFrame, room: int = TOKENS, lane_rows: int = LANE_ROWS) -> DataFrame:
    """items (length and any other columns but __row, __lane) with sequence_id and offset; lengths are 1 to room.

    Equal items are items of their own. An empty table gives an empty result. Items are dealt by a hash of their row
    number in a written table, so repeated rows and hot sources spread evenly.
    """
    with text_batches(items.sparkSession):
        held = keep(items.withColumn("__row", F.monotonically_increasing_id()), "pack-items")
    lanes = -(-max(1, held.count()) // lane_rows)
    dealt = held.withColumn("__lane", F.pmod(F.xxhash64("__row"), F.lit(lanes)))
    ordered = dealt.repartition(lanes, "__lane").sortWithinPartitions("__lane", F.xxhash64("__row", F.lit(1)), "__row")
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "__lane"):
            lane = table["__lane"].to_numpy()
            for a, b in spans_of(lane):
                part = table.slice(a, b - a)
                where, offset = pack_lane(part["length"].to_numpy(), room)
                columns = [*(part[c] for c in names), pa.chunked_array([pa.array((int(lane[a]) << 32) + where)]), pa.chunked_array([pa.array(offset)])]
                yield from pa.Table.from_arrays(columns, [*names, "sequence_id", "offset"]).to_batches(max_chunksize=4096)

    schema = ", ".join(f"`{n}` {k}" for n, k in items.dtypes)
    return ordered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of docs (doc_id, text) with its place. Null or empty text is one token, end_id; a null doc_id is kept;
    repeated rows are packed each; other columns are not read."""
    return pack(pieces(docs, tokenizer, tokens, end_id, with_ids), tokens)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
