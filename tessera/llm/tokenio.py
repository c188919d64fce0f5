"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart from data.

A file is a run of blocks. A block starts with its magic and six numbers (documents, ids, control bytes, data bytes,
null ids, 0), then come document ids and token counts as 64-bit integers, the control bytes and the data bytes. Four
ids share a control byte, two bits each for their length less one; data bytes are little-endian ranks. The rank of an
id is its place by frequency over the whole corpus; `ranks.u32` beside the files lists the ids by rank.

Files get names of their own for each attempt; only those in the manifest, which a Spark commit makes visible, count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, scratch, text_batches
from .tokenizing import definition, encoder

END_ID = 2
BLOCK_IDS = 1 << 20
FILE_IDS = 128 << 20
_MAGIC = b"TESSIDS1"
_CODES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MANIFEST = "part int, path string, n_docs long, n_ids long"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(size.max(initial=0)) + 1
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return control.tobytes(), raw[np.arange(width, dtype=np.uint8) <= size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks, by table lookup of four lengths for each control byte."""
    sizes = _CODES[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    at, raw = ends - sizes, np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for byte in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > byte)
        out[more] |= raw[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def _open(uri: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark names it, and the path there; s3a and s3n are what others call s3."""
    scheme, mark, rest = uri.partition("://")
    return FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri)


def _write_block(out, docs: list, parts: list[np.ndarray], rank_of: np.ndarray) -> None:
    ids = np.concatenate(parts)
    control, data = encode_ranks(rank_of[ids])
    known = np.array([d is not None for d in docs])
    numbers = [len(docs), len(ids), len(control), len(data), int((~known).sum()), 0]  # null ids sort first
    out.write(_MAGIC + np.array(numbers, "<i8").tobytes())
    out.write(np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([len(p) for p in parts], "<i8").tobytes())
    out.write(control)
    out.write(data)


def read_file(uri: str, id_of: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, token counts and token ids of each block of a file."""
    fs, path = _open(uri)
    with fs.open_input_stream(path) as file:
        while head := file.read(len(_MAGIC) + 48):
            if head[: len(_MAGIC)] != _MAGIC:
                raise ValueError(f"{uri} is not a token file")
            n_docs, n_ids, n_control, n_data, n_null, _ = np.frombuffer(head[len(_MAGIC) :], "<i8").tolist()
            docs = np.frombuffer(file.read(8 * n_docs), "<i8").tolist()
            sizes = np.frombuffer(file.read(8 * n_docs), "<i8")
            yield [None] * n_null + docs[n_null:], sizes, id_of[decode_ranks(file.read(n_control), file.read(n_data), n_ids)]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (compressed 32-bit integers, the end id included) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codec = encoder(shared.value), pa.Codec("zstd", 1)
        for batch in batches:
            ids = [i + end for i in own.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([codec.compress(_narrow(i), asbytes=True) for i in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _narrow(ids: bytes) -> bytes:
    """Low halves of all ids, then high halves: the latter compress to almost nothing."""
    halves = np.frombuffer(ids, "<u2").reshape(-1, 2)
    return np.ascontiguousarray(halves.T).tobytes()


def _ids(blob: bytes, n: int) -> np.ndarray:
    halves = np.frombuffer(pa.Codec("zstd").decompress(blob, 4 * n, asbytes=True), "<u2").reshape(2, n)
    return halves[0].astype(np.uint32) | halves[1].astype(np.uint32) << np.uint32(16)


def frequencies(rows: DataFrame) -> DataFrame:
    """id and count over all rows; a task sends one row an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for blob, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                more = np.bincount(_ids(blob, n))
                if len(more) > len(total):
                    total = np.append(total, np.zeros(len(more) - len(total), np.int64))
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write token rows in ascending doc_id order; the manifest has part, path, n_docs, n_ids of each file, in order of part."""
    spark = rows.sparkSession
    counted = frequencies(rows).collect()  # at most one row an id of the vocabulary
    id_of = np.array([r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))], "<u4")
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/ranks.u32") as out:
        out.write(id_of.tobytes())
    total = sum(r["n"] for r in counted)
    files = max(1, -(-total // FILE_IDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK_IDS))))
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        fs, path = _open(name)
        out, n_docs, n_ids, docs, parts, held = None, 0, 0, [], [], 0
        for batch in batches:
            for doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                out = out or fs.open_output_stream(path)
                docs.append(doc)
                parts.append(_ids(blob, n))
                n_docs, n_ids, held = n_docs + 1, n_ids + n, held + n
                if held >= BLOCK_IDS:
                    _write_block(out, docs, parts, shared.value)
                    docs, parts, held = [], [], 0
        if docs:
            _write_block(out, docs, parts, shared.value)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    order = ["doc_id", "n_tokens", F.xxhash64("ids")]
    return keep(rows.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(run, _MANIFEST), "tokens-manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; start counts the ids of all documents before it."""
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before).repartition(max(1, manifest.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                if id_of is None:
                    fs, ranks = _open(f"{folder}/ranks.u32")
                    with fs.open_input_stream(ranks) as file:
                        id_of = np.frombuffer(file.read(), "<u4")
                for docs, sizes, ids in read_file(path, id_of):
                    ends = np.cumsum(sizes)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    return placed.select("path", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """The manifest of the files that hold the ids of docs (doc_id, text). Null text is empty (the end id alone); null
    doc_ids come first; equal doc_ids are ordered by length and content; repeated rows are written each; an empty table
    gives an empty manifest."""
    with text_batches(docs.sparkSession):
        rows = keep(token_rows(docs, tokenizer, end_id), "tokens-rows")
        manifest = write_files(rows, folder)
    forget(rows)
    return manifest


def op5_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_files(manifest, folder)
