"""What the operators of this subpackage share: durable intermediate tables, grouped Arrow streams, word patterns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..session import keep, scratch  # noqa: F401

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch of whole texts; a text that is longer makes a batch of its own.
TEXT_ROWS, TEXT_BYTES = 1024, 2 << 20


def watched(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """keep(), and measures of the rows as they are written (0 where there is none), without a job of their own."""
    seen = Observation()
    kept = keep(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), name)
    found = seen.get
    return kept, {n: found.get(n) or 0 for n in measures}


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by keep() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Short Arrow batches for the tables that are written meanwhile, which send whole texts to Python; then the session is as before."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT_BYTES)}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by a non-null long column: tables that hold whole runs of equal keys. Only the last run of a batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and held[0].column(key)[held[0].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def spans_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return list(zip(edges, edges[1:], strict=False))
