"""Corpora: JSONL files, or any table with an id and texts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep

_PARSED = "path string, block long, line long, nth long, id string, title string, text string, keywords array<string>, reason string"
_ARROW = pa.schema([("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("nth", pa.int64()), ("id", pa.string()), ("title", pa.string()), ("text", pa.string()), ("keywords", pa.list_(pa.string())), ("reason", pa.string())])


@dataclass
class Corpus:
    """documents: doc_id (dense, in file order), original_id, title, text, keywords; rejects: path, line_no, reason."""

    documents: DataFrame
    rejects: DataFrame

    def counts(self) -> tuple[int, int]:
        """Documents read and lines skipped; blank lines are neither. Both come from the parsed table, no line is parsed again."""
        return self.documents.count(), self.rejects.count()


def parse_line(line: str) -> dict:
    """A record, or a reason for rejecting the line. Ids become text; falsy fields are empty; keywords that aren't a list are none."""
    try:
        found = json.loads(line)
    except ValueError:
        return {"reason": "invalid JSON"}
    if not isinstance(found, dict):
        return {"reason": "not an object"}
    if found.get("id") is None:
        return {"reason": "no id"}
    words = found.get("keywords")
    return {
        "id": str(found["id"]), "title": str(found.get("title") or ""), "text": str(found.get("text") or ""),
        "keywords": [str(w) for w in words] if isinstance(words, list) else [], "reason": None,
    }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line, nth, here = 0, 0, None
    for batch in batches:
        rows = []
        for path, block, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
            line, nth, here = (line + 1, nth, here) if here == (path, block) else (0, 0, (path, block))
            found = parse_line(value) if (value := value.strip()) else {"reason": "blank"}
            nth += found["reason"] is None
            rows.append({"path": path, "block": block, "line": line, "nth": nth} | found)
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _parse_native(lines: DataFrame) -> DataFrame:
    record = F.from_json("value", "id string, title string, text string, keywords string")
    words = F.coalesce(F.from_json(F.col("r.keywords"), "array<string>"), F.array().cast("array<string>"))
    reason = F.when(F.trim("value") == "", "blank").when(F.col("r").isNull() | ~F.trim("value").startswith("{"), "invalid JSON").when(F.col("r.id").isNull(), "no id")
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1).withColumn("r", record)
    nth = F.count_if(reason.isNull()).over(Window.partitionBy("path", "block").orderBy("line"))
    return numbered.select("path", "block", F.col("line").cast("long").alias("line"), nth.alias("nth"), "r.id", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.text", F.lit("")).alias("text"), words.alias("keywords"), reason.alias("reason"))


def read_jsonl(spark: SparkSession, path: str, max_docs: int | None = None, native: bool = False) -> Corpus:
    """Read JSONL. Ids are dense over accepted lines in file order: each split numbers its own, and the counts of the
    splits before it are added. max_docs keeps the first so many documents; None and 0 keep all, a negative number none.
    Every line is parsed once: the parsed rows are written in the shared folder, and all that follows reads columns of that table.

    native parses inside the plan: trailing text after an object is accepted and false values become text.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    parsed = keep(_parse_native(lines) if native else lines.select("path", "block", "value").mapInArrow(_parse, _PARSED), "parsed-lines")
    ordered = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    accepted = parsed.filter(F.col("reason").isNull())
    sizes = parsed.groupBy("path", "block").agg(F.count_if(F.col("reason").isNull()).alias("good"), F.max("line").alias("last"))  # one row a split
    offsets = sizes.select("path", "block", F.coalesce(F.sum("good").over(ordered), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("last") + 1).over(in_file), F.lit(0)).alias("lines_before"))
    documents = accepted.join(offsets, ["path", "block"]).select((F.col("before") + F.col("nth") - 1).alias("doc_id"), F.col("id").alias("original_id"), "title", "text", "keywords")
    rejects = parsed.filter(F.col("reason").isNotNull() & (F.col("reason") != "blank")).join(offsets, ["path", "block"])
    return Corpus(first_docs(documents, max_docs), rejects.select("path", (F.col("lines_before") + F.col("line") + 1).alias("line_no"), "reason"))


def first_docs(documents: DataFrame, max_docs: int | None) -> DataFrame:
    return documents.filter(F.col("doc_id") < max_docs) if max_docs else documents


def full_content(title="title", text="text", keywords="keywords") -> Column:
    """Title, text and each keyword with single spaces; an empty title or text is skipped."""
    return F.concat_ws(" ", F.nullif(F.col(title), F.lit("")), F.nullif(F.col(text), F.lit("")), F.col(keywords))


def from_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, original_id, content of a table whose ids are unique numbers."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_id).cast("string").alias("original_id"), F.coalesce(F.col(text), F.lit("")).alias("content"))


def contents(documents: DataFrame) -> DataFrame:
    """doc_id, original_id, content of a corpus's documents."""
    return documents.select("doc_id", "original_id", full_content().alias("content"))
