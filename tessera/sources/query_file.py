"""Query files: one query a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table


def query_table(spark: SparkSession, queries: list[str]) -> DataFrame:
    """qid and raw, stripped; blank queries are dropped, repeats and order are kept."""
    found = [q.strip() for q in queries if q.strip()]
    return small_table(spark, list(enumerate(found)), "qid long, raw string")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a text file, read as a whole so that their order is the file's; a query file is small."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    kept = lines.select("pos", F.trim(F.col("line"), F.lit(" \t\r\n\x0b\x0c")).alias("raw")).filter("raw <> ''")
    return query_table(spark, [r["raw"] for r in kept.orderBy("pos").collect()])
