"""Saving and opening an index as Parquet tables.

Postings are partitioned by a bucket of their term and sorted by term and document, so that a lookup reads one
partition and, by row-group statistics, few row groups of it. Writes are rebalanced: a bucket with a hot term is spread
over several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import Analyzer
from ..operators.index import BUCKETS, Index, analyzed, corpus_stats, doc_index, index_statistics, lexicon, term_postings
from ..session import spread

TABLES = ("postings", "lexicon", "doc_index", "stats", "settings")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def save(docs: DataFrame, path: str, analyzer: Analyzer | None = None, buckets: int = BUCKETS) -> Index:
    """Index docs (doc_id, original_id, content) at path, replacing what is there. Every text is analyzed once."""
    spark, analyzer = docs.sparkSession, analyzer or Analyzer()
    analyzed(spread(docs), analyzer).write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    postings = term_postings(terms).withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    postings.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term", "doc_id").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings")
    lexicon(spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
    doc_index(terms).write.mode("overwrite").parquet(f"{path}/doc_index")
    corpus_stats(spark.read.parquet(f"{path}/doc_index")).write.mode("overwrite").parquet(f"{path}/stats")
    row = spark.read.parquet(f"{path}/stats").first()
    settings = [(analyzer.to_json(), buckets, row["num_docs"], row["avgdl"])]
    spark.createDataFrame(settings, "analyzer string, buckets int, num_docs long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    _delete(spark, f"{path}/terms")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """Open a saved index: one row of settings is read, tables when queries need them."""
    settings = spark.read.schema("analyzer string, buckets int, num_docs long, avgdl double").parquet(f"{path}/settings").first()
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES[:4]}
    return Index(**tables, analyzer=Analyzer.from_json(settings["analyzer"]), buckets=settings["buckets"], summary=(settings["num_docs"], settings["avgdl"]))


def close(index: Index) -> None:
    """Drop what the session caches of an index's tables. Files stay; an Index that was closed can still be read."""
    for table in (index.postings, index.lexicon, index.doc_index, index.stats):
        table.unpersist()


def _of_terms(table: DataFrame, terms: list[str]) -> DataFrame:
    return table.filter(F.col("term").isin(*terms))


def read_postings(index: Index, terms: list[str]) -> DataFrame:
    """Postings of some terms by ascending doc_id; partitions without them are not read. An absent term has no rows.

    The plan fails if the length of a list is not the df that the lexicon has for its term.
    """
    found = _of_terms(index.postings, terms)
    if index.buckets:
        spark = index.postings.sparkSession
        wanted = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(term_bucket(F.col("t"), index.buckets).alias("b")).distinct().collect()]
        found = found.filter(F.col("term_bucket").isin(*wanted))
    lists = found.groupBy("term").agg(F.count("*").alias("found"))
    wrong = F.raise_error(F.concat(F.lit("the posting list of "), "term", F.lit(" has "), F.coalesce("found", F.lit(0)).cast("string"), F.lit(" postings, the lexicon says "), F.col("df").cast("string")))
    both = _of_terms(index.lexicon, terms).join(lists, "term", "left").join(found.select("term", "doc_id", "tf"), "term", "left")
    # one condition, so that the second join stays an outer one and a list that is gone altogether meets the check
    checked = both.filter(F.when(F.col("df") != F.coalesce("found", F.lit(0)), wrong.cast("boolean")).otherwise(F.col("doc_id").isNotNull()))
    return checked.select("term", "doc_id", "tf").orderBy("term", "doc_id")


def check_integrity(index: Index) -> DataFrame:
    """Terms whose list and df disagree, with both numbers; empty for a sound index."""
    lists = index.postings.groupBy("term").agg(F.count("*").alias("found"))
    both = index.lexicon.join(lists, "term", "full")
    return both.filter(~F.col("df").eqNullSafe(F.col("found"))).select("term", "df", "found")


def get_df(index: Index, terms: DataFrame) -> DataFrame:
    """terms (term) with df, 0 where it is absent."""
    return terms.join(index.lexicon, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def size_mb(spark: SparkSession, path: str) -> float:
    fs, where = _hadoop(spark, path)
    return fs.getContentSummary(where).getLength() / 1024**2


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """index_size_mb, number_of_lists, average_list_size of a saved index: size of postings, lexicon and doc_index."""
    size = sum(size_mb(spark, f"{path}/{t}") for t in TABLES[:3])
    return index_statistics(load(spark, path).lexicon).select(F.lit(round(size, 3)).alias("index_size_mb"), "number_of_lists", "average_list_size")
