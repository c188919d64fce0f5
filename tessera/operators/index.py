"""Building an inverted index as ordinary tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import Analyzer

BUCKETS = 64
#: Documents that one chunk of a posting list covers.
CHUNK_DOCS = 1 << 20


@dataclass
class Index:
    """postings (term, doc_id, tf), lexicon (term, df), doc_index (doc_id, original_id, length), stats (num_docs, avgdl)."""

    postings: DataFrame
    lexicon: DataFrame
    doc_index: DataFrame
    stats: DataFrame
    analyzer: Analyzer = field(default_factory=Analyzer)
    buckets: int = 0  # of term_bucket, if postings have it
    summary: tuple[int, float] | None = None  # num_docs, avgdl, where they are known

    def stats_row(self) -> tuple[int, float]:
        """num_docs and avgdl; a saved index knows them, for another one a job finds them once."""
        if self.summary is None:
            row = self.stats.first()
            self.summary = row["num_docs"], row["avgdl"]
        return self.summary


def analyzed(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """doc_id, original_id, terms of docs (doc_id, original_id, content)."""
    return docs.select("doc_id", "original_id", analyzer.terms(F.col("content")).alias("terms"))


def term_postings(terms: DataFrame) -> DataFrame:
    """term, doc_id, tf: counts are summed within a task before they are dealt out."""
    return terms.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lexicon(postings: DataFrame) -> DataFrame:
    """term and df; (term, doc_id) is unique in postings."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_index(terms: DataFrame) -> DataFrame:
    """Lengths with repeats; documents without terms have length 0 and count."""
    return terms.select("doc_id", "original_id", F.size("terms").cast("long").alias("length"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def merge_partials(*partials: DataFrame) -> DataFrame:
    """One posting for each (term, doc_id) of partial postings; counts of the same pair are added."""
    first, *rest = partials
    for other in rest:
        first = first.unionByName(other)
    return first.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def posting_lists(postings: DataFrame, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """term, chunk, n and the n postings by doc_id, for consumers that want lists. A chunk covers chunk_docs document ids, so no row grows with df."""
    chunk = F.floor(F.col("doc_id") / F.lit(chunk_docs)).cast("long")
    return postings.groupBy("term", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def counters(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row about a (partial) index: num_docs, num_terms, num_postings, is_empty. Terms are counted from their lists, so a hot term is one row."""
    lists = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = lists.agg(F.count("*").alias("num_terms"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("num_postings"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(docs.agg(F.count("*").alias("num_docs"))).join(one(terms), "one").select("num_docs", "num_terms", "num_postings", (F.col("num_postings") == 0).alias("is_empty"))


def index_statistics(lexicon_table: DataFrame) -> DataFrame:
    """Number of lists and their average size, 0 without lists."""
    return lexicon_table.agg(F.count("*").alias("number_of_lists"), F.coalesce(F.round(F.try_divide(F.sum("df"), F.count("*")), 2), F.lit(0.0)).alias("average_list_size"))


def build(docs: DataFrame, analyzer: Analyzer | None = None, persist: bool = False) -> Index:
    """An index of docs (doc_id, original_id, content). Nothing runs yet; persist keeps the analyzed terms for the tables
    that are derived from them. For more than one query, or a large corpus, save the index instead."""
    analyzer = analyzer or Analyzer()
    terms = analyzed(docs, analyzer)
    if persist:
        terms = terms.persist()
    postings = term_postings(terms)
    documents = doc_index(terms)
    return Index(postings, lexicon(postings), documents, corpus_stats(documents), analyzer)
