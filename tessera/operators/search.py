"""Answering batches of keyword queries in one plan: all terms of a query must be in a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzer import Analyzer
from ..functions.scoring import Scorer, get_scorer
from ..session import small_table
from ..sources.index_store import term_bucket
from .index import Index

TOP_K = 10
#: Queries of a batch that the driver plans by their terms; a larger batch stays a table throughout.
PLANNED_QUERIES = 10_000
#: Postings of the rarest terms, by their df, that every task may hold.
HELD_POSTINGS = 200_000


def parse_queries(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """qid, raw (stripped), terms without repeats in first-seen order, of queries (qid, raw)."""
    raw = F.trim(F.col("raw"), F.lit(" \t\r\n\x0b\x0c"))
    return queries.select("qid", raw.alias("raw"), F.array_distinct(analyzer.terms(raw)).alias("terms"))


def query_terms(parsed: DataFrame) -> DataFrame:
    """qid, pos, term, n_terms."""
    return parsed.select("qid", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("pos", "term")).select("qid", "pos", "term", "n_terms")


def lookup(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Query terms with df, null where the lexicon has no such term."""
    return terms.join(lexicon, "term", "left").select("qid", "pos", "term", "n_terms", "df")


def resolved(found: DataFrame) -> DataFrame:
    """Query terms of the queries none of whose terms is missing; the others need no posting at all."""
    missing = found.filter(F.col("df").isNull()).select("qid").distinct()
    return found.join(missing, "qid", "left_anti")


def _with_postings(rows: DataFrame, index: Index, *keys: str) -> DataFrame:
    """rows (with term) joined with their postings; with stored buckets the join prunes partitions by what the rows need."""
    if index.buckets:
        rows, keys = rows.withColumn("term_bucket", term_bucket(F.col("term"), index.buckets)), ("term_bucket", *keys)
    return rows.join(index.postings, list(keys))


def hits(live: DataFrame, index: Index) -> DataFrame:
    """A row for each query term and posting."""
    return _with_postings(live, index, "term").select("qid", "pos", "term", "n_terms", "df", "doc_id", "tf")


@dataclass(frozen=True)
class _Term:
    df: int
    pos: int
    term: str
    bucket: int


def _of_terms(terms: DataFrame, index: Index, known: list[_Term]) -> DataFrame:
    """The postings of a small table of query terms, which every task holds; known terms and their buckets reach the scan."""
    postings = index.postings
    if index.buckets:
        postings = postings.filter(F.col("term_bucket").isin(*{t.bucket for t in known}))
    if len(known) <= 100:
        postings = postings.filter(F.col("term").isin(*{t.term for t in known}))
    return postings.join(F.broadcast(terms), "term")


def _matched(more: DataFrame) -> DataFrame:
    """Documents with as many postings of other terms as the query has."""
    more = more.withColumn("other", F.struct("other.df", "other.pos", "other.term", "tf"))
    grouped = more.groupBy("qid", "doc_id").agg(F.count("*").alias("m"), F.first("n_rest").alias("n_rest"), F.first("one").alias("one"), F.collect_list("other").alias("others"))
    return grouped.filter("m = n_rest").select("qid", "doc_id", F.array_sort(F.concat(F.array("one"), "others")).alias("postings"))


def _match_planned(batch: dict[int, list[_Term]], index: Index) -> DataFrame:
    """match() for a batch whose terms the driver knows, each query's sorted by (df, pos)."""
    spark, parts = index.postings.sparkSession, []
    one = F.struct("df", "pos", "term", "tf").alias("one")
    single = [(q, t[0].df, t[0].pos, t[0].term) for q, t in batch.items() if len(t) == 1]
    if single:
        rows = _of_terms(small_table(spark, single, "qid long, df long, pos int, term string"), index, [t[0] for t in batch.values() if len(t) == 1])
        parts.append(rows.select("qid", "doc_id", F.array(one).alias("postings")))
    several = {q: t for q, t in batch.items() if len(t) > 1}
    if several:
        rare = small_table(spark, [(q, t[0].df, t[0].pos, t[0].term, len(t) - 1) for q, t in several.items()], "qid long, df long, pos int, term string, n_rest int")
        first = _of_terms(rare, index, [t[0] for t in several.values()]).select("qid", "doc_id", one, "n_rest")
        others = small_table(spark, [(q, x.df, x.pos, x.term) for q, t in several.items() for x in t[1:]], "qid long, df long, pos int, term string")
        others = others.select("qid", F.struct("df", "pos", "term").alias("other"), "term")
        if sum(t[0].df for t in several.values()) <= HELD_POSTINGS:
            there = _of_terms(others, index, [x for t in several.values() for x in t[1:]]).select("qid", "doc_id", "other", "tf")
            parts.append(_matched(there.join(F.broadcast(first), ["qid", "doc_id"])))
        else:
            parts.append(_matched(_with_postings(first.join(F.broadcast(others), "qid"), index, "term", "doc_id")))
    if not parts:
        return index.postings.limit(0).select(F.lit(0).cast("long").alias("qid"), "doc_id", F.array(F.struct(F.lit(0).cast("long").alias("df"), F.lit(0).alias("pos"), "term", "tf")).alias("postings"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def match(found: DataFrame, index: Index) -> DataFrame:
    """qid, doc_id and the term postings (df, pos, tf) of documents that have all terms of a query (relational division).

    A query becomes one row with its terms, the rarest first. The list of that one is read; what it has in common with the
    other lists is found where those lie, if the rarest lists of all queries, whose length the lexicon gives, are few
    enough for every task to hold. Otherwise, or in a batch of more than PLANNED_QUERIES, the documents of the rarest list
    are looked up in the others by term and document, which no hot term piles up.
    """
    by_query = found.groupBy("qid").agg(F.bool_or(F.col("df").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("df", "pos", "term"))).alias("terms"))
    live = by_query.filter(~F.col("missing")).select("qid", "terms")
    buckets = F.transform("terms", lambda t: term_bucket(t["term"], max(1, index.buckets)))
    few = live.withColumn("buckets", buckets).limit(PLANNED_QUERIES + 1).collect()
    if len(few) <= PLANNED_QUERIES:
        return _match_planned({r.qid: [_Term(*t, b) for t, b in zip(r.terms, r.buckets, strict=True)] for r in few}, index)
    live = live.select("qid", F.col("terms")[0].alias("rare"), F.expr("slice(terms, 2, size(terms))").alias("rest")).withColumn("term", F.col("rare.term"))
    first = _with_postings(live, index, "term").select("qid", "doc_id", F.struct("rare.df", "rare.pos", "rare.term", "tf").alias("one"), "rest")
    alone = first.filter(F.size("rest") == 0).select("qid", "doc_id", F.array("one").alias("postings"))
    asked = first.filter(F.size("rest") > 0).select("qid", "doc_id", "one", F.size("rest").alias("n_rest"), F.explode("rest").alias("other")).withColumn("term", F.col("other.term"))
    return alone.unionByName(_matched(_with_postings(asked, index, "term", "doc_id")))


def match_batch(queries: DataFrame, index: Index) -> DataFrame:
    """match() for queries (qid, raw). The driver analyzes a batch of up to PLANNED_QUERIES and asks the lexicon for its terms alone."""
    few = queries.select("qid", "raw").limit(PLANNED_QUERIES + 1).collect()
    terms = {r.qid: list(dict.fromkeys(index.analyzer.analyze(r.raw))) for r in few} if len(few) <= PLANNED_QUERIES else {}
    wanted = {t for ts in terms.values() for t in ts}
    if len(few) > PLANNED_QUERIES or len(wanted) > PLANNED_QUERIES:
        return match(lookup(query_terms(parse_queries(queries, index.analyzer)), index.lexicon), index)
    known = index.lexicon.filter(F.col("term").isin(*wanted)).select("term", "df", term_bucket(F.col("term"), max(1, index.buckets)).alias("b")).collect() if wanted else []
    df = {r.term: (r.df, r.b) for r in known}
    batch = {q: sorted((_Term(df[t][0], n, t, df[t][1]) for n, t in enumerate(ts)), key=lambda x: (x.df, x.pos)) for q, ts in terms.items() if ts and all(t in df for t in ts)}
    return _match_planned(batch, index)


def metrics(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """For each query that has terms: the postings in its lists, and whether it ended early because a term is missing."""
    by_query = found.groupBy("qid").agg(F.max(F.col("df").isNull()).alias("early_terminated"), F.sum("df").alias("total"))
    lists = F.when(F.col("early_terminated"), F.lit(0)).otherwise(F.coalesce("total", F.lit(0))).cast("long")
    joined = parsed.filter(F.size("terms") > 0).select("qid").join(by_query, "qid")
    return joined.select("qid", lists.alias("postings_in_lists"), "early_terminated")


def scored(matches: DataFrame, index: Index, scorer: Scorer) -> DataFrame:
    """qid, doc_id, score: contributions are added by ascending df and then place in the query, so sums never vary."""
    num_docs, avgdl = index.stats_row()
    lengths = matches.join(index.doc_index.select("doc_id", "length"), "doc_id")
    each = F.transform("postings", lambda p: scorer(p["tf"].cast("double"), p["df"].cast("double"), F.col("length").cast("double"), num_docs, avgdl))
    return lengths.select("qid", "doc_id", F.aggregate(each, F.lit(0.0), lambda a, x: a + x).alias("score"))


def top_k(candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    """qid, rank, doc_id, score: the k best by unrounded score, ties to the smaller doc_id."""
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, ranker: str | Scorer = "BM25", k: int = TOP_K) -> DataFrame:
    """qid, rank, doc_id, original_id, score for queries (qid, raw); ids are looked up for the k best only."""
    scorer = get_scorer(ranker) if isinstance(ranker, str) else ranker
    best = top_k(scored(match_batch(queries, index), index, scorer), k)
    return best.join(index.doc_index.select("doc_id", "original_id"), "doc_id").select("qid", "rank", "doc_id", "original_id", "score")


def results(queries: DataFrame, found: DataFrame) -> DataFrame:
    """qid, Query, Results for every query in the batch; scores are rounded to 4 places, queries without match have []."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "original_id", "score"))), lambda r: F.struct(r["original_id"].alias("ID"), F.round(r["score"], 4).alias("Score")))
    by_query = found.groupBy("qid").agg(listed.alias("Results"))
    empty = F.array().cast(by_query.schema["Results"].dataType)
    raw = F.trim(F.col("raw"), F.lit(" \t\r\n\x0b\x0c"))
    return queries.join(by_query, "qid", "left").select("qid", raw.alias("Query"), F.coalesce("Results", empty).alias("Results"))


def as_json(answered: DataFrame) -> DataFrame:
    """One JSON line a query, in the order of qid."""
    return answered.orderBy("qid").select(F.to_json(F.struct("Query", "Results")).alias("value"))
