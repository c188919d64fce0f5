"""Named queries over the driver's tables and the SQL that each must agree with.

Queries with SQL use the analyzer that SQL can express: runs of letters and digits, stop words, lengths, no stems.
Searches go the way that a user's do: an index is saved and opened again. JSONL queries write the documents as lines first.
Scores are ranked after rounding to nine places there, so that the last bit of a sum cannot change an order.
"""

from __future__ import annotations

import glob
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import SIMPLE, Analyzer
from ..functions.scoring import get_scorer
from ..operators import index as ix
from ..operators import search as se
from ..operators import galloping as ga
from ..session import scratch, spread
from ..sources import binary
from ..sources.corpus import Corpus, contents, first_docs, from_table, full_content, read_jsonl
from ..sources.index_store import get_df, read_postings, save
from ..sources.query_file import query_table, read_queries

#: Rare, common, stop-word, missing, empty after analysis and repeated terms.
BATCH = ["erth onth thon", "thre ther", "erre", "ment elle", "ung keit", "with from have", "zzznope thre", "the and a", "  thre thre ther  "]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.analyzed(_docs(spark, sf_dir), SIMPLE)


def _index(spark: SparkSession, sf_dir: str, analyzer: Analyzer = SIMPLE) -> ix.Index:
    return save(_docs(spark, sf_dir), scratch(spark, "index"), analyzer, buckets=16)


def _jsonl(spark: SparkSession, sf_dir: str) -> Corpus:
    """The documents written as JSON lines in the order of doc_id, with a line to reject or a blank one after some, and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("title"), "text", F.array("source").alias("keywords")))
    after = F.element_at(F.array(*map(F.lit, ("not json", "[1]", '{"title": "no id"}', ""))), (F.col("doc_id") % 50 + 1).cast("int"))
    lines = F.when(F.col("doc_id") % 50 < 4, F.array(record, after)).otherwise(F.array(record))
    path = scratch(spark, "lines")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(F.explode(lines).alias("value")).write.text(path)
    return read_jsonl(spark, path)


def _parsed(spark: SparkSession) -> DataFrame:
    return se.parse_queries(query_table(spark, BATCH), SIMPLE)


def _found(spark: SparkSession, index: ix.Index) -> DataFrame:
    return se.lookup(se.query_terms(_parsed(spark)), index.lexicon)


def _scored(spark: SparkSession, sf_dir: str, ranker: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return se.scored(se.match(_found(spark, index), index), index, get_scorer(ranker)).withColumn("score", F.round("score", 9))


def corpus_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("").alias("title"), F.array(F.col("source")).alias("keywords"))
    return docs.select("doc_id", full_content().alias("content"))


def tokenize(spark, sf_dir):
    tokens = SIMPLE.tokens(F.col("content"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tokens).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def normalize_filters(spark, sf_dir):
    return tokenize(spark, sf_dir).filter(SIMPLE.passes(F.col("token"))).select("doc_id", "pos", F.col("token").alias("term"))


def postings(spark, sf_dir):
    return ix.term_postings(_terms(spark, sf_dir))


def lexicon(spark, sf_dir):
    return ix.lexicon(postings(spark, sf_dir))


def doc_index(spark, sf_dir):
    return ix.doc_index(_terms(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return ix.corpus_stats(doc_index(spark, sf_dir)).select("num_docs", F.round("avgdl", 6).alias("avgdl"))


def index_statistics(spark, sf_dir):
    return ix.index_statistics(lexicon(spark, sf_dir))


def posting_lists(spark, sf_dir):
    shown = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), ",")
    return ix.posting_lists(postings(spark, sf_dir), chunk_docs=500).select("term", "chunk", "n", shown.alias("postings"))


def counters(spark, sf_dir):
    return ix.counters(postings(spark, sf_dir), _docs(spark, sf_dir))


def jsonl_corpus(spark, sf_dir):
    return contents(_jsonl(spark, sf_dir).documents)


def jsonl_rejects(spark, sf_dir):
    return _jsonl(spark, sf_dir).rejects.groupBy("reason").agg(F.count("*").alias("n"))


def _saved_lines(spark: SparkSession, sf_dir: str) -> ix.Index:
    """An index over JSON lines."""
    return save(contents(_jsonl(spark, sf_dir).documents), scratch(spark, "index"), SIMPLE, buckets=16)


def saved_lexicon(spark, sf_dir):
    return _saved_lines(spark, sf_dir).lexicon


def saved_doc_index(spark, sf_dir):
    return _saved_lines(spark, sf_dir).doc_index


def saved_statistics(spark, sf_dir):
    index = _saved_lines(spark, sf_dir)
    return ix.index_statistics(index.lexicon).select("number_of_lists", "average_list_size", F.lit(index.stats_row()[0]).cast("long").alias("num_docs"), F.lit(round(index.stats_row()[1], 6)).alias("avgdl"))


def partial_merge(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    return ix.merge_partials(*[ix.term_postings(terms.filter(F.col("doc_id") % 4 == block)) for block in range(4)])


def max_docs(spark, sf_dir):
    return first_docs(_docs(spark, sf_dir), 100).select("doc_id", "original_id")


def posting_lookup(spark, sf_dir):
    return read_postings(_index(spark, sf_dir), ["thre", "ther", "zzznope"])


def query_terms(spark, sf_dir):
    return se.query_terms(_parsed(spark)).select("qid", F.col("pos").cast("long").alias("pos"), "term", F.col("n_terms").cast("long").alias("n_terms"))


def term_lookup(spark, sf_dir):
    return get_df(_index(spark, sf_dir), query_terms(spark, sf_dir).select("qid", "term")).select("qid", "term", "df")


def missing_term(spark, sf_dir):
    found = _found(spark, _index(spark, sf_dir))
    return found.groupBy("qid").agg(F.max(F.col("df").isNull()).alias("missing"))


def conjunctive_match(spark, sf_dir):
    index = _index(spark, sf_dir)
    return se.match(_found(spark, index), index).select("qid", "doc_id", F.size("postings").cast("long").alias("n_terms"))


def match_metrics(spark, sf_dir):
    return se.metrics(_parsed(spark), _found(spark, _index(spark, sf_dir)))


def tfidf_scores(spark, sf_dir):
    return _scored(spark, sf_dir, "TFIDF").select("qid", "doc_id", F.round("score", 4).alias("score"))


def bm25_scores(spark, sf_dir):
    return _scored(spark, sf_dir, "BM25").select("qid", "doc_id", F.round("score", 4).alias("score"))


def _top10(spark, sf_dir, ranker):
    return se.top_k(_scored(spark, sf_dir, ranker), 10).select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def tfidf_top10(spark, sf_dir):
    return _top10(spark, sf_dir, "TFIDF")


def bm25_top10(spark, sf_dir):
    return _top10(spark, sf_dir, "BM25")


def search_json(spark, sf_dir):
    best = _top10(spark, sf_dir, "BM25").withColumn("original_id", F.col("doc_id").cast("string"))
    answered = se.results(query_table(spark, BATCH), best)
    return answered.select("qid", F.col("Query").alias("query"), F.size("Results").cast("long").alias("n_results"), F.array_join(F.transform("Results", lambda r: r["ID"]), ",").alias("ids"))


def search_lines(spark, sf_dir):
    """What the command line prints."""
    queries = query_table(spark, BATCH)
    return se.as_json(se.results(queries, se.search(_index(spark, sf_dir), queries, "BM25", 10)))


def query_file(spark, sf_dir):
    path = scratch(spark, "queries")
    lines = ["", "  erth onth  ", " ", "thre", "thre", "\tung keit\t"]
    spark.createDataFrame([(q,) for q in lines], "value string").coalesce(1).write.text(path)
    return read_queries(spark, path)


def binary_postings(spark, sf_dir):
    """Postings of two terms through files of the binary layout: sorted runs, merged to one posting file, read by offset."""
    found = read_postings(_index(spark, sf_dir), ["thre", "ther"]).collect()  # a few hundred
    with tempfile.TemporaryDirectory() as folder:
        for block in range(3):
            lists: dict[str, list] = {}
            for r in found[block::3]:
                lists.setdefault(r.term, []).append((r.doc_id, r.tf))
            if lists:
                binary.write_run(f"{folder}/{block}.run", lists)
        merged: dict[str, list] = {}
        for run in sorted(glob.glob(f"{folder}/*.run")):
            for term, pairs in binary.read_run(run):
                merged.setdefault(term, []).extend(map(tuple, pairs.tolist()))
        lexicon = binary.write_postings(f"{folder}/all.bin", [(t, sorted(merged[t])) for t in sorted(merged)])
        rows = [(t, d, f) for t, (at, n) in lexicon.items() for d, f in binary.read_postings(f"{folder}/all.bin", at, n).tolist()]
    return spark.createDataFrame(rows, "term string, doc_id long, tf long")


def stemmed_search(spark, sf_dir):
    return se.as_json(se.results(query_table(spark, BATCH), se.search(_index(spark, sf_dir, Analyzer()), query_table(spark, BATCH))))


def galloping_metrics(spark, sf_dir):
    return ga.galloping_metrics(_index(spark, sf_dir), query_table(spark, BATCH))


def run_averages(spark, sf_dir):
    return ga.run_averages(galloping_metrics(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan, tokenize, normalize_filters, postings, lexicon, doc_index, corpus_stats, index_statistics, posting_lists, partial_merge, max_docs, posting_lookup, query_terms,
        term_lookup, missing_term, conjunctive_match, match_metrics, tfidf_scores, bm25_scores, tfidf_top10, bm25_top10, search_json, stemmed_search,
        counters, jsonl_corpus, jsonl_rejects, saved_lexicon, saved_doc_index, saved_statistics, galloping_metrics, run_averages, search_lines, query_file, binary_postings,
    )
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOP = _quoted(SIMPLE.stop_words)
_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda t: regexp_matches(t, '[a-z0-9]'))"
_PASSES = f"length(t) BETWEEN 2 AND 40 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_STOP})"
_CTE = f"""
WITH tokens AS (
  SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS l FROM documents)
), terms AS (
  SELECT doc_id, pos::BIGINT AS pos, t AS term FROM tokens WHERE {_PASSES}
), postings AS (
  SELECT term, doc_id, count(*)::BIGINT AS tf FROM terms GROUP BY term, doc_id
), lexicon AS (
  SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term
), doc_index AS (
  SELECT d.doc_id, d.doc_id::VARCHAR AS original_id, coalesce(n, 0)::BIGINT AS length
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id) USING (doc_id)
), stats AS (
  SELECT count(*)::BIGINT AS num_docs, coalesce(avg(length), 0.0::DOUBLE) AS avgdl FROM doc_index
), queries(qid, raw) AS (
  VALUES {", ".join(f"({i}::BIGINT, '{q.strip()}')" for i, q in enumerate(BATCH))}
), qtokens AS (
  SELECT qid, unnest(l) AS t, generate_subscripts(l, 1) AS place FROM (SELECT qid, {_TOKENS.format("raw")} AS l FROM queries)
), qfirst AS (
  SELECT qid, t AS term, min(place) AS place FROM qtokens WHERE {_PASSES} GROUP BY qid, t
), qterms AS (
  SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS pos, count(*) OVER (PARTITION BY qid) AS n_terms FROM qfirst
), matches AS (
  SELECT qid, doc_id, any_value(n_terms)::BIGINT AS n_terms FROM qterms JOIN postings USING (term) GROUP BY qid, doc_id HAVING count(*) = any_value(n_terms)
), each_term AS (
  SELECT qid, doc_id, pos, tf::DOUBLE AS tf, df::DOUBLE AS df, length::DOUBLE AS length, num_docs::DOUBLE AS n, avgdl
  FROM matches JOIN qterms USING (qid) JOIN postings USING (term, doc_id) JOIN lexicon USING (term) JOIN doc_index USING (doc_id) CROSS JOIN stats
), tfidf AS (
  SELECT qid, doc_id, round(sum((1.0::DOUBLE + ln(tf)) * ln(n / df) ORDER BY df, pos), 9) AS score FROM each_term GROUP BY qid, doc_id
), bm25 AS (
  SELECT qid, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.2::DOUBLE)
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / avgdl))) ORDER BY df, pos), 9) AS score FROM each_term GROUP BY qid, doc_id
), top AS (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM bm25
)
"""
_JSONL = """
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, doc_id::VARCHAR AS original_id,
         concat_ws(' ', nullif(lang, ''), nullif(text, ''), coalesce(source, 'None')) AS content FROM documents
)
"""
_JSONL_INDEX = _JSONL + _CTE.replace("\nWITH tokens", ", tokens").replace("text, ''", "content, ''").replace("FROM documents", "FROM docs")
#: The places that a skipping intersection looks at, after the definition in operators/galloping.py.
_SCANNED = f"""{_CTE.replace("WITH", "WITH RECURSIVE", 1)}, early AS (
  SELECT qid, bool_or(df IS NULL) AS early_terminated FROM qterms LEFT JOIN lexicon USING (term) GROUP BY qid
), lists AS (
  SELECT qid, pos, doc_id AS id, row_number() OVER (PARTITION BY qid, pos ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY qid, pos) AS n
  FROM qterms JOIN early USING (qid) JOIN postings USING (term) WHERE NOT early_terminated
), next_of AS (
  SELECT qid, u, pos, coalesce(min(id) FILTER (WHERE id >= u), {2**62}) AS here, coalesce(min(id) FILTER (WHERE id > u), {2**62}) AS beyond
  FROM (SELECT DISTINCT qid, id AS u FROM lists) JOIN lists USING (qid) GROUP BY qid, u, pos
), follows AS (
  SELECT qid, u, max(here) = u AS common, CASE WHEN max(here) = u THEN max(beyond) ELSE max(here) END AS after FROM next_of GROUP BY qid, u
), chain AS (
  SELECT qid, max(id) AS aim, 0 AS i FROM lists WHERE place = 0 GROUP BY qid
  UNION ALL SELECT chain.qid, after, i + 1 FROM chain JOIN follows ON follows.qid = chain.qid AND u = aim WHERE after < {2**62}
), goals AS (
  SELECT qid, pos, i, any_value(n) AS n, any_value(common) AS common, count(*) FILTER (WHERE id < aim) AS goal
  FROM chain JOIN lists USING (qid) JOIN follows USING (qid) WHERE u = aim GROUP BY qid, pos, i
), moves AS (
  SELECT *, coalesce(lag(goal + common::BIGINT) OVER (PARTITION BY qid, pos ORDER BY i), 0) AS start FROM goals
), steps AS (
  SELECT *, length(bin(goal - start)) - 1 AS k, least(start + (2::BIGINT << (length(bin(goal - start)) - 1)) - 1, n - 1) AS top FROM moves WHERE goal > start
), halving AS (
  SELECT qid, pos, goal, start + (1::BIGINT << k) AS low, top AS high FROM steps WHERE goal < n
  UNION ALL SELECT qid, pos, goal, CASE WHEN (low + high) // 2 < goal THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN (low + high) // 2 < goal THEN high ELSE (low + high) // 2 END FROM halving WHERE low < high
), seen AS (
  SELECT qid, pos, 0 AS place FROM lists UNION SELECT qid, pos, start + (1::BIGINT << unnest(range(1, k + 1))) - 1 FROM steps UNION SELECT qid, pos, top FROM steps
  UNION SELECT qid, pos, (low + high) // 2 FROM halving WHERE low < high UNION SELECT qid, pos, goal FROM steps WHERE goal < n UNION SELECT qid, pos, goal + 1 FROM goals WHERE common AND goal + 1 < n
), metrics AS (
  SELECT qid, coalesce(total, 0)::BIGINT AS postings_in_lists, coalesce(places, 0)::BIGINT AS postings_scanned, early_terminated,
         CASE WHEN coalesce(total, 0) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - places::DOUBLE / total::DOUBLE END AS skip_ratio
  FROM early LEFT JOIN (SELECT qid, count(*) AS places FROM seen GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS total FROM lists GROUP BY qid) USING (qid)
)
"""
_TOP10 = "SELECT qid, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {}) WHERE rank <= 10"

ORACLE_SQL = {
    "corpus_scan": "SELECT doc_id, concat_ws(' ', nullif(coalesce(text, ''), ''), source) AS content FROM documents",
    "tokenize": _CTE + "SELECT doc_id, pos::BIGINT AS pos, t AS token FROM tokens",
    "normalize_filters": _CTE + "SELECT doc_id, pos, term FROM terms",
    "postings": _CTE + "SELECT term, doc_id, tf FROM postings",
    "lexicon": _CTE + "SELECT term, df FROM lexicon",
    "doc_index": _CTE + "SELECT doc_id, original_id, length FROM doc_index",
    "corpus_stats": _CTE + "SELECT num_docs, round(avgdl, 6) AS avgdl FROM stats",
    "index_statistics": _CTE + "SELECT count(*)::BIGINT AS number_of_lists, coalesce(round(sum(df)::DOUBLE / count(*), 2), 0.0::DOUBLE) AS average_list_size FROM lexicon",
    "posting_lists": _CTE + "SELECT term, (doc_id // 500)::BIGINT AS chunk, count(*)::BIGINT AS n, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM postings GROUP BY term, chunk",
    "counters": _CTE + "SELECT (SELECT count(*) FROM documents)::BIGINT AS num_docs, count(DISTINCT term)::BIGINT AS num_terms, count(*)::BIGINT AS num_postings, count(*) = 0 AS is_empty FROM postings",
    "jsonl_corpus": _JSONL + "SELECT doc_id::BIGINT AS doc_id, original_id, content FROM docs",
    "jsonl_rejects": "SELECT CASE doc_id % 50 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object' ELSE 'no id' END AS reason, count(*)::BIGINT AS n FROM documents WHERE doc_id % 50 < 3 GROUP BY reason",
    "saved_statistics": _JSONL_INDEX + "SELECT count(*)::BIGINT AS number_of_lists, coalesce(round(sum(df)::DOUBLE / count(*), 2), 0.0::DOUBLE) AS average_list_size, any_value(num_docs) AS num_docs, any_value(round(avgdl, 6)) AS avgdl FROM lexicon CROSS JOIN stats",
    "saved_lexicon": _JSONL_INDEX + "SELECT term, df FROM lexicon",
    "saved_doc_index": _JSONL_INDEX + "SELECT doc_id, original_id, length FROM (SELECT doc_id::BIGINT AS doc_id, d.original_id, i.length FROM doc_index i JOIN docs d USING (doc_id))",
    "query_file": "SELECT * FROM (VALUES (0::BIGINT, 'erth onth'), (1::BIGINT, 'thre'), (2::BIGINT, 'thre'), (3::BIGINT, 'ung keit')) t(qid, raw)",
    "binary_postings": _CTE + "SELECT term, doc_id, tf FROM postings WHERE term IN ('thre', 'ther')",
    "search_lines": _CTE + """SELECT '{"Query":"' || raw || '","Results":[' || coalesce(string_agg('{"ID":"' || doc_id || '","Score":' || round(score, 4)::VARCHAR || '}', ',' ORDER BY rank), '') || ']}' AS value
        FROM queries q LEFT JOIN (SELECT * FROM top WHERE rank <= 10) t ON q.qid = t.qid GROUP BY q.qid, raw""",
    "galloping_metrics": _SCANNED + "SELECT * FROM metrics",
    "run_averages": _SCANNED + """SELECT count(*)::BIGINT AS num_queries, (count(*) FILTER (WHERE early_terminated))::BIGINT AS num_early, coalesce(round(avg(skip_ratio), 6), 0.0::DOUBLE) AS mean_skip_ratio,
        coalesce(round(min(skip_ratio), 6), 0.0::DOUBLE) AS min_skip_ratio, coalesce(round(max(skip_ratio), 6), 0.0::DOUBLE) AS max_skip_ratio FROM metrics""",
    "partial_merge": _CTE + "SELECT term, doc_id, tf FROM postings",
    "max_docs": "SELECT doc_id, doc_id::VARCHAR AS original_id FROM documents WHERE doc_id < 100",
    "posting_lookup": _CTE + "SELECT term, doc_id, tf FROM postings WHERE term IN ('thre', 'ther', 'zzznope')",
    "query_terms": _CTE + "SELECT qid, pos::BIGINT AS pos, term, n_terms::BIGINT AS n_terms FROM qterms",
    "term_lookup": _CTE + "SELECT qid, term, coalesce(df, 0)::BIGINT AS df FROM qterms LEFT JOIN lexicon USING (term)",
    "missing_term": _CTE + "SELECT qid, bool_or(df IS NULL) AS missing FROM qterms LEFT JOIN lexicon USING (term) GROUP BY qid",
    "conjunctive_match": _CTE + "SELECT qid, doc_id, n_terms FROM matches",
    "match_metrics": _CTE + "SELECT qid, (CASE WHEN bool_or(df IS NULL) THEN 0 ELSE sum(df) END)::BIGINT AS postings_in_lists, bool_or(df IS NULL) AS early_terminated FROM qterms LEFT JOIN lexicon USING (term) GROUP BY qid",
    "tfidf_scores": _CTE + "SELECT qid, doc_id, round(score, 4) AS score FROM tfidf",
    "bm25_scores": _CTE + "SELECT qid, doc_id, round(score, 4) AS score FROM bm25",
    "tfidf_top10": _CTE + _TOP10.format("tfidf"),
    "bm25_top10": _CTE + _TOP10.format("bm25"),
    "search_json": _CTE + "SELECT q.qid, raw AS query, count(rank)::BIGINT AS n_results, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank), '') AS ids FROM queries q LEFT JOIN (SELECT * FROM top WHERE rank <= 10) t ON q.qid = t.qid GROUP BY q.qid, raw",
}
