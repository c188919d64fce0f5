from __future__ import annotations

import json
import math
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.analyzer import SIMPLE, Analyzer
from tessera.functions.scoring import get_scorer
from tessera.operators import index as ix
from tessera.operators import search as se
from tessera.operators.galloping import galloping_metrics, probes, run_averages, scanned
from tessera.plans import catalogue
from tessera.sources import index_store
from tessera.sources.query_file import query_table

TEXTS = {
    "DOC_A": "Albert Einstein famous physicist relativity", "DOC_B": "Isaac Newton gravity laws", "DOC_C": "Python programming language code",
    "DOC_D": "Marie Curie physicist radium", "DOC_E": "Einstein Einstein university medal prize",
}


@pytest.fixture(scope="module")
def five(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(TEXTS.items())], "doc_id long, original_id string, content string")
    return index_store.save(docs, str(tmp_path_factory.mktemp("five")), buckets=4), docs


def answers(spark, index, queries, ranker="BM25", k=10):
    table = query_table(spark, queries)
    lines = se.as_json(se.results(table, se.search(index, table, ranker, k))).collect()
    return [json.loads(r.value) for r in lines]


def test_five_documents(spark, five):
    index, _ = five
    found = answers(spark, index, ["physicist", "albert einstein", "einstein", "python newton", "xyzzyx", "the and", "  Physicists  physicist "])
    assert [[r["ID"] for r in q["Results"]] for q in found] == [["DOC_D", "DOC_A"], ["DOC_A"], ["DOC_E", "DOC_A"], [], [], [], ["DOC_D", "DOC_A"]]
    assert [r["Score"] for r in found[0]["Results"]] == [0.9093, 0.8292] and found[1]["Results"][0]["Score"] == 2.1423 and found[6]["Query"] == "Physicists  physicist"
    tfidf = answers(spark, index, ["physicist", "einstein"], " tfidf ")
    assert [(r["ID"], r["Score"]) for r in tfidf[0]["Results"]] == [("DOC_A", 0.9163), ("DOC_D", 0.9163)]
    assert [(r["ID"], r["Score"]) for r in tfidf[1]["Results"]] == [("DOC_E", 1.5514), ("DOC_A", 0.9163)]
    assert index.stats_row() == (5, 4.4)
    with pytest.raises(ValueError, match="ranker"):
        get_scorer("other")
    with pytest.raises(ValueError, match="positive"):
        se.top_k(index.doc_index, 0)


def test_metrics(spark, five):
    index, _ = five
    table = query_table(spark, ["physicist", "albert einstein", "einstein missing", "the"])
    parsed = se.parse_queries(table, index.analyzer)
    rows = {r.qid: r for r in se.metrics(parsed, se.lookup(se.query_terms(parsed), index.lexicon)).collect()}
    assert {q: (r.postings_in_lists, r.early_terminated) for q, r in rows.items()} == {0: (2, False), 1: (3, False), 2: (0, True)}
    found = {r.qid: r for r in galloping_metrics(index, table).collect()}
    assert found[0].postings_scanned == 2 and found[2].skip_ratio == 0.0 and found[2].early_terminated


def test_probes():
    assert 500 in probes(0, 500, 1000) and len(set(probes(0, 500, 1000))) < 50
    assert list(probes(7, 7, 10)) == [] and list(probes(3, 4, 10)) == [4, 4]
    assert max(probes(0, 10, 10)) == 9 and scanned([]) == ([], 0) and scanned([[], [1]]) == ([], 1)


def test_run_averages(spark):
    rows = [(0, 10, 5, False, 0.5), (1, 0, 0, True, 0.0)]
    found = run_averages(spark.createDataFrame(rows, "qid long, postings_in_lists long, postings_scanned long, early_terminated boolean, skip_ratio double")).first()
    assert tuple(found) == (2, 1, 0.25, 0.0, 0.5)


@given(st.lists(st.lists(st.integers(0, 60), max_size=40, unique=True).map(sorted), min_size=1, max_size=4))
def test_galloping_finds_the_intersection(lists):
    common, seen = scanned(lists)
    assert common == sorted(set.intersection(*map(set, lists))) and seen <= sum(map(len, lists))


def test_store(spark, five):
    index, _ = five
    again = [(r.term, r.doc_id, r.tf) for r in index_store.read_postings(index, ["einstein", "none"]).collect()]
    assert again == [("einstein", 0, 1), ("einstein", 4, 2)]
    assert index_store.check_integrity(index).count() == 0
    assert {(r.term, r.df) for r in index_store.get_df(index, spark.createDataFrame([("einstein",), ("none",)], "term string")).collect()} == {("einstein", 2), ("none", 0)}
    assert "PartitionFilters: [isnotnull(term_bucket" in index_store.read_postings(index, ["einstein"])._jdf.queryExecution().toString()


def test_statistics(spark, five, tmp_path):
    index, docs = five
    index_store.save(docs, str(tmp_path), buckets=2)
    row = index_store.statistics(spark, str(tmp_path)).first()
    assert row.number_of_lists == index.lexicon.count() and row.index_size_mb > 0 and row.average_list_size == round(index.postings.count() / row.number_of_lists, 2)


def test_empty_and_zero_length(spark):
    none = ix.build(spark.createDataFrame([], "doc_id long, original_id string, content string"), SIMPLE)
    assert none.stats_row() == (0, 0.0) and ix.index_statistics(none.lexicon).first().average_list_size == 0.0
    assert answers(spark, none, ["word"]) == [{"Query": "word", "Results": []}]
    some = ix.build(spark.createDataFrame([(0, "0", "word word"), (1, "1", ""), (2, "2", "the")], "doc_id long, original_id string, content string"), SIMPLE)
    assert some.stats_row() == (3, pytest.approx(2 / 3))


def test_term_in_all_documents(spark):
    docs = spark.createDataFrame([(i, str(i), f"Doc{i} alpha physics beta gamma {i} kw{i % 10}") for i in range(60)], "doc_id long, original_id string, content string")
    index = ix.build(docs, Analyzer())
    assert index.lexicon.filter("term = 'physic'").first().df == 60 and index.lexicon.filter("term = '7'").count() == 0
    found = answers(spark, index, ["physics"], "TFIDF")[0]["Results"]
    assert [r["ID"] for r in found] == [str(i) for i in range(10)] and {r["Score"] for r in found} == {0.0}


def test_merge_partials(spark):
    make = lambda rows: spark.createDataFrame(rows, "term string, doc_id long, tf long")
    merged = ix.merge_partials(make([("x", 0, 1), ("x", 2, 1)]), make([("x", 5, 1), ("x", 8, 1), ("x", 2, 3)]), make([("y", 1, 1)]))
    assert {(r.term, r.doc_id, r.tf) for r in merged.collect()} == {("x", 0, 1), ("x", 2, 4), ("x", 5, 1), ("x", 8, 1), ("y", 1, 1)}
    lists = {(r.term, r.chunk): [(p.doc_id, p.tf) for p in r.postings] for r in ix.posting_lists(merged, chunk_docs=5).collect()}
    assert lists == {("x", 0): [(0, 1), (2, 4)], ("x", 1): [(5, 1), (8, 1)], ("y", 0): [(1, 1)]}
    assert {r.n for r in ix.posting_lists(merged).filter("term = 'x'").collect()} == {4}


def test_damaged_list(spark, tmp_path):
    """A list whose length is not its df fails, also where all of it is gone."""
    docs = spark.createDataFrame([(i, str(i), "alpha beta" if i else "alpha gamma") for i in range(4)], "doc_id long, original_id string, content string")
    index = index_store.save(docs, str(tmp_path), SIMPLE, buckets=4)
    assert index_store.read_postings(index, ["alpha", "beta", "none"]).count() == 7
    for lost in ("term <> 'gamma'", "NOT (term = 'alpha' AND doc_id = 2)"):
        broken = replace(index, postings=index.postings.filter(lost))
        with pytest.raises(Exception, match="the lexicon says"):
            index_store.read_postings(broken, ["alpha", "beta", "gamma"]).collect()
    index_store.close(index)
    assert index_store.load(spark, str(tmp_path)).stats_row() == (4, 2.0)


def test_stemmed_search(spark):
    """The default analyzer over a saved index, against the definition over all documents."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = [json.loads(r.value) for r in catalogue.stemmed_search(spark, sf).collect()]
    for query, answer in zip([q.strip() for q in catalogue.BATCH], got, strict=True):
        assert answer["Query"] == query
        assert [(int(r["ID"]), r["Score"]) for r in answer["Results"]] == [(d, pytest.approx(s, abs=1e-4)) for d, s in brute(texts, query, "BM25", Analyzer())]


@pytest.mark.parametrize(("planned", "held"), [(10_000, 200_000), (10_000, 0), (0, 0)])
def test_rare_with_common(spark, tmp_path, monkeypatch, planned, held):
    """All ways of matching agree."""
    monkeypatch.setattr(se, "PLANNED_QUERIES", planned)
    monkeypatch.setattr(se, "HELD_POSTINGS", held)
    docs = spark.createDataFrame([(i, str(i), "common rare" if i % 500 == 3 else "common") for i in range(2000)], "doc_id long, original_id string, content string")
    index = index_store.save(docs, str(tmp_path), SIMPLE, buckets=2)
    found = se.match(se.lookup(se.query_terms(se.parse_queries(query_table(spark, ["common rare", "common"]), SIMPLE)), index.lexicon), index)
    assert sorted(r.doc_id for r in found.filter("qid = 0").collect()) == [3, 503, 1003, 1503] and found.filter("qid = 1").count() == 2000


def test_top_k(spark):
    rows = [(0, d, s) for d, s in [(5, 1.0), (3, 2.0), (9, 2.0), (1, -1.0), (7, 2.0)]]
    found = se.top_k(spark.createDataFrame(rows, "qid long, doc_id long, score double"), 3).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in found] == [(1, 3), (2, 7), (3, 9)]
    assert se.top_k(spark.createDataFrame(rows, "qid long, doc_id long, score double"), 99).count() == 5


def brute(docs, query, ranker, analyzer=SIMPLE):
    terms = list(dict.fromkeys(analyzer.analyze(query)))
    analyzed = {d: analyzer.analyze(t) for d, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, analyzed.values())) / len(docs)
    df = {t: sum(t in a for a in analyzed.values()) for t in terms}
    out = []
    for d, a in analyzed.items():
        if terms and all(t in a for t in terms):
            score = 0.0
            for t in sorted(terms, key=df.get):
                tf = a.count(t)
                score += (1 + math.log(tf)) * math.log(n / df[t]) if ranker == "TFIDF" else math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(a) / avgdl))
            out.append((d, score))
    return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:10]


@pytest.mark.parametrize("ranker", ["TFIDF", "BM25"])
def test_against_brute_force(spark, ranker):
    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefghij"]
    docs = {i: " ".join(rng.choices(words, weights=range(1, 11), k=rng.randint(0, 30))) for i in range(80)}
    queries = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(12)]
    index = ix.build(spark.createDataFrame([(i, str(i), t) for i, t in docs.items()], "doc_id long, original_id string, content string"), SIMPLE)
    for query, answer in zip(queries, answers(spark, index, queries, ranker), strict=True):
        assert [(int(r["ID"]), r["Score"]) for r in answer["Results"]] == [(d, pytest.approx(s, abs=1e-4)) for d, s in brute(docs, query, ranker)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["aa", "bb", "cc", "the", "7"]), max_size=8), min_size=1, max_size=6))
def test_invariants(spark, texts):
    docs = spark.createDataFrame([(i, str(i), " ".join(t)) for i, t in enumerate(texts)], "doc_id long, original_id string, content string")
    index = ix.build(docs, SIMPLE)
    sums = {r.doc_id: r.n for r in index.postings.groupBy("doc_id").agg({"tf": "sum"}).withColumnRenamed("sum(tf)", "n").collect()}
    assert {r.doc_id: r.length for r in index.doc_index.collect()} == {i: sums.get(i, 0) for i in range(len(texts))}
    assert all(r.df <= len(texts) for r in index.lexicon.collect())
