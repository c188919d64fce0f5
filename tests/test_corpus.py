from __future__ import annotations

import json

import pytest

from tessera.sources.corpus import contents, read_jsonl
from tessera.sources.query_file import query_table, read_queries

LINES = [
    json.dumps({"id": "a", "title": "T", "text": "body", "keywords": ["k1", "k 2"], "more": 1}), "", "not json", json.dumps({"title": "no id"}), json.dumps({"id": "only"}), json.dumps({"id": 42}),
    json.dumps([1]), json.dumps({"id": None}), json.dumps({"id": "", "text": None}), json.dumps({"id": "a", "keywords": "text"}), '{"id": "t"} trailing', json.dumps({"id": "f", "title": False, "text": 0, "keywords": [None, 1]}),
]


@pytest.fixture
def corpus_file(tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(tmp_path / "c.jsonl")


def test_jsonl(spark, corpus_file):
    found = read_jsonl(spark, corpus_file)
    rows = found.documents.orderBy("doc_id").collect()
    assert [(r.doc_id, r.original_id) for r in rows] == [(0, "a"), (1, "only"), (2, "42"), (3, ""), (4, "a"), (5, "f")]
    assert (rows[0].title, rows[0].text, rows[0].keywords) == ("T", "body", ["k1", "k 2"])
    assert (rows[1].title, rows[1].text, rows[1].keywords) == ("", "", [])
    assert rows[4].keywords == [] and rows[5].keywords == ["None", "1"] and rows[5].title == ""
    assert {(r.line_no, r.reason) for r in found.rejects.collect()} == {(3, "invalid JSON"), (4, "no id"), (7, "not an object"), (8, "no id"), (11, "invalid JSON")}
    assert found.counts() == (6, 5)
    assert [r.content for r in contents(found.documents).orderBy("doc_id").collect()][:2] == ["T body k1 k 2", ""]


@pytest.mark.parametrize(("most", "left"), [(None, 6), (0, 6), (2, 2), (-1, 0)])
def test_max_docs(spark, corpus_file, most, left):
    assert read_jsonl(spark, corpus_file, max_docs=most).documents.count() == left


def test_ids_follow_file_order_over_splits(spark, tmp_path):
    for name, start in (("b", 500), ("a", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" + ("bad\n" if i % 7 == 0 else "") for i in range(start, start + 500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        for native in (False, True):
            rows = read_jsonl(spark, str(tmp_path), native=native).documents.select("doc_id", "original_id").collect()
            assert sorted((r.doc_id, int(r.original_id)) for r in rows) == [(i, i) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_queries(spark, tmp_path):
    (tmp_path / "q.txt").write_text("  one  two \n\nthree\none  two\n", encoding="utf-8")
    assert [(r.qid, r.raw) for r in read_queries(spark, str(tmp_path / "q.txt")).orderBy("qid").collect()] == [(0, "one  two"), (1, "three"), (2, "one  two")]
    assert query_table(spark, ["", " "]).count() == 0
