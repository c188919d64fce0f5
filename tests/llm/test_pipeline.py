from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, mixing, queries
from tessera.llm.common import keep

from .helpers import awkward, docs_table, prose
from .test_neardup import brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(df[columns].astype(str).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_stages(spark):
    """Each stage against what it must do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, SF), f"test-{name}")
        kept[name] = (docs, out)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    before, after = map(rows, kept["language_id"])
    models = langid.train(kept["language_id"][0])
    assert sorted(after) == sorted(r for r, p in zip(before, models.predict([r[1] for r in before])) if not p[3])
    before, after = map(rows, kept["near_duplicates"])
    assert sorted(r[0] for r in after) == sorted({c for _, _, c in brute(before, 5)})
    before, after = kept["secret_scan"]
    assert before.count() == after.count()
    changed = after.alias("a").join(before.alias("b"), "doc_id").filter("a.text <> b.text")
    assert changed.filter(~F.col("a.text").contains("[secret]")).count() == 0 and after.filter("n_chars <> length(text)").count() == 0
    before, after = kept["source_mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in copies.items() if n}
    before, after = kept["best_fit_packing"]
    check(after.collect(), [(r[0], r[1]) for r in rows(before)])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_table(spark, extra):
    """Nulls in every column, repeated rows, clashing names: what each stage must do with them."""
    rows = awkward(random.Random(21)) + [(90 + i, f"{prose(random.Random(i), 30)}{' token=Zx81kPq02mQ77aLw' if i == 3 else ''}", "en", "a") for i in range(30)]
    table, count = docs_table(spark, rows, extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, keep(stage(spark, table, SF), "test-awkward")
        count[name] = (before.count(), table.count())
        if name != "best_fit_packing":
            assert table.columns == before.columns
            assert not extra or table.filter("`__row` <> 'x' OR `row` <> 'x'").count() == 0
        if name == "language_id":
            assert table.filter("text IS NULL OR text = ''").count() == 0
        if name == "near_duplicates":
            assert table.filter("text = 'same text here again and again'").count() == before.filter("text = 'same text here again and again'").select("text").distinct().count()
        if name == "secret_scan":
            assert table.filter("contains(text, '[secret]')").count() == table.filter("doc_id = 93").count() and table.filter("contains(text, 'Zx81')").count() == 0
    assert count["secret_scan"][0] == count["secret_scan"][1] and count["best_fit_packing"][1] >= count["best_fit_packing"][0] > 0


@pytest.mark.parametrize("extra", [False, True])
def test_empty_table(spark, extra):
    table = docs_table(spark, [], extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == table.columns)
