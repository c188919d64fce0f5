"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`index_build` writes a saved index with the full analyzer (tokens, stop words, stems). The searches run on it as a
batch; the others come from the catalogue and build what they need.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    shared = tempfile.mkdtemp(prefix="tessera-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.operators import search as se
    from tessera.plans import catalogue
    from tessera.session import ship
    from tessera.sources import index_store
    from tessera.sources.corpus import from_table
    from tessera.sources.query_file import query_table

    ship(spark)
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)

    path = f"file://{shared}/index"
    docs = from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    timed("index_build", lambda: index_store.save(docs, path, buckets=16))
    index = index_store.load(spark, path)
    queries = query_table(spark, catalogue.BATCH * 10)
    for ranker in ("BM25", "TFIDF"):
        timed(f"search_{ranker.lower()}_batch", lambda r=ranker: se.as_json(se.results(queries, se.search(index, queries, r))).collect())
    timed("search_one_query", lambda: se.search(index, query_table(spark, ["erth onth thon"])).collect())
    for name in ("postings", "lexicon", "corpus_stats", "bm25_top10"):
        timed(name, lambda n=name: catalogue.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "docs": docs.count(), "batch_queries": queries.count()}))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
