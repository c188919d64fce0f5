from __future__ import annotations

import io
import time

import pytest

from tessera import session


def test_memory_monitor(spark):
    for bad in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            session.MemoryMonitor(bad)
    roomy, tight = session.MemoryMonitor(10**6, spark), session.MemoryMonitor(1)
    assert 0 < roomy.used_mb() <= roomy.peak_mb and not roomy.should_flush() and tight.should_flush() and roomy.used_ratio() < 1 < tight.used_ratio()
    roomy.reset_peak()
    assert roomy.peak_mb == 0.0
    assert all(0 < used <= total for used, total in session.memory_status(spark).values())


def test_progress(spark):
    out = io.StringIO()
    with session.progress(spark, 0.05, out):
        spark.sparkContext.parallelize(range(4), 4).foreach(lambda _: time.sleep(0.6))
    assert "of 4" in out.getvalue()


def test_shared_dir(spark):
    kept = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch(spark, "x").startswith(f"{kept}/tessera/x-")
    assert session.keep(spark.range(3), "three").count() == 3

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_spread(spark):
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10, numPartitions=9)).rdd.getNumPartitions() == 9


def test_small_table(spark):
    rows = [(1, "it's :p0_1 \\ \n", 2), (2**40, "é😀", -3)]
    for many in (1, 600):
        found = session.small_table(spark, rows * many, "a long, b string, c int")
        assert found.dtypes == [("a", "bigint"), ("b", "string"), ("c", "int")] and sorted(map(tuple, found.collect())) == sorted(rows * many)
    assert session.small_table(spark, [], "a long, b string").count() == 0
