"""Getting the package to the executors, the folder that all share, and what a run reports of itself."""

from __future__ import annotations

import os
import sys
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session's application, once; they need no PYTHONPATH of their own."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, f"{package.name}/{file.relative_to(package)}")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset a local run gets a folder of its own; a cluster has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows of numbers and strings as a table. Few rows become constants of the plan, which no job has to fetch."""
    if not 0 < len(rows) <= 1000:
        return spark.createDataFrame(rows, schema).coalesce(1)
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    texts = {f"p{n}_{i}": v for n, row in enumerate(rows) for i, v in enumerate(row) if kinds[i] == "string"}
    value = lambda n, i, v: f":p{n}_{i}" if kinds[i] == "string" else f"CAST({int(v)} AS {kinds[i]})"
    lines = ", ".join("(" + ", ".join(value(n, i, v) for i, v in enumerate(row)) + ")" for n, row in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(names)})", args=texts)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session runs tasks: a table of one small file would be read by one task."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df._jdf.queryExecution().toRdd().getNumPartitions() < tasks else df


class MemoryMonitor:
    """Memory of this process and storage memory of the executors against a budget; when to spill is the engine's business."""

    FLUSH = 0.75

    def __init__(self, budget_mb: float, spark: SparkSession | None = None):
        if budget_mb <= 0:
            raise ValueError(f"the budget must be positive, not {budget_mb} MB")
        self.budget_mb, self.spark, self.peak_mb = float(budget_mb), spark, 0.0

    def used_mb(self) -> float:
        """Megabytes in use now: of the Python driver, its JVM and the executors' storage."""
        pages = int(Path("/proc/self/statm").read_text().split()[1]) if os.path.exists("/proc/self/statm") else 0
        used = pages * os.sysconf("SC_PAGE_SIZE") if pages else 0
        if self.spark:
            runtime = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
            used += runtime.totalMemory() - runtime.freeMemory() + sum(u for u, _ in memory_status(self.spark).values())
        self.peak_mb = max(self.peak_mb, used / 1024**2)
        return used / 1024**2

    def used_ratio(self) -> float:
        return self.used_mb() / self.budget_mb

    def should_flush(self) -> bool:
        return self.used_ratio() >= self.FLUSH

    def reset_peak(self) -> None:
        self.peak_mb = 0.0


def memory_status(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """Bytes of storage memory in use (at least 1) and in all, by executor."""
    found = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    pairs = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)
    return {str(k): (max(1, int(v._1()) - int(v._2())), int(v._1())) for k, v in dict(pairs).items()}


@contextmanager
def progress(spark: SparkSession, every: float = 10.0, out=None) -> Iterator[None]:
    """While it lasts, a line every so many seconds for each running stage: tasks done, running and in all."""
    done, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def report() -> None:
        while not done.wait(every):
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    print(f"stage {stage}: {info.numCompletedTasks} done, {info.numActiveTasks} running of {info.numTasks}", file=out or sys.stderr, flush=True)

    thread = threading.Thread(target=report, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
