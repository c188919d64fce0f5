"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target words / words of the source. Documents are
put in one order per source, expected copies are added up along it from one random offset, and a document is emitted
once for each integer that its step crosses. As expected copies are equal within a source, the prefix sum up to its kth
document is k times that number. The order is by size, so that the words taken differ from the target by less than about
one document.

Documents, and sources too, are sorted by ranges; places come from each partition's own numbering and the totals of the
partitions before it. No task holds a source, or all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Sorts as the source by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def _running(rows: DataFrame, order: list[str], name: str, **sums: str) -> DataFrame:
    """rows with the sum of a column over all rows before each in the given order. Sorted by ranges: what one task adds up is a partition, or one number a partition."""
    held = keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    totals = held.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("part_of"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(before, F.col("part") == F.col("part_of"))
    return placed.select(*rows.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{n}_before")).alias(n) for n, c in sums.items()])


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (skey, words) with its target: weights repeat in the order of skey; a target stops at most * words and the
    excess is dealt out again by weight.

    Sources are filled up in the order of words a weight. With `filled` and `spent` the words and weights of those before
    it, a source finds the level (share * total - filled) / (weights left); the highest level is what the others get.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = _running(sources.withColumn("one", F.lit(1).cast("long")), ["skey"], "mix-sources", place="one")
    ranked = ranked.withColumn("weight", weight).withColumn("top", F.lit(most) * F.col("words")).withColumn("full_at", F.col("top") / F.col("weight"))
    filled = keep(_running(ranked.drop("one", "place"), ["full_at", "skey"], "mix-filling", filled="top", spent="weight"), "mix-levels")
    total, weight_of_all = filled.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(share) * F.lit(float(total)) - F.col("filled")) / (F.lit(weight_of_all) - F.col("spent"))
    highest = filled.agg(F.max(level)).first()[0] or 0.0
    return filled.select("skey", "words", F.least(F.col("top"), F.lit(highest) * F.col("weight")).alias("target"))


def offset(skey: Column, seed: str = SEED) -> Column:
    """The one random offset of a source, in [0, 1): 32 bits of a digest of seed and source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), skey)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _crossed(tagged: DataFrame, weights: tuple, share: float, most: float, seed: str) -> DataFrame:
    """tagged (skey, size, doc_id and more) with words and target of its source and copies.

    Rows are written in order with their numbers. From then on a partition's part of a source is one row: where it begins,
    and how many rows of the source lie before it.
    """
    order = ["skey", "size", "doc_id"]
    held = keep(tagged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "mix-sorted")
    held = held.withColumn("part", F.shiftright("pos", 33))
    runs = keep(held.groupBy("part", "skey").agg(F.min("pos").alias("first"), F.count("*").alias("rows"), F.sum("size").alias("part_words")), "mix-runs")
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goals = targets(runs.groupBy("skey").agg(F.sum("part_words").alias("words")), weights, share, most)
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    goals = goals.withColumn("rate", rate).withColumn("u", offset(F.col("skey"), seed))
    runs = keep(runs.select("part", "skey", (F.col("first") - before).alias("origin")).join(goals, "skey"), "mix-places")
    k = (F.col("pos") - F.col("origin") + 1).cast("double")
    crossed = F.floor(k * F.col("rate") + F.col("u")) - F.floor((k - 1.0) * F.col("rate") + F.col("u"))
    return held.join(runs, ["part", "skey"]).withColumn("copies", F.least(crossed, F.lit(int(-(-most // 1)))).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, skey, size, source_size, target, copies (0 to ceil(most)) for each row of docs (doc_id, source, text).

    Null text has size 0; null source is a source of its own, last; a source without words has target 0 and no copies;
    an empty table gives an empty result. Rows with equal source, size and doc_id are interchangeable. Other columns are
    not read. Sizes are taken once, before rows without texts are sorted.
    """
    slim = keep(docs.select("doc_id", _key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size")), "mix-sizes")
    return _crossed(slim, weights, share, most, seed).select("doc_id", "skey", "size", F.col("words").alias("source_size"), "target", "copies")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that agree in doc_id, source and size may swap copies.

    Nulls, empty tables and repeated rows are as in mix(); columns of any name are kept, as a row travels in one column.
    Texts are sorted into their places once and don't move again.
    """
    tagged = docs.select(F.struct("*").alias("__doc"), _key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), F.col("doc_id"))
    taken = _crossed(tagged, weights, share, most, seed).filter("copies > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT skey, sum(size)::BIGINT AS words FROM d GROUP BY skey
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * words AS top, sum(words) OVER () AS total
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(top) OVER (ORDER BY top / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY top / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT skey, words, least(top, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY size, doc_id)::DOUBLE AS k FROM d
)
SELECT doc_id, size, words AS source_size, target,
       (least(floor(k * rate + u) - floor((k - 1.0::DOUBLE) * rate + u), 2)::BIGINT * size)::BIGINT AS taken
FROM n JOIN r USING (skey)
"""
