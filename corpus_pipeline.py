"""A corpus pipeline: language ID, near-duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. run() applies them to the table documents.

In every stage an empty table gives an empty result, and further columns, whatever their names, are kept (the last stage
returns pieces, not documents). What each does with nulls, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, neardup, packing, secrets
from tessera.llm.common import keep
from tessera.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are learned from the labelled training rows of docs; texts that fit none of them, or have no letter, go.

    Null and empty texts have no letter and go. Rows whose lang, text or doc_id is null teach nothing; if nothing can be
    learned, all rows go. Equal texts share their fate; repeated rows stay repeated.
    """
    ship(spark)
    return langid.keep_known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more stays: the one with the smallest doc_id.

    A null doc_id is larger than any other. Of repeated rows, and of different texts with the smallest doc_id of a group, one
    stays. Null texts and texts without words are in no group; all of them stay.
    """
    ship(spark)
    return neardup.deduplicate(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the texts; examples that several sources share stay. n_chars follows the text; no row goes.

    Null texts stay null and keep their n_chars. Null sources are one owner; a null doc_id is one repository of its owner.
    Repeated rows count once and are masked alike.
    """
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that each source comes near its target share of words.

    A null source is a source of its own, a null text has no words; a source without words is left out. Rows equal in
    doc_id, source and size may swap copies; repeated rows are taken each by itself. Reruns agree.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A null or empty text is one piece with the end id alone; a null doc_id is kept; repeated rows are packed each.
    """
    import public_tokenizers

    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, near-duplicates and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
