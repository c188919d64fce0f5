"""Scores of one query term in one document, as column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: (tf, df, document length, number of documents, mean length) -> contribution of the term
Scorer = Callable[[Column, Column, Column, int, float], Column]


def tfidf(tf: Column, df: Column, length: Column, num_docs: int, avgdl: float) -> Column:
    """(1 + ln tf) * ln(N / df), without length normalization; a term in all documents adds 0."""
    return (F.lit(1.0) + F.log(tf)) * F.log(F.lit(float(num_docs)) / df)


def bm25(k1: float = K1, b: float = B) -> Scorer:
    """Okapi BM25 with an idf that is always positive."""

    def score(tf: Column, df: Column, length: Column, num_docs: int, avgdl: float) -> Column:
        idf = F.log((F.lit(float(num_docs)) - df + 0.5) / (df + 0.5) + 1.0)
        norm = F.lit(1.0 - b) + F.lit(b) * (length / F.lit(avgdl)) if avgdl else F.lit(1.0 - b)
        return idf * (tf * F.lit(k1 + 1.0)) / (tf + F.lit(k1) * norm)

    return score


def get_scorer(name: str, k1: float = K1, b: float = B) -> Scorer:
    """TFIDF or BM25, in any case and with outer spaces."""
    kinds = {"TFIDF": tfidf, "BM25": bm25(k1, b)}
    if name.strip().upper() not in kinds:
        raise ValueError(f"unknown ranker {name!r}: TFIDF or BM25")
    return kinds[name.strip().upper()]
