"""How many postings a skipping document-at-a-time intersection would look at. A metric only; matching is a join.

The count is defined on whole arrays. The documents that such an intersection aims at form a chain: it starts at the
largest first id of a query's lists, and an id is followed by the largest of the next ids that the lists have (the id
itself counts, unless all lists have it). A move from place a to place g of a list of n looks at a + 2**k - 1 for all
k >= 1 that stay short of g, at the next of these places or the last one if that comes first, at the middles of halving
the rest, and at g. A list's count is the number of different places, the first one included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index
from .search import hits, lookup, parse_queries, query_terms, resolved

_END = np.iinfo(np.int64).max


def probes(start: int, goal: int, n: int) -> Iterator[int]:
    """The places that a move from start to goal looks at in a list of n; goal n is beyond its end."""
    if goal <= start:
        return
    doublings = (goal - start).bit_length() - 1
    yield from (start + (1 << k) - 1 for k in range(1, doublings + 1))
    rest = range(start + (1 << doublings), min(start + (2 << doublings), n))
    yield rest.stop - 1 if len(rest) else n - 1
    if goal < n:
        while len(rest) > 1:
            half = (len(rest) - 1) // 2
            yield rest[half]
            rest = rest[half + 1 :] if rest[half] < goal else rest[: half + 1]
        yield goal


def scanned(lists: list[list[int]]) -> tuple[list[int], int]:
    """Common ids of ascending lists, and the number of places looked at in all of them."""
    arrays = [np.array(ids, np.int64) for ids in lists]
    if not all(map(len, arrays)) or not arrays:
        return [], sum(min(1, len(a)) for a in arrays)
    every = np.unique(np.concatenate(arrays))
    here, beyond = (np.max([np.append(a, _END)[np.searchsorted(a, every, side)] for a in arrays], axis=0) for side in ("left", "right"))
    follows, chain = np.where(here == every, beyond, here), [max(a[0] for a in arrays)]
    while (after := follows[np.searchsorted(every, chain[-1])]) != _END:
        chain.append(after)
    aims = np.array(chain)
    common = here[np.searchsorted(every, aims)] == aims
    total = 0
    for a in arrays:
        goals = np.searchsorted(a, aims)
        starts = np.append(0, (goals + common)[:-1])
        moves = (p for s, g in zip(starts.tolist(), goals.tolist(), strict=True) for p in probes(s, g, len(a)))
        total += len({0, *moves, *(p for p in (goals + 1)[common].tolist() if p < len(a))})
    return aims[common].tolist(), total


def skip_ratio(seen, total):
    """The share of postings never looked at; 0 without postings."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(1.0) - seen / F.nullif(total, F.lit(0)))


def galloping_metrics(index: Index, queries: DataFrame) -> DataFrame:
    """qid, postings_in_lists, postings_scanned, early_terminated, skip_ratio. A query's lists are held by one task: use it to study single queries."""
    parsed = parse_queries(queries, index.analyzer)
    found = lookup(query_terms(parsed), index.lexicon)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [sorted(ids) for _, ids in rows.groupby("pos")["doc_id"]]
        return pd.DataFrame({"qid": [rows["qid"].iloc[0]], "in_lists": [len(rows)], "scanned": [scanned(lists)[1]]})

    counted = hits(resolved(found), index).select("qid", "pos", "doc_id").groupBy("qid").applyInPandas(run, "qid long, in_lists long, scanned long")
    early = found.groupBy("qid").agg(F.max(F.col("df").isNull()).alias("early_terminated"))
    total, seen = F.coalesce("in_lists", F.lit(0).cast("long")), F.coalesce("scanned", F.lit(0).cast("long"))
    return early.join(counted, "qid", "left").select("qid", total.alias("postings_in_lists"), seen.alias("postings_scanned"), "early_terminated", skip_ratio(seen, total).alias("skip_ratio"))


def run_averages(metrics: DataFrame) -> DataFrame:
    """One row over the queries of a batch: how many, how many ended early, and mean, least and largest skip ratio (0 without queries)."""
    of = lambda f: F.coalesce(f("skip_ratio"), F.lit(0.0))
    return metrics.agg(
        F.count("*").alias("num_queries"), F.count_if("early_terminated").alias("num_early"), F.round(of(F.avg), 6).alias("mean_skip_ratio"),
        F.round(of(F.min), 6).alias("min_skip_ratio"), F.round(of(F.max), 6).alias("max_skip_ratio"),
    )
