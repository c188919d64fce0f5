from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
EXTRA = ["row", "n", "size", "bucket", "node", "at", "spans", "copies", "lane", "rank", "score", "part", "ghost", "shard", "slot", "length", "offset", "ids", "__row", "__doc", "__n"]


def docs_table(spark, rows, extra: bool = True):
    """rows of (doc_id, text, lang, source) with n_chars and, if wanted, columns of clashing names."""
    names = EXTRA if extra else []
    data = [(*r, None if r[1] is None else len(r[1]), *["x"] * len(names)) for r in rows]
    return spark.createDataFrame(data, DOCS + "".join(f", `{n}` string" for n in names))


def prose(rng: random.Random, n: int, words: str = "the and of to in storm river green quiet table window paper stone bright early walking under market garden silver") -> str:
    pool = [a + b for a in words.split() for b in ("", "s", "ing")]
    return " ".join(rng.choice(pool) for _ in range(n))


def awkward(rng: random.Random):
    """Null and empty texts, repeated rows, nulls in every column, one very long text, non-Latin text."""
    long = prose(rng, 30_000)
    return [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n", None, None), (3, long, "en", "a"), (4, "日本語のテキスト 😀 it's", None, "b"), (5, "same text here again and again", "en", "a"),
        (5, "same text here again and again", "en", "a"), (6, "same text here again and again", "de", None), (None, "no id at all", "en", "b"), (7, "123 456", "fr", "c"), (8, prose(rng, 40), "en", "a"),
    ]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")
