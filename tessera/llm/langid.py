"""Language identification by interpolated Kneser-Ney character models, one for each language.

The models are fitted on a bounded sample of labelled documents (SAMPLE_DOCS for each language and SAMPLE_TOTAL in all,
of a longer one SPANS spans of SAMPLE_CHARS characters in all, spread from its start to its end) and stored in sorted hash arrays: for each order, the n-grams that any language has seen, with
one column of interpolated log-probabilities a language; and their contexts with the weights for backing off. A text
gets the language with the lowest cross-entropy per character over all of its characters. It is rejected when even that
lies above what texts of its length reach, as calibrated on sample documents that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_batches

ORDER = 4
SAMPLE_DOCS = 1500
#: Characters that one document gives to the fit, and the spans that a longer one gives them in.
SAMPLE_CHARS = 20000
SPANS = 20
#: Documents over all languages; with many languages each gets fewer, though 20 at least.
SAMPLE_TOTAL = 12000
#: Characters counted, and scored, at a time, to bound memory.
COUNT_CHARS, SCORE_CHARS = 500_000, 150_000
#: Bits of a character's number: the 65,534 most frequent code points of the sample have one, any other is unknown.
_BITS = 16
_UNKNOWN = (1 << _BITS) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 18
_PREDICTION = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


_is_letter: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of other characters as one 0, and a 0 at either end; empty without letters."""
    if not _is_letter:
        _is_letter.append(_letters())
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = _is_letter[0][chars]
    if not good.any():
        return np.zeros(0, np.uint32)
    chars = np.concatenate([[0], np.where(good, chars, 0), [0]]).astype(np.uint32)
    return chars[np.concatenate([[True], (chars[1:] != 0) | (chars[:-1] != 0)])]


class HashArray:
    """Sorted hashes with a row of values for each; a table over the top bits gives where to look."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        hashes = grams * _MIX
        order = np.argsort(hashes)
        self.hashes, self.values = np.append(hashes[order], np.uint64(0)), values[order]
        self.start = np.searchsorted(hashes[order], np.arange(1 << _RADIX, dtype=np.uint64) << np.uint64(64 - _RADIX)).astype(np.int32)
        self.steps = int(np.diff(np.append(self.start, len(grams))).max(initial=0))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The row of each n-gram, -1 where it isn't there."""
        hashes = grams * _MIX
        at = self.start[(hashes >> np.uint64(64 - _RADIX)).astype(np.int64)]
        row = np.full(len(grams), -1, np.int32)
        n = len(self.hashes) - 1
        for step in range(self.steps):
            here = np.minimum(at + step, n)
            hit = (self.hashes[here] == hashes) & (here < n)
            row[hit] = here[hit]
        return row


@dataclass
class Models:
    langs: list[str]
    alphabet: np.ndarray  # id of each code point
    grams: list[HashArray]  # by order, from 1
    contexts: list[HashArray]  # of the grams of each order, from 2; the first is unused
    floor: np.ndarray
    sharpness: float = 1.0
    entropy: float = 0.0
    spread: float = 0.0
    limits: dict = field(default_factory=dict)

    def ids(self, chars: np.ndarray) -> np.ndarray:
        return self.alphabet[chars].astype(np.uint64)

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        """A row of log-probabilities, a column a language, for each character after the first ORDER - 1."""
        order = len(self.grams)
        n = len(ids) - order + 1
        full = np.zeros(n, np.uint64)
        for k in range(order):
            full = (full << np.uint64(_BITS)) | ids[k : k + n]
        out = np.zeros((n, len(self.langs)), np.float32)
        todo = np.arange(n)
        gram = full
        for k in range(order, 0, -1):
            row = self.grams[k - 1].find(gram)
            hit = row >= 0
            out[todo[hit]] += self.grams[k - 1].values[row[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                return out
            if k > 1:
                row = self.contexts[k - 1].find(gram >> np.uint64(_BITS))
                seen = row >= 0
                out[todo[seen]] += self.contexts[k - 1].values[row[seen]]
                gram = gram & np.uint64((1 << (_BITS * (k - 1))) - 1)
        out[todo] += self.floor
        return out

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, and the number of characters; texts come from letters() and aren't empty."""
        cuts = np.cumsum([len(t) for t in texts]) // SCORE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(texts)]
        parts = [self._entropies(texts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return np.concatenate([e for e, _ in parts]), np.concatenate([n for _, n in parts])

    def _entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = len(self.grams)
        pad = np.zeros(order - 2, np.uint32)
        joined = [np.concatenate([pad, t]) for t in texts]
        sizes = np.array([len(j) for j in joined])
        ids = self.ids(np.concatenate(joined))
        probs = self.log_probs(ids)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends = starts + sizes - order + 1
        inner = np.add.reduceat(np.concatenate([probs.astype(np.float64), np.zeros((order, probs.shape[1]))]), np.column_stack([starts, ends]).ravel())[::2]
        counts = sizes - order + 1
        return -inner / counts[:, None], counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, confidence in it, cross-entropy, and whether it is rejected."""
        out: list = [("und", 0.0, None, True)] * len(texts)
        own = [(i, chars) for i, t in enumerate(texts) if t and len(chars := letters(t))]
        if own and self.langs:
            entropy, counts = self.entropies([c for _, c in own])
            best = entropy.argmin(1)
            weight = np.exp(-self.sharpness * (entropy - entropy.min(1, keepdims=True)))
            score = weight.max(1) / weight.sum(1)
            limit = self.entropy + self.spread / np.sqrt(counts)
            for (i, _), b, s, e, m in zip(own, best, score, entropy.min(1), limit, strict=True):
                out[i] = (self.langs[b], float(s), float(e), bool(e > m))
        return out


def _tally(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different values of all parts, ascending, and how often each occurs; about COUNT_CHARS values are held at a time."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        more, often = np.unique(np.concatenate(held), return_counts=True)
        union = np.union1d(grams, more)
        total = np.zeros(len(union), np.int64)
        total[np.searchsorted(union, grams)] += counts
        total[np.searchsorted(union, more)] += often
        return union, total

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= COUNT_CHARS:
            grams, counts = merged()
            held, size = [], 0
    return merged() if held else (grams, counts)


def fit(labelled: Iterable[tuple[str, str]], order: int = ORDER) -> Models:
    """Models from (lang, text). Every fifth text of a language calibrates rejection and confidence; the others are counted."""
    own: dict[str, list[np.ndarray]] = {}
    for lang, text in labelled:
        if len(chars := letters(text)):
            own.setdefault(lang, []).append(chars)
    langs = sorted(own)
    counted = {lang: [t for i, t in enumerate(own[lang]) if i % 5 or len(own[lang]) < 5] for lang in langs}
    points, often = _tally(t.astype(np.uint64) for ts in counted.values() for t in ts)
    kept = points[np.argsort(-often, kind="stable")][: _UNKNOWN - 1] if len(points) else np.zeros(1, np.uint64)
    alphabet = np.full(0x110000, _UNKNOWN, np.uint16)
    alphabet[kept] = np.arange(1, len(kept) + 1)
    alphabet[0] = 0
    symbols = len(kept) + 2
    bits = np.uint64(_BITS)
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language and order: n-grams, counts
    for lang in langs:
        pad = np.zeros(order - 2, np.uint32)

        def windows(t: np.ndarray) -> np.ndarray:
            ids = alphabet[np.concatenate([pad, t])].astype(np.uint64)  # noqa: B023
            full = np.zeros(len(ids) - order + 1, np.uint64)
            for k in range(order):
                full = (full << bits) | ids[k : k + len(full)]
            return full

        grams = [_tally(map(windows, counted[lang]))]
        for k in range(order - 1, 0, -1):  # how many different characters stand before an n-gram
            grams.append(np.unique(grams[-1][0] & np.uint64((1 << (_BITS * k)) - 1), return_counts=True))
        seen.append(grams[::-1])
    tables, contexts, lower = [], [HashArray(np.zeros(0, np.uint64), np.zeros((0, len(langs))))], None
    floor = np.zeros(len(langs))
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([s[k - 1][0] for s in seen])) if seen else np.zeros(0, np.uint64)
        above = np.unique(union >> bits)
        prob, back = np.zeros((len(union), len(langs))), np.ones((len(above), len(langs)))
        for n, s in enumerate(seen):
            grams, counts = s[k - 1]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            less = once / (once + 2 * twice) if once and twice else 0.5
            context, where, follow = np.unique(grams >> bits, return_inverse=True, return_counts=True)
            total = np.bincount(where, counts, len(context))
            prob[np.searchsorted(union, grams), n] = (counts - less) / total[where]
            back[np.searchsorted(above, context), n] = less * follow / total
        if k == 1:
            floor = back[0] / symbols if len(above) else floor
            prob += floor
        else:
            prob += back[np.searchsorted(above, union >> bits)] * lower[1][np.searchsorted(lower[0], union & np.uint64((1 << (_BITS * (k - 1))) - 1))]
            contexts.append(HashArray(above, np.log(back).astype(np.float32)))
        tables.append(HashArray(union, np.log(prob).astype(np.float32)))
        lower = (union, prob)
    models = Models(langs, alphabet, tables, contexts, np.log(floor).astype(np.float32) if len(langs) else floor)
    _calibrate(models, [(n, t) for n, lang in enumerate(langs) for i, t in enumerate(own[lang]) if not i % 5])
    return models


def _calibrate(models: Models, held: list[tuple[int, np.ndarray]]) -> None:
    """Rejection above the entropies of held texts, with room for short ones; confidence by the likelihood of their labels."""
    if not held:
        return
    entropy, counts = models.entropies([t for _, t in held])
    truth = np.array([n for n, _ in held])
    best = entropy.min(1)
    long = best[counts >= 100] if (counts >= 100).any() else best
    models.entropy = float(np.quantile(long, 0.999) * 1.25)
    models.spread = float(8 * np.std((best - best.mean()) * np.sqrt(counts)) + 4)
    chances = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]
    likely = [-np.mean(np.log(np.exp(-c * (entropy - best[:, None])).sum(1)) + c * (entropy[np.arange(len(truth)), truth] - best)) for c in chances]
    models.sharpness = chances[int(np.argmax(likely))]


def in_training(doc_id) -> F.Column:
    """Documents that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def spread(text: F.Column, chars: int, spans: int = SPANS) -> F.Column:
    """The text if it has at most so many characters, else equal spans of so many in all, evenly from its start to its end."""
    each = max(1, chars // spans)
    starts = F.transform(F.sequence(F.lit(0), F.lit(spans - 1)), lambda k: (k * (F.length(text).cast("long") - each) / (spans - 1)).cast("int") + 1)
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(F.transform(starts, lambda at: F.substr(text, at, F.lit(each))), " "))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Models from the labelled training rows of docs (doc_id, text, lang).

    Repeated rows (lang, doc_id, text) count once. A language's rows are thinned by a hash of id and text to about 1.2 times
    its share of the sample, and cut to it in the order of that hash; no task gathers a language. A text longer than sample_chars gives spans of it.
    Rows whose doc_id, lang or text is null teach nothing; without any other rows, or in an empty table, nothing is learned and
    every text is rejected. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.filter(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    counts = rows.select("lang", "row").distinct().groupBy("lang").count().collect()  # a row a language
    share = min(sample_docs, max(20, SAMPLE_TOTAL // max(1, len(counts))))
    limits = spark.createDataFrame([(r["lang"], int(min(1.0, (1.2 * share + 30) / r["count"]) * (1 << 31))) for r in counts], "lang string, last long")
    place = F.pmod("row", F.lit(1 << 31))
    thinned = rows.withColumn("place", place).join(F.broadcast(limits), "lang").filter("place < last")
    chosen = thinned.select("lang", spread(F.col("text"), sample_chars).alias("text"), "place", "row").groupBy("lang", "row", "place").agg(F.min("text").alias("text"))
    left = sorted(chosen.select("lang", "text", "place").collect(), key=lambda r: (r["lang"], r["place"], r["text"]), reverse=True)

    def labelled() -> Iterator[tuple[str, str]]:  # each text goes as soon as it is read
        taken = dict.fromkeys((r["lang"] for r in counts), 0)
        while left:
            r = left.pop()
            taken[r["lang"]] += 1
            if taken[r["lang"]] <= share:
                yield r["lang"], r["text"]

    return fit(labelled())


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for each row of docs (doc_id, text), over whole texts.

    Null or empty text and text without a letter is `und` with score 0 and rejected; so is all text if nothing was
    learned. Equal texts get equal answers; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a few MB, bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    with text_batches(docs.sparkSession):
        return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PREDICTION), "languages")


def keep_known(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs whose text the models do not reject, with all their columns, whatever their names.

    Null or empty text and text without a letter go; equal texts go or stay together, each repeated row by itself; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not f[3] for f in shared.value.predict(batch.column("text").to_pylist())], pa.bool_()))

    with text_batches(docs.sparkSession):
        return keep(docs.mapInArrow(run, docs.schema), "known-languages")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
