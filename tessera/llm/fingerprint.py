"""Document fingerprints by prefix polynomial hashes.

A text has two modular prefix arrays, S[i] = sum of c[j] * B^j for j < i. They answer whether any two spans are equal
in constant time, and a binary search over them finds the longest common extension of two positions. The arrays are the
fingerprint: likeness is worked out from the arrays of two texts and nothing else. What is returned as a string is their
short form, the length and the two last entries, which names a fingerprint and tells whether two are equal.

near_edited and near_next go on past mismatches: between the common prefix and suffix, equal windows of SPAN code points are
anchors, extended both ways, and the share of the longer text that these ends and the heaviest chain of spans between
them cover, in the order of both texts, is the likeness. ends_edited and ends_next are the shares that one common extension from either end covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_batches

#: (modulus, base): primes under 2**31, so that products stay in 64 bits.
MODULI = ((2147483647, 1103515249), (2147483629, 862345133))
#: Documents of a partition, from which on there are more partitions than the session shuffles into.
ROWS_A_PART = 65536
#: Code points of an anchor: what is equal in fewer between two edits does not count, as unrelated texts share that too.
SPAN = 16
_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("ends_edited", pa.float64()), ("ends_next", pa.float64()),
]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, ends_edited double, ends_next double"
#: Rows of a result, or an end of a partition (1 its first document, 2 its last) with its text.
_PART = f"{_RESULT}, part int, edge int, text string"
_ARROW, _PART_ARROW = pa.schema(_FIELDS), pa.schema([*_FIELDS, ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
_powers = [np.ones(1, np.uint64) for _ in range(2 * len(MODULI))]


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """B^0 ... B^(n-1), or their inverses, kept between calls; it grows by doubling to the longest text seen."""
    modulus, base = MODULI[which]
    base, at = (pow(base, -1, modulus), which + len(MODULI)) if inverse else (base, which)
    have = _powers[at]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), modulus))
        have = np.concatenate([have, have * step % np.uint64(modulus)])
    _powers[at] = have
    return have[:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix arrays over code points."""

    def __init__(self, chars: np.ndarray, head: PrefixHash | None = None, shared: int = 0):
        """head, shared: the first `shared` code points are those of head, whose entries are used again."""
        self.n, self.chars, self.sums, self._windows = len(chars), chars, [], None
        for which, (modulus, _) in enumerate(MODULI):
            m = np.uint64(modulus)
            terms = (chars[shared:] + np.uint64(1)) * powers(which, self.n)[shared:] % m
            start = head.sums[which][: shared + 1] if head else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([start, (start[-1] + np.cumsum(terms)) % m]))

    def fingerprint(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(s[-1]):08x}" for s in self.sums)

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans of this length at i here and at j there are equal."""
        for which, (modulus, _) in enumerate(MODULI):
            a, b = self.sums[which], other.sums[which]
            x, y = int(a[i + length]) - int(a[i]), int(b[j + length]) - int(b[j])
            if i != j:
                pw = powers(which, max(i, j) + 1)
                x, y = x * int(pw[j]), y * int(pw[i])
            if (x - y) % modulus:
                return False
        return True

    def common_prefix(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest common extension to the right of i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low

    def common_before(self, i: int, other: PrefixHash, j: int, most: int) -> int:
        """The longest common extension to the left of i here and j there, up to most."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def common_suffix(self, other: PrefixHash, most: int) -> int:
        return self.common_before(self.n, other, other.n, most)

    def likeness(self, other: PrefixHash) -> float:
        """The share of the longer text that a common prefix and a common suffix cover, 1 for equal texts."""
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        if not longer:
            return 1.0
        head = self.common_prefix(0, other, 0)
        return (head + self.common_suffix(other, shorter - head)) / longer

    def _window_hashes(self, low: int, high: int) -> np.ndarray:
        out = np.zeros(max(0, high - low - SPAN + 1), np.uint64)
        for which, (modulus, _) in enumerate(MODULI):
            m, sums = np.uint64(modulus), self.sums[which]
            down = powers(which, low + len(out), inverse=True)[low:]
            out = (out << np.uint64(32)) | (sums[low + SPAN : low + SPAN + len(out)] + m - sums[low : low + len(out)]) % m * down % m
        return out

    def windows(self, low: int, high: int) -> np.ndarray:
        """A hash of each window of SPAN code points from low to high, the same for equal windows wherever they lie. Most of a text's windows are worked out once for all."""
        if 2 * (high - low) < self.n and self._windows is None:
            return self._window_hashes(low, high)
        if self._windows is None:
            self._windows = self._window_hashes(0, self.n)
        return self._windows[low : max(low, high - SPAN + 1)]

    def runs(self, other: PrefixHash, head: int = 0, tail: int = 0) -> np.ndarray:
        """Rows (i, j, length) of equal spans, as long as they can be, of what lies between the first head and the last tail
        code points; equal windows are paired by their place among equals, from the first and from the last."""
        mine, theirs = self.windows(head, self.n - tail), other.windows(head, other.n - tail)
        none = np.zeros((0, 3), np.int64)
        if not len(mine) or not len(theirs):
            return none
        marked = np.zeros(1 << 17, bool)  # by the upper 17 of 63 bits
        marked[theirs >> np.uint64(46)] = True
        here = np.flatnonzero(marked[mine >> np.uint64(46)] if len(mine) else [])
        known = np.sort(theirs)
        here = here[known[np.minimum(np.searchsorted(known, mine[here]), len(known) - 1)] == mine[here]]
        if not len(here):
            return none
        there = np.flatnonzero(np.isin(theirs, mine[here]))
        here, there = here[np.argsort(mine[here], kind="stable")], there[np.argsort(theirs[there], kind="stable")]
        a, b = mine[here], theirs[there]
        at = np.arange(len(a))
        first, last = np.searchsorted(b, a), np.searchsorted(b, a, "right")
        front = first + at - np.searchsorted(a, a)
        back = last - np.searchsorted(a, a, "right") + at
        found = []
        for to, good in ((front, front < last), (back, back >= first)):
            i, j = here[good] + head, there[to[good]] + head
            order = np.argsort(i)
            i, j = i[order], j[order]
            edges = np.concatenate([[0], np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1, [len(i)]])
            found.append(np.column_stack([i[edges[:-1]], j[edges[:-1]], np.diff(edges) + SPAN - 1]))
        found = np.unique(np.concatenate(found), axis=0)
        i, j, n = found.T
        more = (i + n < self.n - tail) & (j + n < other.n - tail) & (self.chars[np.minimum(i + n, self.n - 1)] == other.chars[np.minimum(j + n, other.n - 1)])
        less = (i > head) & (j > head) & (self.chars[i - 1] == other.chars[j - 1])
        for k in np.flatnonzero(more | less).tolist():
            x, y, length = found[k].tolist()
            before = self.common_before(x, other, y, min(x, y) - head)
            beyond = min(self.common_prefix(x + length, other, y + length), self.n - tail - x - length, other.n - tail - y - length)
            found[k] = x - before, y - before, before + length + beyond
        return np.unique(found, axis=0) if (more | less).any() else found

    def aligned(self, other: PrefixHash) -> float:
        """The share of the longer text that the common prefix, the common suffix of what is left, and equal spans between
        them cover which follow each other in both texts; 1 for equal texts, never below likeness().

        A span that overlaps the one before it in either text counts from where that one ends.
        """
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        head = self.common_prefix(0, other, 0)
        if head == longer:
            return 1.0
        tail = self.common_suffix(other, shorter - head)
        spans = self.runs(other, head, tail)
        if not len(spans):
            return (head + tail) / longer
        i, j, n = spans[np.lexsort((spans[:, 1], spans[:, 0]))].T
        stop, other_stop, total = i + n, j + n, n.copy()
        for k in range(1, len(n)):
            over = np.maximum(np.maximum(stop[:k] - i[k], other_stop[:k] - j[k]), 0)
            total[k] = max(n[k], (total[:k] + n[k] - over)[over < n[k]].max(initial=0))
        return (head + tail + int(total.max())) / longer


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each row that another follows in its partition, and the partition's two ends."""
    part, held, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            chars = codes(text)
            prefix = PrefixHash(chars)
            if held is None:
                out.append({"doc_id": doc, "part": part, "edge": 1, "text": text})
            else:
                out.append(_row(*held, text, chars, prefix) | {"part": part, "edge": 0})
            held = doc, text, chars, prefix
        yield pa.RecordBatch.from_pylist(out, _PART_ARROW)
        out = []
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "part": part, "edge": 2, "text": held[1]}], _PART_ARROW)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True):
            chars, after_chars = codes(text), codes(after)
            out.append(_row(doc, text, chars, PrefixHash(chars), after, after_chars, PrefixHash(after_chars)))
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def _row(doc, text: str, chars: np.ndarray, prefix: PrefixHash, after: str, after_chars: np.ndarray, after_prefix: PrefixHash) -> dict:
    quarter = len(chars) // 4
    stay = len(chars) - quarter
    edited = PrefixHash(np.concatenate([chars[:stay], after_chars[:quarter]]), prefix, stay)
    return {
        "doc_id": doc, "n_chars": len(chars), "edited_sha256": hashlib.sha256((text[:stay] + after[:quarter]).encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": prefix.fingerprint(), "edited_fingerprint": edited.fingerprint(), "near_edited": prefix.aligned(edited), "near_next": prefix.aligned(after_prefix),
        "ends_edited": prefix.likeness(edited), "ends_next": prefix.likeness(after_prefix),
    }


def fingerprints(docs: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """One row for each row of docs (doc_id, text), beside an edited text whose last quarter is taken from the next document.

    Null text is empty. A null doc_id sorts first; rows with equal doc_id follow each other in the order of a hash of their
    texts. The document after the last is the first, so a single document follows itself. An empty table gives an empty
    result. Other columns are not read.

    Documents are sorted by ranges of doc_id, texts move once, and a partition is read as a stream. Each hands out its
    first and its last document; the last one of a partition then meets the first one of the next that has any. The
    driver holds nothing of the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    n = docs.count()
    parts = max(1, -(-n // rows_a_part), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    with text_batches(spark):
        sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
        found = keep(sorted_rows.mapInArrow(_neighbours, _PART), "fingerprints")
        first, last = found.filter("edge = 1").select("part", F.col("text").alias("after")), found.filter("edge = 2").select("part", "doc_id", "text")
        every = Window.orderBy("part")  # one row a partition
        following = found.filter("edge = 1").select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(every)).alias("next"))
        pairs = last.join(following, "part").select("next", "doc_id", "text").join(first.withColumnRenamed("part", "next"), "next")
        ends = keep(pairs.select("doc_id", "text", "after").mapInArrow(_pairs, _RESULT), "fingerprint-ends")
    return found.filter("edge = 0").select(*_ARROW.names).unionByName(ends)


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
