"""Token ids of whole texts by the tokenizers library, with a memory for pieces.

The library cuts a text into pieces and merges within each piece alone. Texts of common Latin characters without an
apostrophe are cut here by the same rule, over arrays, and a piece already seen takes its ids from memory by its 64-bit
hash; pieces not seen go to the library. Every other text goes to the library as a whole, and so does one that holds the
string of an added token: the library, as it is set by default, makes that token of it. The rule is used only if it agrees
with the library on a probe.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np

#: Pieces that a worker remembers at most.
MEMORY = 400_000
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
#: Characters whose class and normal form are the same in every Unicode version; U+0130 changes length in lower case.
_PLAIN = re.compile("[\t\n\r\x20-&(-\x7e\xa1-įı-ſ‐-‧‰-⁞]*")
#: Pieces of which the library can take many in one text: where each starts, or ends, shows in the ids.
_SPACE_WORD, _LETTER_WORD = re.compile(f" [{_LETTERS}]+"), re.compile(f"[{_LETTERS}]+")
_PROBE = "The  quick-brown (fox) is\n\nhere: Ünïcode ß œuvre, x=1234\t ab  \t end½ AKIA«x» \n —“q”…\n\r\nz \n"


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, of the code points of plain text."""
    table = np.full(0x2060, 3, np.uint8)
    for kind, members in ((1, _LETTERS), (2, _NUMBERS)):
        table[[i for i in range(0x180) if re.match(f"[{members}]", chr(i))]] = kind
    table[[9, 10, 13, 32]] = 0
    return table


_class = _classes()
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_power = [np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))]


def _first_of_run(kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a run of one class starts here; a run ends with its text."""
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[edges[edges < len(kind)]] = True
    return first


def _byte_level(chars: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces: runs of a class with one space before them, and what is left of white space; before a run, its last
    character is a piece of its own."""
    kind = _class[chars]
    first = _first_of_run(kind, edges)
    begins = np.zeros(len(chars) + 1, bool)
    begins[edges[:-1]] = True
    blank = kind == 0
    runs = np.flatnonzero(first & ~blank)
    before = runs - 1
    glued = np.zeros(len(runs), bool)
    glued[runs > 0] = (chars[before[runs > 0]] == 32) & ~begins[runs[runs > 0]]
    start = np.zeros(len(chars), bool)
    start[runs - glued] = True
    start[np.flatnonzero(first & blank)] = True
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~begins[1:-1]
    last[-1:] = False
    start[last] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(chars))


def _words(chars: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces: runs of letters, runs of others, and each number; white space is dropped."""
    kind = _class[chars]
    first = _first_of_run(kind, edges)
    start = first & (kind != 0) | (kind == 2)
    stop = np.append(first[1:] | (kind[:-1] == 2), True)[: len(chars)] & (kind != 0)
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, never 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    if sizes.max() > len(_power[0]):
        _power[0] = np.cumprod(np.full(2 * int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    before = np.cumsum(sizes) - sizes
    place = np.arange(before[-1] + sizes[-1]) - np.repeat(before, sizes)
    values = chars[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    x = np.add.reduceat(values * _power[0][place], before) + sizes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return np.maximum(x ^ (x >> np.uint64(32)), np.uint64(1))


class _Table:
    """Numbers of hashes in the order of add(), by open addressing over arrays."""

    def __init__(self):
        self.bits = (4 * MEMORY).bit_length()
        self.hashes, self.numbers, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        out = np.full(len(hashes), -1, np.int64)
        slot, todo = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            there = self.hashes[slot]
            hit = there == hashes[todo]
            out[todo[hit]] = self.numbers[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """hashes are distinct and new."""
        slot, todo = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = self.hashes[slot] == 0
            self.hashes[slot[free]] = hashes[todo[free]]
            own = free & (self.hashes[slot] == hashes[todo])
            self.numbers[slot[own]] = self.n + todo[own]
            todo, slot = todo[~own], (slot[~own] + 1) & ((1 << self.bits) - 1)
        self.n += len(hashes)


def _fit(array: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it has room for n."""
    while len(array) < n:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


_encoders: dict[int, Encoder] = {}


class Encoder:
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        added = [t["content"].lower() for t in json.loads(definition).get("added_tokens", [])]
        self.added, self.mark = added, os.path.commonprefix(added)
        lower = "Lowercase" in json.dumps(json.loads(definition).get("normalizer"))
        self.plain, self.lower, self.word = True, lower, _LETTER_WORD if lower else _SPACE_WORD
        names = self.library.get_vocab()
        self.edge = np.zeros(max(names.values()) + 1, bool)  # ids that start a word of self.word, or end it
        self.edge[[i for name, i in names.items() if (name.endswith("</w>") if lower else name.startswith("Ġ"))]] = True
        self._forget()
        if self._by_pieces([_PROBE])[0] != self._whole(_PROBE):
            self.plain = False
        self._forget()

    def _forget(self) -> None:
        """Pieces have numbers by their hash; where the ids of each number start in one array, and how many they are."""
        self.table = _Table()
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of ids of each. Plain words go to the library many at a time, as one text."""
        plain = np.array([self.word.fullmatch(p) is not None for p in pieces])
        words = [p for p, w in zip(pieces, plain.tolist(), strict=True) if w]
        glue = " " if self.lower else ""
        found = self.library.encode_batch_fast([glue.join(words[a : a + 64]) for a in range(0, len(words), 64)], add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            plain[:] = False
            ids, edges = ids[:0], edges[:0]
        sizes = np.zeros(len(pieces), np.int64)
        sizes[plain] = np.diff(np.append(0, edges + 1) if self.lower else np.append(edges, len(ids)))
        other = [p for p, w in zip(pieces, plain.tolist(), strict=True) if not w]
        rest = self.library.encode(other, is_pretokenized=True, add_special_tokens=False) if other else None
        sizes[~plain] = np.bincount(np.array(rest.word_ids, np.int64), minlength=len(other)) if other else 0
        out = np.zeros(sizes.sum(), np.uint32)
        of_word = np.repeat(plain, sizes)
        out[of_word] = ids
        out[~of_word] = np.array(rest.ids if other else [], np.uint32)
        return out, sizes

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        whole = "".join(t.lower() for t in texts) if self.lower else "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([0, *map(len, texts)])
        starts, ends = (_words if self.lower else _byte_level)(chars, edges)
        hashes = _hashes(chars, starts, ends)
        numbers = self.table.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            _, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = missing[at]
            ids, sizes = self._new([whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            n = self.table.n
            self.ids, self.first, self.size = _fit(self.ids, self.used + len(ids)), _fit(self.first, n + len(new)), _fit(self.size, n + len(new))
            self.ids[self.used : self.used + len(ids)] = ids
            self.first[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(new)] = sizes
            numbers[missing] = n + back
            if n + len(new) <= MEMORY:
                self.table.add(hashes[new])
                self.used += len(ids)
        sizes = self.size[numbers]
        before = np.append(0, np.cumsum(sizes))
        raw = self.ids[np.repeat(self.first[numbers] - before[:-1], sizes) + np.arange(before[-1])].astype("<u4").tobytes()
        cuts = (4 * before[np.searchsorted(starts, edges)]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _holds_added(self, text: str) -> bool:
        """Whether the string of an added token, in any case, is in the text."""
        return bool(self.added) and self.mark in (low := text.lower()) and any(a in low for a in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [self.plain and not self._holds_added(t) and _PLAIN.fullmatch(t) is not None for t in texts]
        by_pieces = iter(self._by_pieces([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(by_pieces) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer's JSON; it is kept, with its memory, from task to task."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def definition(path: str) -> str:
    """A tokenizer's JSON, read on the driver and sent to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()
