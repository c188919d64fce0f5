"""One analyzer for documents and queries.

`simple` cuts at everything but letters and digits and stays inside the plan. `treebank` follows the published Penn
Treebank conventions with a rule-based sentence splitter and can stem; it runs as one Arrow function whose stems are
remembered by each worker. Settings are stored with an index, so that queries meet the analyzer of their documents.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem
from .stopwords import ENGLISH

# What contractions leave behind, and the words that a contraction rule cuts in two.
RESIDUALS = ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m", "'t")
_JOINED = ("can|not", "d|'ye", "gim|me", "gon|na", "got|ta", "lem|me", "more|'n", "wan|na")
_ABBREVIATIONS = frozenset("mr mrs ms dr prof rev gen sen rep st jr sr inc ltd co corp vs etc e.g i.e a.m p.m u.s u.k no vol fig jan feb mar apr jun jul aug sep sept oct nov dec".split())
_SENTENCE_END = re.compile(r"""(?<=[.?!])["'”’)\]]*\s+(?=["'“‘(\[]*[A-Z0-9])""")
#: What stands before a word, what may follow its full stop, and how far back from there an abbreviation can begin.
_OPENING, _CLOSING, _LONGEST = set(" \t\r\n\f\v\"'“‘(["), "\"'”’)] \t\r\n\f\v", 1 + max(map(len, _ABBREVIATIONS))
_RULES = [
    (re.compile(r"[«“‘„»”’`]|``|''|\""), r" \g<0> "),
    (re.compile(r"(?i)(?<!\w)'(?!(?:re|ve|ll|m|t|s|d|n)\b)(?=\w\b)"), " ' "),
    (re.compile(r"([:,])(?=\D|$)"), r" \1 "),
    (re.compile(r"\.{2,}|--|[;@#$%&?!*\]\[(){}<>]"), r" \g<0> "),
    (re.compile(r"(?<!\.)\.(?=[\])}>\"'»”’ ]*\s*$)"), " . "),
    (re.compile(r"(?<=[^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|')(?=\s|$)"), r" \1 "),
    (re.compile(r"(?i)\b(?:" + "|".join(f"{a}(?={b}\\b)" for a, b in (x.split("|") for x in _JOINED)) + ")"), r"\g<0> "),  # in one pass over the text
    (re.compile(r"(?i)(?<!\w)'t(is|was)\b"), r" 't \1"),
]
_ALNUM = re.compile(r"[a-z0-9]")
_TOKENS = pa.list_(pa.string())
_stems: dict[str, str] = {}


def _last_word(text: str, start: int, end: int) -> str:
    """The word before the full stop that ends text[start:end], if it is short enough for an abbreviation; empty otherwise."""
    while end > start and text[end - 1] in _CLOSING:
        end -= 1
    if end == start or text[end - 1] != ".":
        return ""
    begin = end - 1
    while begin > start and text[begin - 1] not in _OPENING and not text[begin - 1].isspace():
        begin -= 1
        if end - begin > _LONGEST:
            return ""
    return text[begin : end - 1].lower()


def sentences(text: str) -> list[str]:
    """Cut after . ? ! before a capital or digit, but not after an abbreviation or a single initial."""
    out, start = [], 0
    for end in _SENTENCE_END.finditer(text):
        last = _last_word(text, start, end.end())
        if last in _ABBREVIATIONS or len(last) == 1 and last.isalpha():
            continue
        out.append(text[start : end.end()].strip())
        start = end.end()
    return [s for s in [*out, text[start:].strip()] if s]


def treebank_tokens(text: str | None) -> list[str]:
    """Lower-cased word tokens with at least one ASCII letter or digit, without what contractions leave."""
    out = []
    for sentence in sentences(text or ""):
        sentence = " ".join(sentence.split())  # runs of white space would be searched once for each place in them
        for pattern, into in _RULES:
            sentence = pattern.sub(into, sentence)
        out += [t for w in sentence.split() if _ALNUM.search(t := w.lower()) and t not in RESIDUALS and not t.startswith("'")]
    return out


def _stem(token: str) -> str:
    if token not in _stems:
        if len(_stems) >= 500_000:
            _stems.clear()
        _stems[token] = stem(token)
    return _stems[token]


@dataclass(frozen=True)
class Analyzer:
    """kind: treebank or simple; lengths are in code points and hold before stemming (the least also after it)."""

    kind: str = "treebank"
    stemmed: bool = True
    min_length: int = 2
    max_length: int = 40
    drop_numeric: bool = True
    stop_words: tuple[str, ...] = tuple(sorted(ENGLISH))

    def __post_init__(self):
        if self.kind not in ("treebank", "simple"):
            raise ValueError(f"unknown analyzer {self.kind!r}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, settings: str) -> Analyzer:
        found = json.loads(settings)
        return cls(**found | {"stop_words": tuple(found["stop_words"])})

    def normalize(self, tokens: list[str]) -> list[str]:
        """Terms of lower-case tokens, with repeats: stop words, lengths and numbers go first, then stems are taken."""
        stop, out = set(self.stop_words), []
        for token in tokens:
            if token in stop or not self.min_length <= len(token) <= self.max_length or self.drop_numeric and token.isdigit():
                continue
            term = _stem(token) if self.stemmed else token
            if len(term) >= self.min_length:
                out.append(term)
        return out

    def analyze(self, text: str | None) -> list[str]:
        """The same on one text, outside of a plan."""
        tokens = treebank_tokens(text) if self.kind == "treebank" else [t for t in re.findall(r"[^\W_]+", (text or "").lower()) if _ALNUM.search(t)]
        return self.normalize(tokens)

    def tokens(self, text: Column) -> Column:
        """Tokens before normalization."""
        if self.kind == "simple":
            words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
            return F.filter(words, lambda t: t.rlike("[a-z0-9]"))

        def run(texts: pa.Array) -> pa.Array:
            return pa.array(map(treebank_tokens, texts.to_pylist()), _TOKENS)

        return F.arrow_udf(run, "array<string>")(text)

    def terms(self, text: Column) -> Column:
        """Terms in order, with repeats; null text has none."""
        if self.kind == "treebank":

            def run(texts: pa.Array) -> pa.Array:
                return pa.array((self.normalize(treebank_tokens(t)) for t in texts.to_pylist()), _TOKENS)

            return F.arrow_udf(run, "array<string>")(text)
        kept = F.filter(self.tokens(text), self.passes)
        if not self.stemmed:
            return kept

        def stems(tokens: pa.Array) -> pa.Array:
            return pa.array(([s for t in ts if len(s := _stem(t)) >= self.min_length] for ts in tokens.to_pylist()), _TOKENS)

        return F.arrow_udf(stems, "array<string>")(kept)

    def passes(self, token: Column) -> Column:
        """The filters before stemming as a predicate on a token, the cheap ones first."""
        good = F.length(token).between(self.min_length, self.max_length)
        if self.drop_numeric:
            good = good & ~token.rlike("^[0-9]+$")
        return good & ~token.isin(*self.stop_words) if self.stop_words else good


SIMPLE = Analyzer("simple", stemmed=False)
