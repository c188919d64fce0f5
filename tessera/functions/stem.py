"""The English Snowball stemmer (Porter2), after its published definition."""

from __future__ import annotations

# Fixed values of the published algorithm.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_BEFORE_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_FIXED_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_PREFIXES = ("gener", "commun", "arsen")
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _after_syllable(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word; letters are taken in lower case."""
    word = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    marked = list(word)
    for i, c in enumerate(marked):
        if c == "y" and (i == 0 or marked[i - 1] in _VOWELS):
            marked[i] = "Y"
    word = "".join(marked)
    prefix = next((p for p in _PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after_syllable(word, 0)
    r2 = _after_syllable(word, r1)
    for mark in ("'s'", "'s", "'"):
        if word.endswith(mark):
            word = word[: -len(mark)]
            break
    word = _plural(word)
    if word in _FIXED_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _step2(word, r1)
    word = _step3(word, r1, r2)
    word = _step4(word, r2)
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if _has_vowel(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    rest = word[: -len(suffix)]
    if suffix.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not _has_vowel(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(_DOUBLES):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _short_end(rest) else rest


def _step2(word: str, r1: int) -> str:
    suffix = _longest(word, _STEP2)
    if suffix is None:
        return word
    rest = word[: -len(suffix)]
    if len(rest) < r1 or suffix == "ogi" and not rest.endswith("l") or suffix == "li" and not (rest and rest[-1] in _BEFORE_LI):
        return word
    return rest + _STEP2[suffix]


def _step3(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, _STEP3)
    if suffix is None:
        return word
    rest = word[: -len(suffix)]
    return rest + _STEP3[suffix] if len(rest) >= (r2 if suffix == "ative" else r1) else word


def _step4(word: str, r2: int) -> str:
    suffix = _longest(word, _STEP4)
    if suffix is None:
        return word
    rest = word[: -len(suffix)]
    return rest if len(rest) >= r2 and (suffix != "ion" or rest.endswith(("s", "t"))) else word
