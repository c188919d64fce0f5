from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid

from .helpers import awkward, docs_table, prose

SYLLABLES = {"en": "th ing er and ou st re".split(), "de": "sch ung ein ver keit ü ß".split(), "fr": "eau ou tion ai é ç le".split()}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def models():
    rng = random.Random(11)
    return langid.fit([(lang, invented(rng, lang, 80)) for lang in SYLLABLES for _ in range(40)])


def test_letters():
    assert "".join(chr(c) if c else "_" for c in langid.letters("  Ab, 12c!\n")) == "_ab_c_"
    assert len(langid.letters("12 !")) == len(langid.letters("")) == 0


def reference(texts, order=4):
    """Interpolated Kneser-Ney by its definition, over dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = [0] * (order - 2) + langid.letters(t).tolist()
        for i in range(len(padded) - order + 1):
            counts[order][tuple(padded[i : i + order])] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    symbols = len({c for t in texts for c in langid.letters(t).tolist()} - {0}) + 0

    def prob(gram):
        k = len(gram)
        if not k:
            return None
        once, twice = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        less = once / (once + 2 * twice) if once and twice else 0.5
        context = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        lower = prob(gram[1:]) if k > 1 else 1 / (symbols + 1 + 2)
        if not context:
            return lower
        total = sum(context.values())
        return max(counts[k][gram] - less, 0) / total + less * len(context) / total * lower

    return prob


def test_probabilities():
    rng = random.Random(12)
    train = [invented(rng, "en", 12) for _ in range(4)]
    models = langid.fit([("en", t) for t in train])
    prob = reference(train)
    for text in (train[0][:30], "thing xyz ß", "quite another"):
        chars = np.concatenate([np.zeros(2, np.uint32), langid.letters(text)])
        got = models.log_probs(models.ids(chars))[:, 0]
        known = set(np.unique(np.concatenate([langid.letters(t) for t in train])).tolist())
        grams = [tuple(c if c in known else -1 for c in chars[i : i + 4].tolist()) for i in range(len(chars) - 3)]
        assert got == pytest.approx([math.log(prob(g)) for g in grams], rel=1e-4)


def test_predict(models):
    rng = random.Random(13)
    for lang in SYLLABLES:
        for found in models.predict([invented(rng, lang, n) for n in (4, 10, 300)]):
            assert found[0] == lang and 0 <= found[1] <= 1 and not found[3]
    assert models.predict([None, "", "12 34 !", "語語語語 " * 200]) [:3] == [("und", 0.0, None, True)] * 3
    assert models.predict(["語漢字仮名 " * 200])[0][3]
    assert models.predict(["\ud800 x"])[0][0] != "und"


def test_hash_array():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    table = langid.HashArray(grams, np.arange(len(grams)))
    rows = table.find(grams)
    assert (table.values[rows] == np.arange(len(grams))).all() and (table.find(grams + np.uint64(1 << 50)) == -1).all()
    assert (langid.HashArray(grams[:0], grams[:0]).find(grams) == -1).all()


def test_identify(spark):
    rng = random.Random(14)
    rows = awkward(rng) + [(100 + i, invented(rng, lang, 60), lang if i % 9 else None, "a") for i, lang in enumerate(list(SYLLABLES) * 40)]
    table = docs_table(spark, rows)
    models = langid.train(table)
    found = langid.identify(table, models).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].lang_pred for i in (0, 1, 2, 7)} == {"und"}
    right = [by_id[100 + i].lang_pred == lang for i, lang in enumerate(list(SYLLABLES) * 40)]
    assert sum(right) >= 0.97 * len(right)
    stay = langid.keep_known(table, models)
    assert stay.columns == table.columns and {r.doc_id for r in stay.select("doc_id").collect()} >= {100 + i for i in range(120)}
    assert langid.identify(docs_table(spark, []), models).count() == 0


def test_nothing_learned(spark):
    table = docs_table(spark, [(1, "some text", None, "a"), (2, None, "en", "a")])
    assert {r.lang_pred for r in langid.identify(table, langid.train(table)).collect()} == {"und"}


def test_training_rows(spark):
    ids = list(range(200))
    table = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id for r in table.filter(langid.in_training(table.doc_id)).collect()}
    assert got == {i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2}


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    found = langid.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r.lang_pred == labels[r.doc_id] for r in found if r.held_out]
    assert len(found) == len(labels) and np.mean(held) >= 0.98
    by_lang = defaultdict(int)
    for r in found:
        by_lang[r.rejected] += 1
    assert by_lang[True] <= 0.005 * len(found)


def test_long_texts_train(spark):
    rng = random.Random(17)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, invented(rng, "de", 60) if n % 2 else invented(rng, "fr", 300), "de" if n % 2 else "fr", "a") for n, i in enumerate(ids)]
    models = langid.train(docs_table(spark, rows), sample_chars=1000)
    assert models.langs == ["de", "fr"] and models.predict([invented(rng, "fr", 80)])[0][0] == "fr"
    text = "".join(chr(0x100 + i) for i in range(5000))
    kept = docs_table(spark, [(1, text, "x", "a"), (2, text[:1000], "x", "a")]).select("doc_id", langid.spread(F.col("text"), 1000).alias("t")).collect()
    kept = {r.doc_id: r.t for r in kept}
    assert kept[2] == text[:1000] and len(kept[1].split(" ")) == langid.SPANS and kept[1][:50] == text[:50] and kept[1][-50:] == text[-50:]
    assert len(kept[1].replace(" ", "")) == 1000


def test_repeated_rows(spark, monkeypatch):
    """One row, repeated more often than the sample is large, leaves all languages their texts."""
    rng = random.Random(18)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 60)
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda labelled: fitted.extend(labelled))
    rows = [(ids[0], "again and again", "en", "a")] * 3000 + [(i, invented(rng, lang, 9), lang, "a") for i, lang in zip(ids[1:], list(SYLLABLES) * 100, strict=False)]
    langid.train(docs_table(spark, rows))
    by = Counter(lang for lang, _ in fitted)
    assert set(by) == set(SYLLABLES) and min(by.values()) >= 15 and max(Counter(fitted).values()) == 1


def test_sample_bounds():
    assert (langid.SAMPLE_DOCS, langid.SAMPLE_TOTAL) == (1500, 12000)


def test_counted_in_parts(monkeypatch):
    rng = random.Random(19)
    labelled = [(lang, invented(rng, lang, 40)) for lang in SYLLABLES for _ in range(12)]
    whole = langid.fit(labelled)
    monkeypatch.setattr(langid, "SCORE_CHARS", 150)
    monkeypatch.setattr(langid, "COUNT_CHARS", 150)
    parts = langid.fit(iter(labelled))
    assert (whole.alphabet == parts.alphabet).all() and whole.sharpness == parts.sharpness
    for a, b in zip([*whole.grams, *whole.contexts], [*parts.grams, *parts.contexts], strict=True):
        assert (a.hashes == b.hashes).all() and (a.values == b.values).all()
