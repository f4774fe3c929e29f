import random

import numpy as np
import pytest

from nodetide.llm import langid

WORDS = {"en": "the of and with that from this they would have", "de": "der die und nicht eine über für können straße", "fr": "les des être avoir où déjà même était près"}


def corpus(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(5, 60))), lang, "src"))
    return out


SCHEMA = "doc_id long, text string, lang string, score string"


def slow_grams(text):
    """Sorted columns, one gram after the other."""
    folded, out = [langid.SPACE], []
    for c in text + " ":
        f = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else langid.SPACE
        if f != langid.SPACE or folded[-1] != langid.SPACE:
            folded.append(f)
    for n, mix in enumerate(langid.MIX, 1):
        for i in range(n == 1, len(folded) - n + 1):  # the leading space is no gram of its own
            h = sum(c * m for c, m in zip(folded[i:i + n], mix)) % 2**32
            h ^= h >> 15
            h = h * 2246822519 % 2**32
            out.append(h >> 16)
    return sorted(out)


def test_grams_match_a_plain_version(monkeypatch):
    text = "Où  est—la straße? 12 km,\n\nÜBER alles   weg"
    whole = sorted(np.concatenate(list(langid.grams(text))).tolist())
    assert whole == slow_grams(text)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "SLICE", size)
        assert sorted(np.concatenate(list(langid.grams(text))).tolist()) == whole
    assert list(langid.grams("12 !? \n")) == [] and list(langid.grams("")) == []


def test_held_out_accuracy_and_defined_results(spark):
    rows = corpus() + [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "123 456 !!", None, "a"), (1003, "und nicht die straße " * 20000, None, "a"),
                       (None, "les des être avoir déjà", "fr", "a"), (7, "the of and with", None, "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs.where(~langid.held_out()))
    assert model.langs == ("de", "en", "fr")
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    held = [(r, by[r[0]]) for r in rows[:240] if r[0] != 7 and by[r[0]].held_out]
    assert len(held) > 20 and np.mean([p.lang_pred == r[2] for r, p in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "fr"]
    assert by[None].held_out
    kept = {r.doc_id for r in langid.accepted(docs, model).collect()}
    assert not kept & {1000, 1001, 1002} and kept >= set(range(240))


def test_prediction_ignores_language_source_and_id(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.train(docs.where(~langid.held_out()))
    a = langid.identify("the of and über", model)
    moved = spark.createDataFrame([(99, "the of and über", "fr", "z")], SCHEMA)
    r = langid.predict(moved, model).first()
    assert (r.lang_pred, r.score) == a


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a"), (2, None, "en", "a")], SCHEMA)
    model = langid.train(docs)
    assert model is None
    assert [r.lang_pred for r in langid.predict(docs, model).collect()] == ["und", "und"]
    empty = docs.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_calibration_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) * 8
    logits[np.arange(400), y] += 4
    t = langid.calibrate(logits, y)

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(1, keepdims=True))
        return -np.log(e[np.arange(400), y] / e.sum(1)).mean()

    assert loss(t) < loss(1.0) and loss(t) <= min(loss(x) for x in np.linspace(0.5, 20, 60)) + 1e-3


@pytest.mark.parametrize("lang", sorted(WORDS))
def test_one_language(spark, lang):
    docs = spark.createDataFrame([(i, WORDS[lang], lang, "s") for i in range(10)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs)).collect()} == {(lang, 1.0)}
