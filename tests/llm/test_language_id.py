"""Language identification: learning, scoring, calibration and what it may see."""

import random
import zlib

import numpy as np
import pytest

from sylvagrid.llm import language_id as li
from sylvagrid.llm.registry import queries
from tests.llm.fixtures import DOC, rows_of

STEMS = {"aa": "lo ma ni su ra te", "bb": "kz wq xt vr gn hj", "cc": "éa ôu ïe çà ûn ëp"}


def speak(lang, seed, words):
    r = random.Random(seed)
    stems = STEMS[lang].split()
    return " ".join("".join(r.choices(stems, k=r.randint(1, 4))) for _ in range(words))


def corpus(n=600):
    langs = sorted(STEMS)
    return [(i, speak(langs[i % 3], i, 3 + i % 40), langs[i % 3]) for i in range(n)]


def table(spark, rows):
    docs = [(*r[:2], lang, *r[3:]) for r, (*_, lang) in zip(rows_of([(i, t, "s") for i, t, _ in rows]), rows)]
    return spark.createDataFrame(docs, DOC).repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(table(spark, corpus()))


def held(i):
    return zlib.crc32(str(i).encode()) % li.FOLDS == li.HELD_OUT


def test_learns_and_holds_out(spark, model):
    rows = corpus()
    got = {r.doc_id: r for r in li.predict(table(spark, rows), model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if held(i)]
    assert len(right) > 80 and np.mean(right) > 0.98
    # a fit repeats whatever the partitions, and never sees a held-out language
    other = [(i, t, "aa" if held(i) else lang) for i, t, lang in rows]
    again = li.fit(table(spark, other[::-1]).repartition(7))
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.temperature, model.temperature) and again.accept == model.accept


def test_score_is_the_softmax_of_the_mean_vector(model):
    texts = [t.encode() for _, t, _ in corpus(30)] + [b"zz", "Éa ô 12 ".encode() * 50]
    names, scores, _ = li.Scorer(model).predict(texts)
    for text, name, score in zip(texts, names, scores):
        ids, times = li.features_of(li.words_of(text))
        mean = (times @ model.vectors[ids.astype(int)]) / times.sum()
        z = (model.layer @ mean + model.bias) / model.temperature[sum(times.sum() >= x for x in li.LENGTHS)]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-6


def test_words_are_remembered_in_bounds(model, monkeypatch):
    texts = [t.encode() for _, t, _ in corpus(60)]
    want = li.Scorer(model).predict(texts)[1]
    monkeypatch.setattr(li, "REMEMBERED", 20)
    monkeypatch.setattr(li, "AT_ONCE", 64)
    scorer = li.Scorer(model)
    assert np.allclose([scorer.predict([t])[1][0] for t in texts], want)


def test_rejects_what_it_does_not_know(spark, model):
    rows = corpus()
    scorer = li.Scorer(model)
    known = scorer.predict([t.encode() for i, t, _ in rows if held(i)])[2]
    mixed = [(speak("aa", i, 6) + " " + speak("bb", i, 6)).encode() for i in range(60)]
    assert known.mean() > 0.8 and scorer.predict(mixed)[2].mean() < known.mean() - 0.2


def test_calibration_bounds_the_errors():
    rng = np.random.default_rng(5)
    model = li.Model(["a", "b"], np.zeros((1 << li.BITS, li.WIDTH), np.float32), np.zeros((2, li.WIDTH), np.float32), np.zeros(2, np.float32))
    # feature k has the logit k / 100 - 10; the truth follows a softmax at three times that temperature
    z = np.arange(2000) / 100 - 10
    model.vectors[:2000, 0], model.layer[1, 0] = z, 1
    ks = rng.integers(0, 2000, 6000)
    truth = (rng.random(6000) < 1 / (1 + np.exp(-z[ks] / 3))).astype(int)
    examples = [li.Example(np.array([k], np.uint16), np.ones(1, np.float32), int(y)) for k, y in zip(ks, truth)]
    li.calibrate(model, examples, errors=0.15)
    assert model.temperature[0] == pytest.approx(3, rel=0.15)
    p = model.probabilities(np.column_stack([np.zeros(6000), z[ks]]), np.ones(6000))
    taken = p.max(axis=1) >= model.accept
    assert taken.mean() > 0.2 and np.mean(p.argmax(axis=1)[taken] != truth[taken]) <= 0.15


def test_odd_documents(spark, docs, no_docs, texts, model):
    got = li.predict(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "accepted"] and got.count() == len(texts)
    none = {i for i, t, _ in texts if i is not None and not any(map(str.isalpha, t or ""))}
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == none
    assert got.where("lang_pred = 'und' AND (score <> 0 OR accepted)").count() == 0
    assert li.predict(no_docs, model).count() == 0
    empty = li.fit(no_docs)
    assert {r.lang_pred for r in li.predict(docs, empty).collect()} == {"und"}
    one = li.fit(docs)  # every language is `en`
    assert {(r.lang_pred, r.score) for r in li.predict(docs, one).collect()} == {("und", 0.0), ("en", 1.0)}


def test_long_runs_are_whole(model, monkeypatch):
    monkeypatch.setattr(li, "LONG", 10)
    assert li.words_of(b"ab " + b"x" * 25) == [b"ab", b"x" * 10, b"x" * 10, b"x" * 5]
    assert li.Scorer(model).predict([b"q" * 100_000])[1][0] > 0


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "lo ma ni", "aa") for i in range(3000)] + [(5000 + i, speak("bb", i, 9), "bb") for i in range(400)]
    chosen = li.sample_texts(table(spark, rows), rows=100).select("_h", "_lang").distinct().collect()
    assert sum(r["_lang"] == "aa" for r in chosen) == 1 and sum(r["_lang"] == "bb" for r in chosen) == 50


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op13_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred)) a", "min(score) lo", "max(score) hi").first()
    assert right.a > 0.99 and 0 <= right.lo and right.hi <= 1
