"""Quality classifier: learning, scoring and what it may see."""

import zlib

import numpy as np

from sylvagrid.llm import classifier as qc
from sylvagrid.llm.registry import queries
from tests.llm.fixtures import DOC, prose, rows_of


def junk(i):
    return [f"{w} " * 60 for w in ("Wow",)][0] + prose(i, 5) if i % 2 else " ".join(f"{w}$$$" for w in prose(i, 50).split())


def corpus():
    return [(i, prose(i, 60) if i % 3 else junk(i), "s") for i in range(400)]


def test_learns_and_holds_out(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows_of(rows), DOC).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i, *_ in rows] + [(None, 1, 0, "x"), (5, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = qc.fit(docs, labels)
    scores = {r.doc_id: r.score for r in qc.score(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scores[i] >= qc.THRESHOLD) == (i % 3 > 0) for i in held]) > 0.97
    # a fit repeats, and never sees a held-out label
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality")
    again = qc.fit(docs, flipped)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_fit_repeats_with_repeated_ids_and_stays_in_its_bytes(spark, monkeypatch):
    rows = [(i % 80, prose(i, 40) if i % 80 % 3 else junk(i), "s") for i in range(160)]  # two texts for every id
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    fits = [qc.fit(spark.createDataFrame(rows_of(r), DOC).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(fits[0].weights, fits[1].weights) and fits[0].bias == fits[1].bias
    seen = []
    monkeypatch.setattr(qc, "train", lambda got: seen.append(got))
    monkeypatch.setattr(qc, "FIT_BYTES", 20_000)
    qc.fit(spark.createDataFrame(rows_of(rows), DOC), labels)
    assert 2 < len(seen[0]) < 60 and sum(i.nbytes + c.nbytes for i, c, _ in seen[0]) <= 20_000


def test_score_is_the_softmax_of_the_mean_vector():
    rows = [(*qc.document_features(t.encode()), int(i % 3 > 0)) for i, t, _ in corpus()[:60]]
    model = qc.train(rows, epochs=2)
    texts = [prose(9, 80).encode(), b"", b"a", prose(3, 3000).encode()]
    got = model.score(texts)
    for text, s in zip(texts, got):
        ids, n = qc.document_features(text)
        logit = model.bias + ((n * model.weights[ids]).sum() / n.sum() if len(ids) else 0)
        assert abs(s - 1 / (1 + np.exp(-logit))) < 1e-4


def test_odd_documents_and_missing_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = qc.fit(docs, none)
    assert {r.score for r in qc.score(docs, model).collect()} == {0.5}
    assert qc.score(docs, model).count() == docs.count() and qc.score(no_docs, model).count() == 0


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op3_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    right = got.where("held_out").join(labels, "doc_id").selectExpr("avg(int(predicted = quality)) a", "min(score) lo", "max(score) hi").first()
    assert right.a > 0.97 and 0 <= right.lo and right.hi <= 1
