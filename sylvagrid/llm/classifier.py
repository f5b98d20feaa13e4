"""Quality classifier: supervised subword embeddings.

Features of a document are its words, their character n-grams and its word pairs, hashed
into a table of learned vectors; all pairs of a word with itself are one feature, so a
model can learn that a text repeats words that it has never seen. The mean vector goes through a linear layer and softmax. Vectors
and layer are trained together by stochastic gradient descent in numpy, on at most
FIT_ROWS labelled documents (the smallest hashes of doc_id, so the choice repeats);
their features are counted on the executors and only those counts reach the driver, up to
FIT_BYTES of them. Of rows that share a doc_id the one of the smallest text hash is learned.

Softmax of a mean is linear in the features, so for scoring each table row is folded
into one number; a word's sum is computed once per batch and looked up. Whole texts are
scored, batch by batch. A null or empty text has no features and gets the score of the
bias alone. Labels that are null are ignored, conflicting labels of one id count as the
lower; rows repeat as given and other columns are ignored. Without labels of both kinds
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.llm.common import load, text_slices
from sylvagrid.llm.hashing import MULTIPLIER, gram_hashes, mixed, span_hashes
from sylvagrid.session import stage

# bound of the fitted sample: labelled documents, chosen by hash
FIT_ROWS = 3000
# and bytes of their feature counts that reach the driver, 1 MB a document at most; whole documents, in the same order
FIT_BYTES = 192 << 20
BITS, WIDTH, GRAMS = 17, 8, (2, 3, 4)
EPOCHS, RATE, SEED = 6, 0.6, 11
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def word_features(
    words: list[bytes], bits: int = BITS, grams: tuple[int, ...] = GRAMS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word number) for the word itself and the n-grams of `<word>`, and the hash of each word."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    shift = np.uint64(64 - bits)
    whole = span_hashes(data, ends - size, ends)
    ids, of = [whole >> shift], [np.arange(len(words))]
    for n in grams:
        h = gram_hashes(data, n)
        inside = owner[: len(h)] == owner[n - 1 :][: len(h)]
        ids.append((h[inside] ^ np.uint64(n)) >> shift)
        of.append(owner[: len(h)][inside])
    return np.concatenate(ids).astype(np.int64), np.concatenate(of), whole


def pair_features(whole: np.ndarray, ids: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Feature of each word with the next one."""
    left, right = ids[:-1], ids[1:]
    h = mixed(whole[left] * np.uint64(MULTIPLIER) + whole[right])
    return np.where(left == right, np.uint64(0), h >> np.uint64(64 - bits)).astype(np.int64)


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts in order, and the text of each word."""
    number: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    n = [len(w) for w in words]
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, sum(n))
    return list(number), ids, np.repeat(np.arange(len(texts)), n)


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of one whole text and how often it has them."""
    words, ids, _ = numbered([text])
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    feature, word, whole = word_features(words)
    pairs = pair_features(whole, ids)
    times = np.concatenate([np.bincount(ids, minlength=len(words))[word], np.ones(len(pairs), np.int64)])
    distinct, back = np.unique(np.concatenate([feature, pairs]), return_inverse=True)
    return distinct.astype(np.int32), np.bincount(back, weights=times).astype(np.float32)


class Model:
    """Vectors, layer and bias folded into one weight per feature and one bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, texts: list[bytes]) -> np.ndarray:
        words, ids, doc = numbered(texts)
        logit = np.full(len(texts), self.bias)
        if words:
            feature, word, whole = word_features(words)
            total = np.bincount(word, weights=self.weights[feature], minlength=len(words))
            count = np.bincount(word, minlength=len(words))
            near = doc[:-1] == doc[1:]
            pairs, of = self.weights[pair_features(whole, ids)][near], doc[1:][near]
            sums = np.bincount(doc, weights=total[ids], minlength=len(texts)) + np.bincount(of, weights=pairs, minlength=len(texts))
            n = np.bincount(doc, weights=count[ids], minlength=len(texts)) + np.bincount(of, minlength=len(texts))
            logit += sums / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """SGD over documents in a new random order per epoch; classes weigh alike, the rate falls to zero."""
    labels = np.array([y for *_, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    # rows of the table move by their share of the document times its number of features, up to a bound
    prepared = [(i, c / c.sum()) for i, c, _ in rows if len(i)]
    labels = np.array([y for i, _, y in rows if len(i)])
    steps, step = epochs * len(prepared), 0
    for _ in range(epochs):
        for d in random.permutation(len(prepared)):
            ids, share = prepared[d]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            p *= weight[labels[d]]
            back = p @ layer
            layer -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            vectors[ids] -= (lr / np.sqrt((share * share).sum())) * share[:, None] * back
    fold = layer[1] - layer[0]
    return Model(vectors @ fold, bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from; a null id is never held out, and never labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from at most `rows` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(rows)  # a bounded table
    thin = docs.select("doc_id", F.col("text").cast("binary").alias("t"), F.xxhash64("text").alias("_h"))
    sample = thin.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "_h", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches):
            found = [document_features(t) for t in texts]
            columns = [[i.tobytes() for i, _ in found], [c.tobytes() for _, c in found]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.string()), b["_label"].cast(pa.int32()), b["_h"], *[pa.array(c, pa.binary()) for c in columns]], names=["id", "y", "h", "i", "c"]
            )

    counted = sample.mapInArrow(count, "id string, y int, h long, i binary, c binary")
    # of rows that share an id, the one of the smallest text hash
    one = stage(counted.groupBy("id").agg(F.min_by(F.struct("y", "i", "c"), F.struct("h", "i", "c")).alias("r")).select("id", "r.*"), "counted")
    upto = W.orderBy(F.xxhash64("id", F.lit(SEED)), "id").rowsBetween(W.unboundedPreceding, 0)  # at most `rows` rows
    sized = one.select("id", F.sum(F.octet_length("i") + F.octet_length("c")).over(upto).alias("_upto"))
    got = one.join(sized.where(F.col("_upto") <= FIT_BYTES), "id").select("id", "y", "i", "c").collect()
    got.sort(key=lambda r: r.id)
    return train([(np.frombuffer(r.i, np.int32), np.frombuffer(r.c, np.float32), min(max(r.y, 0), 1)) for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed table of 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(shared.value.score(texts))], names=["doc_id", "score"])

    thin = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    return thin.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
