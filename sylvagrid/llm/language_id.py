"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Features of a text are its words and the character n-grams of `<word>`, hashed into a table of
learned vectors. A word is a run without ASCII white space, digits and punctuation; A-Z are
lower-cased. The mean vector of a text goes through a linear layer and softmax. Table and layer
are trained together by stochastic gradient descent in numpy, each sampled document once whole
and once as a short passage of it, so that short texts are learned too.

Two parts of the sample by hash: one trains, the other calibrates. On the second a temperature
per class of text length is fitted to the likelihood (a mean over few features is overconfident),
and then the lowest score is found from which on the accepted share of errors, by its upper
confidence bound, is at most `ERRORS`. Predictions below it are not `accepted`: they keep their
language and score, so that a caller decides what to do with them.

Bounds of the fit, whatever the input: FIT_ROWS documents, spread evenly over the languages and chosen
by text hash (copies of a text count once), and FIT_BYTES of feature counts on the driver. Every
document is scored whole, batch by batch; the model is a table of fixed size.

Nulls and odd cases: a null text, or one without a letter, is `und` with score 0 and not accepted.
Documents without a language, or without an id, are not learned from, but predicted. Texts alike
under several languages are learned with the smallest name. A word of over 65,536 bytes counts as several. Rows repeat as given, ties go to the
first language by name, other columns are ignored, and the columns of the result cannot clash with
them. An empty table gives an empty one. With no learnable row all texts are `und`; with one
language every text with a letter gets it. Texts of any length are counted word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.llm.common import load, text_slices
from sylvagrid.llm.hashing import gram_hashes, span_hashes

FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
# bounds of the sample: documents, and bytes of feature counts that reach the driver
FIT_ROWS, FIT_BYTES = 3_000, 48 << 20
BITS, WIDTH, GRAMS = 15, 16, (2, 3, 4, 5)
EPOCHS, RATE, SEED = 5, 0.5, 7
# words of the short passages, and the share of the sample that calibrates
SHORT, CALIBRATE = (2, 12), 0.3
# accepted predictions may err so often; limits of the classes of text length, in features
ERRORS, LENGTHS = 0.01, (40, 200, 2000)
# a run longer than so many bytes counts as several words; bytes of words whose features are hashed at once
LONG, AT_ONCE = 1 << 16, 1 << 20
# words whose vector a Python worker remembers
REMEMBERED = 1 << 17

NOT_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTERS = bytes(c for c in range(128) if chr(c).isalpha())


def has_letter(text: bytes) -> bool:
    """Any code point of the Unicode categories of letters."""
    if len(text.translate(None, LETTERS)) < len(text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(NOT_LETTERS).split()
    if words and len(max(words, key=len)) > LONG:
        return [w[at : at + LONG] for w in words for at in range(0, len(w), LONG)]
    return words


def by_size(words: list[bytes], most: int = AT_ONCE) -> Iterator[list[bytes]]:
    """The words in parts of about `most` bytes."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of its word), the features of a word side by side: itself, and the n-grams of `<word>`."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    shift = np.uint64(64 - BITS)
    ids, of = [span_hashes(data, ends - size, ends) >> shift], [np.arange(len(words))]
    for n in GRAMS:
        h = gram_hashes(data, n)
        inside = owner[: len(h)] == owner[n - 1 :][: len(h)]
        ids.append((h[inside] ^ np.uint64(n * 0x9E3779B1)) >> shift)
        of.append(owner[: len(h)][inside])
    ids, of = np.concatenate(ids).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order], of[order]


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often it has them."""
    n, number = np.zeros(1 << BITS), Counter(words)
    for part in by_size(list(number)):
        feature, of = subwords(part)
        n += np.bincount(feature, weights=np.array([number[w] for w in part])[of], minlength=1 << BITS)
    kept = np.flatnonzero(n)
    return kept.astype(np.uint16), n[kept].astype(np.float32)


class Example(NamedTuple):
    features: np.ndarray
    times: np.ndarray
    label: int


class Model:
    """Languages, vectors, layer and calibration. Scores whole texts."""

    def __init__(self, languages: list[str], vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.languages, self.vectors, self.layer, self.bias = languages, vectors, layer, bias
        self.temperature = np.ones(len(LENGTHS) + 1)
        self.accept = 0.0

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        return hidden @ self.layer.T + self.bias

    def probabilities(self, logits: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = logits / self.temperature[np.searchsorted(LENGTHS, n, side="right")][:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


class Scorer:
    """Predictions of a model; the vector sums of frequent words are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[bytes, int] = {}
        self.sums = np.zeros((0, WIDTH + 1), np.float64)

    def _learn(self, words: list[bytes]) -> None:
        """Remember sum of vectors and number of features of new words."""
        feature, of = subwords(words)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        rows = np.add.reduceat(self.model.vectors[feature], starts, axis=0, dtype=np.float64)
        count = np.diff(np.append(starts, len(of)))
        self.at.update(zip(words, range(len(self.sums), len(self.sums) + len(words))))
        self.sums = np.concatenate([self.sums, np.column_stack([rows, count])])

    def hidden(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean vector and number of features of each text."""
        words = [words_of(t) for t in texts]
        new = list({w: None for ws in words for w in ws if w not in self.at})
        if len(self.at) + len(new) > REMEMBERED:
            self.at, self.sums = {}, self.sums[:0]
            new = list({w: None for ws in words for w in ws})
        for part in by_size(new):
            self._learn(part)
        n = np.array([len(w) for w in words], np.int64)
        at = self.at
        ids = np.fromiter((at[w] for ws in words for w in ws), np.int64, int(n.sum()))
        total = np.zeros((len(texts), WIDTH + 1))
        full = np.flatnonzero(n)
        if len(full):
            total[full] = np.add.reduceat(self.sums[ids], (np.cumsum(n) - n)[full], axis=0)
        return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1].astype(np.int64)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        known = np.array([has_letter(t) for t in texts], bool) & bool(self.model.languages)
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), known
        hidden, n = self.hidden(texts)
        p = self.model.probabilities(self.model.logits(hidden), n)
        score = np.where(known, p.max(axis=1), 0.0)
        names = [self.model.languages[i] if k else UNKNOWN for i, k in zip(p.argmax(axis=1), known)]
        return names, score, known & (score >= self.model.accept)


def train(examples: list[Example], languages: list[str]) -> Model:
    """SGD over the examples in a new random order per epoch; languages weigh alike, the rate falls to zero."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((len(languages), WIDTH), np.float32), np.zeros(len(languages), np.float32)
    prepared = [(e.features.astype(np.int64), e.times / e.times.sum(), e.label) for e in examples if len(e.features)]
    if len(languages) > 1 and prepared:
        counts = np.bincount([y for *_, y in prepared], minlength=len(languages))
        weight = len(prepared) / (len(languages) * np.maximum(counts, 1))
        steps, step = EPOCHS * len(prepared), 0
        for _ in range(EPOCHS):
            for d in random.permutation(len(prepared)):
                ids, share, label = prepared[d]
                lr = RATE * (1 - step / steps)
                step += 1
                hidden = share @ vectors[ids]
                z = layer @ hidden + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                p *= min(weight[label], 10.0)
                back = p @ layer
                layer -= lr * np.outer(p, hidden)
                bias -= lr * 0.05 * p
                # a text of many features moves each of them less; scaled so that its mean vector moves alike
                vectors[ids] -= (lr / np.sqrt((share * share).sum())) * share[:, None] * back
    return Model(languages, vectors, layer, bias)


def upper_bound(errors: np.ndarray, n: np.ndarray, z: float = 1.64) -> np.ndarray:
    """Upper confidence bound of a share (Wilson)."""
    p = errors / n
    return (p + z * z / (2 * n) + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def calibrate(model: Model, examples: list[Example], errors: float = ERRORS) -> Model:
    """Set temperatures and the lowest accepted score from examples that training has not seen."""
    examples = [e for e in examples if len(e.features)]
    if len(model.languages) < 2 or not examples:
        return model
    hidden = np.array([(e.times / e.times.sum()) @ model.vectors[e.features.astype(np.int64)] for e in examples])
    n = np.array([int(e.times.sum()) for e in examples])
    label = np.array([e.label for e in examples])
    logits, group = model.logits(hidden), np.searchsorted(LENGTHS, n, side="right")
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 121))

    def loss(t: float, part: np.ndarray) -> float:
        z = logits[part] / t
        return float((np.logaddexp.reduce(z, axis=1) - z[np.arange(len(z)), label[part]]).sum())

    everything = np.arange(len(examples))
    general = min(grid, key=lambda t: loss(t, everything))
    for g in range(len(LENGTHS) + 1):
        part = np.flatnonzero(group == g)
        model.temperature[g] = min(grid, key=lambda t: loss(t, part)) if len(part) >= 50 else general
    p = model.probabilities(logits, n)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != label
    order = np.argsort(-score, kind="stable")
    bound = upper_bound(np.cumsum(wrong[order]), np.arange(1, len(order) + 1))
    ends = np.append(np.diff(score[order]) != 0, True)  # equal scores are accepted or rejected together
    good = np.flatnonzero((bound <= errors) & ends)
    model.accept = float(score[order][good[-1]]) if len(good) else float(np.nextafter(1.0, 2.0))
    return model


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from; a null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample_texts(docs: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> DataFrame:
    """(lang, hash, text) of the documents to learn from, at most `rows`, spread evenly over the languages.

    Distinct texts per language are counted by a sketch of fixed size, a share of the hashes is
    taken by it, and the smallest hashes of that share are the sample.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    thin = known.select(F.col("lang").alias("_lang"), F.xxhash64("text").alias("_h"), F.length("text").alias("_n"))
    counts = thin.groupBy("_lang").agg(F.approx_count_distinct("_h").alias("_d"))
    each = F.greatest(F.floor(F.lit(rows) / counts.agg(F.count(F.lit(1))).scalar()), F.lit(1))
    # expected three times the wanted number, so that the limit below is reached
    share = F.least(F.lit(1.0), (3 * each + 50) / F.col("_d"))
    counts = counts.select("_lang", each.alias("_each"), share.alias("_share"))
    place = F.pmod(F.xxhash64("_h", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    chosen = thin.join(counts, "_lang").where(place < F.col("_share")).groupBy("_h").agg(F.min("_lang").alias("_lang"), F.first("_each").alias("_each"), F.max("_n").alias("_n"))
    order = W.partitionBy("_lang").orderBy(F.xxhash64("_h", F.lit(SEED)), "_h")
    chosen = chosen.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("_each"))
    # a feature count takes 6 bytes, and a text has at most some features per character
    cost = F.least(F.col("_n") * (len(GRAMS) + 1), F.lit(1 << BITS)) * 6
    chosen = chosen.withColumn("_sum", F.sum(cost).over(W.orderBy("_at", "_lang").rowsBetween(W.unboundedPreceding, 0)))
    chosen = chosen.where((F.col("_sum") <= size) | (F.col("_at") == 1)).select("_h", "_lang").limit(rows)
    texts = known.select(F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("t"))
    return texts.join(F.broadcast(chosen), "_h")  # at most `rows` rows of 8 bytes and a name


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn and calibrate a model on at most `rows` documents that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b, texts in text_slices(batches):
            out: dict[str, list] = {"lang": [], "h": [], "part": [], "i": [], "c": []}
            for lang, h, text in zip(b["_lang"].to_pylist(), b["_h"].to_pylist(), texts):
                if h in done:  # copies of a text within the task
                    continue
                done.add(h)
                words = words_of(text)
                random = np.random.default_rng(h & ((1 << 63) - 1))
                some = int(random.integers(*SHORT))
                start = int(random.integers(0, max(1, len(words) - some + 1)))
                for part, chosen in ((0, words), (1, words[start : start + some])):
                    ids, times = features_of(chosen)
                    for name, value in zip(out, (lang, h, part, ids.tobytes(), times.tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=list(out)
            )

    counted = sample_texts(docs, rows).mapInArrow(count, "lang string, h long, part int, i binary, c binary")
    # bounded by FIT_ROWS and FIT_BYTES; copies of a text in other tasks go here
    got = counted.groupBy("h", "part").agg(F.first("lang").alias("lang"), F.first("i").alias("i"), F.first("c").alias("c")).collect()
    got.sort(key=lambda r: (r.h, r.part))
    languages = sorted({r.lang for r in got})
    number = {lang: k for k, lang in enumerate(languages)}
    split: tuple[list[Example], list[Example]] = ([], [])
    for r in got:
        example = Example(np.frombuffer(r.i, np.uint16), np.frombuffer(r.c, np.float32), number[r.lang])
        split[(r.h * 0x9E3779B97F4A7C15 >> 20) % 1000 < 1000 * CALIBRATE].append(example)
    return calibrate(train(split[0], languages), split[1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size and a row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b, texts in text_slices(batches):
            names, score, accepted = scorer.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"]
            )

    thin = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    return thin.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
