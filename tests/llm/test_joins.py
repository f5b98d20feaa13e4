"""Jaccard join, components and suffix dedup against all pairs and all windows."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from sylvagrid.llm import jaccard_join as jj
from sylvagrid.llm import suffix_dedup as sd
from sylvagrid.llm.common import KEY, row_key
from sylvagrid.llm.components import components
from tests.llm import plain
from tests.llm.fixtures import DOC, edited, prose, rows_of


def keyed(docs):
    return {(r[0], r[1]): r[2] for r in docs.select(*row_key(), "text").collect()}


def check_classes(docs, k, similarity):
    want, sizes = plain.classes(keyed(docs), k, similarity.numerator, similarity.denominator)
    got = jj.document_classes(docs, k, similarity).collect()
    assert len(got) == docs.count()
    for r in got:
        key = (r[KEY[0]], r[KEY[1]])
        assert (r.n, r.component[0]) == (sizes[key], want[key][0]), key
    return want


@pytest.mark.parametrize("k, similarity", [(4, Fraction(85, 100)), (5, Fraction(80, 100)), (2, Fraction(1, 2))])
def test_classes_equal_all_pairs(docs, k, similarity):
    check_classes(docs, k, similarity)


def test_word_hashes_follow_the_words():
    from sylvagrid.llm.hashing import LONG_WORD, word_hashes

    r = random.Random(5)
    alphabet = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u3000", "a", "A", "b", "é", "\x00", "\xa0"]
    long = ["w" * n for n in range(LONG_WORD - 2, LONG_WORD + 3)] + ["W" * 500, "w" * 499 + "v"]
    texts = [t.encode() for t in ["", " ", *long, *("".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(400)), prose(1, 90)]]
    h, n = word_hashes(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    # equal words and no others have equal hashes
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    assert word_hashes([])[0].tolist() == word_hashes([])[1].tolist() == []


def test_large_group_of_near_copies(spark):
    base = prose(70, 147)
    texts = [(i, edited(base, i, i % 9), "s") for i in range(150)] + [(200 + i, edited(base, 5, 1) + " tail" * i, "s") for i in range(4)]
    check_classes(spark.createDataFrame(rows_of(texts), DOC).repartition(5), 4, Fraction(85, 100))


def test_chains_are_followed(spark):
    # each text differs a little from the next one, and much from the last one
    words = [f"w{i}" for i in range(400)]
    texts = [(50 - i, " ".join(words[4 * i : 4 * i + 120]), "s") for i in range(40)]
    want = check_classes(spark.createDataFrame(rows_of(texts), DOC), 3, Fraction(85, 100))
    assert len({v for v in want.values()}) == 1


def test_one_of_each_group_stays(docs, no_docs):
    out = jj.keep_one_of_each(docs, 4, Fraction(85, 100))
    want, _ = plain.classes(keyed(docs), 4, 85, 100)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.select(*row_key()).collect()} == set(want.values())
    assert jj.document_classes(no_docs).count() == jj.keep_one_of_each(no_docs).count() == 0


def test_one_of_repeated_rows_stays(spark):
    texts = [(1, prose(1, 40), "s"), (1, prose(1, 40), "s"), (2, prose(1, 40), "s"), (3, prose(2, 40), "s"), (None, None, "s"), (None, None, "s")]
    out = jj.keep_one_of_each(spark.createDataFrame(rows_of(texts), DOC).repartition(3))
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3]


def test_sketch_changes_no_link(docs, monkeypatch):
    before = Counter(map(str, jj.document_classes(docs).collect()))
    monkeypatch.setattr(jj, "frequency_sketch", lambda d, k: np.random.default_rng(3).integers(0, 9, 1 << jj.SKETCH_BITS))
    assert Counter(map(str, jj.document_classes(docs).collect())) == before


def test_components_equal_union_find(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(450, 499)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for ab in links for x in ab}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {n: p for n, p in parent.items() if any(a != b and n in (a, b) for a, b in links)}


@pytest.mark.parametrize("length", [100, 40])
def test_removed_bytes_equal_all_windows(docs, length):
    gram = 20 if length == 100 else 8
    want = plain.repeats(keyed(docs), length)
    left = sd.remaining(docs, length, gram).collect()
    got = Counter()
    import hashlib

    for r in left:
        removed = sum(e - s for s, e in zip(r.starts or [], r.ends or []))
        got[r.doc_id, len(r.kept) + removed, removed, len(r.starts or []), hashlib.sha256(r.kept).hexdigest()] += 1
    counts = Counter(tuple(r) for r in docs.select(*row_key()).collect())
    expected = Counter()
    for key, n in counts.items():
        expected[(key[0], *want[key])] += n
    assert got == expected


def test_hot_grams_take_two_steps(docs, monkeypatch):
    one = {str(r) for r in sd.repeated_spans(docs).collect()}
    monkeypatch.setattr(sd, "HOT", 3)
    monkeypatch.setattr(sd, "SHARD", 2000)
    monkeypatch.setattr(sd, "BLOCK", 1000)
    monkeypatch.setattr(sd, "BROADCAST_GRAMS", 0)
    assert {str(r) for r in sd.repeated_spans(docs).collect()} == one


def test_no_task_takes_all_runs_of_a_hot_gram(spark, monkeypatch):
    # one phrase, each time in other surroundings, some of them with a window in common
    texts = [(i, prose(900 + i, 8) + " a phrase that many of the documents contain, in other surroundings each time " + prose(940 + i // 2, 30), "s") for i in range(30)]
    hot = spark.createDataFrame(rows_of(texts), DOC).repartition(3)
    monkeypatch.setattr(sd, "HOT", 5)
    taken, settled = [], sd.settled
    monkeypatch.setattr(sd, "settled", lambda c, *a: taken.append(c.groupBy("gram").count().agg(F.max("count")).first()[0] or 0) or settled(c, *a))
    want = plain.repeats(keyed(hot))
    got = {r.doc_id: sum(e - s for s, e in zip(r.starts or [], r.ends or [])) for r in sd.remaining(hot).collect()}
    assert got == {key[0]: w[1] for key, w in want.items()} and any(got.values())
    assert max(taken) <= 5


def test_runs_are_the_same_in_pieces(monkeypatch):
    x = np.frombuffer(prose(3, 4000).encode(), np.uint8)
    windows = {}
    for bits in (23, 10):
        monkeypatch.setattr(sd, "PIECE_BITS", bits)
        start, end, place, h = sd.window_runs(x, np.zeros(len(x), np.int32), 100, 20)
        windows[bits] = {(s, int(p), int(g)) for lo, hi, p, g in zip(start, end, place, h) for s in range(lo, hi - 99)}
    assert windows[23] == windows[10] and len(windows[23]) == len(x) - 99


def test_common_prefixes_of_a_merge():
    texts = [b"abcdefgh" * 16, b"zz" + b"abcdefgh" * 15 + b"qq", bytes(range(65, 91)) * 5]
    cut, again = sd.repeated_windows(texts, np.arange(3) << 32, np.ones(sum(len(t) - 99 for t in texts), np.int64), 100)
    seen, want = set(), []
    for t in texts:
        for p in range(len(t) - 99):
            want.append(t[p : p + 100] in seen)
            seen.add(t[p : p + 100])
    assert cut.tolist() == want
    windows = [t[p : p + 100] for t in texts for p in range(len(t) - 99)]
    assert again.tolist() == [windows.count(w) > 1 for w in windows]
    # a single text that occurs often repeats everywhere, and holds no earlier window of its own
    alone = sd.repeated_windows([bytes(range(33, 140))], np.zeros(1, np.int64), np.full(8, 3), 100)
    assert [x.tolist() for x in alone] == [[False] * 8, [True] * 8]


def test_nothing_goes_without_the_merge(docs):
    def nothing(a, b):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.int8)

    alike = sd.repeated_runs(docs.select("doc_id", "text")).groupBy("gram", "content").count()
    assert alike.where("count > 1").count() > 0 and sd.repeated_spans(docs).count() > 0
    assert sd.repeated_spans(docs, merge=nothing).count() == 0


def test_no_documents(no_docs):
    assert sd.remaining(no_docs).count() == 0
