"""Tokenizer alignment against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from sylvagrid.llm import alignment as al
from sylvagrid.llm.common import load
from tests.llm.fixtures import DOC, prose, rows_of

ODD = ["", " ", "  ", "a ", " a", "a  b", "a\n b", "a \n b ", "\n", "x▁y z", "▁", "<|endoftext|> a</s><s> <unk>", "don't  stop\t\tnow ", "日本語 テキスト", "é  b", "\x00a b", "\x1c a", "a\x85 b", "😀 😀", "ﬁ ①", "a" * 3000]
ALPHABET = [" ", " ", "  ", "\n", "a", "b", "the", "'s", "1", "é", "日", "😀", ".", "\t", " ", "▁", "\x1f", "　", "<unk>", "<0x41>", "<|endoftext|>"]


@pytest.fixture(scope="module")
def vocabularies():
    return al.Vocabularies()


def walk(text, v):
    """(n_a, n_b, n_groups, n_links), groups, pairs with how often they are linked; whole text at once."""
    if not text:
        return (0, 0, 0, 0), "", {}
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(v.bytes_a[i] for i in a) != raw or b"".join(v.bytes_b[i] for i in b) != raw:
        return (0, 0, 0, 0), "", {}
    spans = []
    for ids, of in ((a, v.bytes_a), (b, v.bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        spans.append(out)
    common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, low = [], 0
    for c in common:
        groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= c) for side in spans))
        low = c
    pairs, first = Counter(), 0
    for s, e, i in spans[0]:
        while spans[1][first][1] <= s:
            first += 1
        k = first
        while k < len(spans[1]) and spans[1][k][0] < e:
            pairs[i * len(v.bytes_b) + spans[1][k][2]] += 1
            k += 1
    return (len(a), len(b), len(common), sum(pairs.values())), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs


def facts(got, i):
    sha = hashlib.sha256(got["groups"][i].as_py().encode()).hexdigest() if got["n_a"][i] else ""
    return tuple(int(got[c][i]) for c in al.FACTS), sha, dict(zip(got["pairs"][i].as_py(), got["times"][i].as_py()))


def test_every_text_as_by_a_plain_walk(vocabularies):
    r = random.Random(1)
    texts = ODD + ["".join(r.choices(ALPHABET, k=r.randint(1, 30))) for _ in range(600)] + [prose(i, 40) for i in range(20)]
    got = al.align(vocabularies.encode(texts)[0], vocabularies)
    for i, t in enumerate(texts):
        assert facts(got, i) == walk(t, vocabularies), t


def test_long_texts_in_parts(vocabularies):
    r = random.Random(2)
    for t in [prose(1, 300), " a  b  ", "x▁y " * 20, *("".join(r.choices(ALPHABET, k=60)) for _ in range(60))]:
        got = al.align_long(t, vocabularies, most=9)
        assert (tuple(got[c][0] for c in al.FACTS), got["sha"][0], dict(zip(got["pairs"][0], got["times"][0]))) == walk(t, vocabularies)


def test_pieces_are_forgotten(vocabularies, monkeypatch):
    monkeypatch.setattr(al, "REMEMBERED", 8)
    texts = [prose(i, 30) for i in range(4)] + ["a  b"]
    for t in texts:
        assert facts(al.align(vocabularies.encode([t])[0], vocabularies), 0) == walk(t, vocabularies)


def test_new_pieces_are_encoded_in_runs(vocabularies, monkeypatch):
    r = random.Random(3)
    odd = list(dict.fromkeys(p for t in ODD + ["".join(r.choices(ALPHABET, k=9)) for _ in range(300)] for p in t.split(" ")))
    words = list(dict.fromkeys(p for i in range(20) for p in prose(i, 40).split(" ")))
    alone, plainly = [], vocabularies.one_by_one
    monkeypatch.setattr(vocabularies, "one_by_one", lambda pieces: alone.extend(pieces) or plainly(pieces))
    monkeypatch.setattr(al, "RUN", 7)
    vocabularies.forget()
    vocabularies.remember(words)
    assert len(words) > 50 and alone == []
    vocabularies.remember(odd)
    assert {p for p in odd if not p or p[-1].isspace()} <= set(alone) and len(alone) < len(odd)
    want, same = plainly(words + odd)
    assert vocabularies.same.tolist() == same
    for s, (flat, n) in enumerate(want):
        assert vocabularies.counts[s].tolist() == n.tolist()
        got = [vocabularies.flat[s][at : at + m].tolist() for at, m in zip(vocabularies.starts[s], vocabularies.counts[s])]
        assert [t for piece in got for t in piece] == flat.tolist()
    vocabularies.forget()


def corpus_answer(rows, v):
    walked = [walk(t, v) for _, t, _ in rows]
    held = Counter(p for _, _, pairs in walked for p in pairs)
    most = defaultdict(int)
    for p, n in held.items():
        most[p // len(v.bytes_b)] = max(most[p // len(v.bytes_b)], n)
    out = []
    for (i, _, _), (n, sha, pairs) in zip(rows, walked):
        best = sum(t for p, t in pairs.items() if held[p] == most[p // len(v.bytes_b)])
        out.append((i, *n, best, sum(t * held[p] for p, t in pairs.items()), sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [al.PAIRS, 0])
def test_corpus_equals_brute_force(spark, texts, vocabularies, most):
    rows = texts + [(200 + k, t, None) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows_of(rows), DOC).repartition(3)
    got = sorted((tuple(r) for r in al.alignment(docs, most=most).collect()), key=str)
    assert got == corpus_answer(rows, vocabularies)


def test_empty_table(spark, no_docs):
    assert al.alignment(no_docs).count() == 0 and al.alignment(no_docs, most=-1).count() == 0


def test_partial_counts_are_merged(spark, vocabularies, texts, monkeypatch):
    docs = spark.createDataFrame(rows_of(texts), DOC).repartition(2)
    rows = al.aligned(docs)
    whole = {tuple(r) for r in al.pair_counts(rows, len(vocabularies.bytes_b)).collect()}
    monkeypatch.setattr(al, "COUNTED", 50)
    assert {tuple(r) for r in al.pair_counts(rows, len(vocabularies.bytes_b)).collect()} == whole


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = al.op11_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = got.collect()
    assert len(rows) == load(spark, sf, "documents").count()
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and 0 < r.n_best <= r.n_links <= r.count_sum for r in rows if r.n_a)
