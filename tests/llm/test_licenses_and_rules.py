"""License scan and quality rules against plain versions that read a text word by word."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sylvagrid.llm import license_scan as ls
from sylvagrid.llm import quality_rules as qr

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
NOTICES = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "gnu general, public license; MIT-License cc-by CC BY-NC 4.0",
    "apache apache license license apache license",
    "the mit of the license and the gnu",
    "É MIT LICENSE é",
]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base_places(words):
    return [(i, p) for p in ls.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def test_scan_equals_reading(spark, texts):
    from tests.llm.fixtures import DOC, rows_of

    rows = [(i, t, s) for i, t, s in texts] + [(200 + i, n, "s") for i, n in enumerate(NOTICES)] + [(300, " ".join(NOTICES * 50), "s")]
    got = ls.scan(spark.createDataFrame(rows_of(rows), DOC).repartition(4)).collect()
    want = Counter()
    for i, t, _ in rows:
        words = WORD.findall(lowered(t))
        at = base_places(words)
        want[i, len(words), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({ls.BASE[p] for _, p in at}))] += 1
    assert want == Counter(
        (
            r.doc_id,
            r.n_words,
            sum(s.n for s in r.spots),
            min((s.first for s in r.spots), default=None),
            max((s["last"] for s in r.spots), default=None),
            ",".join(r.base_labels),
        )
        for r in got
    )
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) for r in got)
    assert {"apache", "apache-2.0"} <= set(by[200].labels) and "gpl-3" in by[201].labels and "cc-by-nc" in by[202].labels
    assert by[204].labels == [] and by[204].score == 0


def plain_labels(words, index):
    """Labels of the method and the score, by trying every alignment of every template."""
    labels, score = set(), 0.0
    starts = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()] for p in index.phrases}
    for label, (text, keys) in ls.TEMPLATES.items():
        text = text.encode().split()
        idf = [index.idf[index.ids[w]] for w in text]
        for o in range(-len(text), len(words)):
            share = sum(x for q, x in enumerate(idf) if 0 <= o + q < len(words) and words[o + q] == text[q]) / sum(idf)
            if share >= ls.SHARE and all(any(o - len(text) <= s <= o + 2 * len(text) for s in starts[k]) for k in keys):
                labels.add(label)
                score = max(score, min(share, 1.0))
    base = {ls.BASE[p] for p in ls.BASE if starts[p]}
    return labels | base, max(score, 0.5 if base else 0.0)


def licence_texts():
    """Whole, cut, changed and scattered licence texts in prose."""
    import random

    r = random.Random(3)
    out = list(NOTICES)
    for label, (text, keys) in ls.TEMPLATES.items():
        words = text.split()
        changed = [w if r.random() > 0.12 else "changed" for w in words]
        cut = words[: len(words) * 2 // 3]
        for body in (words, changed, cut, words[::-1], words + cut, ["x"] * r.randint(1, 9) + words, words[: len(words) // 2] + ["more"] + words[len(words) // 2 :]):
            out.append(" ".join(["some", "text", *body, "the", "license", "end"]))
        out.append(" ".join(keys))  # key phrases without the text
    return out


def test_labels_and_score_equal_every_alignment():
    frequency = {w: (7 * n) % 40 for n, w in enumerate(ls.vocabulary())}
    index = ls.build_index(40, frequency)
    seen = set()
    for t in licence_texts():
        words = t.encode().translate(ls.ALNUM).split()
        got, want = ls.scan_text(words, index), plain_labels(words, index)
        assert got["labels"] == want[0] and got["score"] == pytest.approx(want[1])
        seen |= got["labels"]
    assert set(ls.TEMPLATES) <= seen


def test_cost_does_not_follow_the_number_of_templates(monkeypatch):
    own = {f"own-{i}": (" ".join(f"w{i}x{k}" for k in range(12)), [f"w{i}x3 w{i}x4"]) for i in range(500)}
    index = ls.build_index(10, {}, {**ls.TEMPLATES, **own})
    words = ("released under the mit license " + ls.TEMPLATES["zlib"][0]).encode().split()
    few = ls.build_index(10, {})
    numbers = {}
    for name, x in (("few", few), ("many", index)):
        at = np.fromiter((x.ids.get(w, -1) for w in words), np.int32, len(words))
        where = {int(w): np.flatnonzero(at == w) for w in np.unique(at[at >= 0])}
        numbers[name] = sorted(ls.alignments(x, at, where))
    assert numbers["few"] == numbers["many"] and len(numbers["few"]) < len(ls.TEMPLATES)
    assert "own-7" in ls.scan_text(own["own-7"][0].encode().split(), index)["labels"]


def test_entering_words_leave_less_than_the_share():
    index = ls.build_index(100, {w: n % 100 for n, w in enumerate(ls.vocabulary())})
    for text, _ in index.templates.values():
        at = ls.entering(text, index.idf, ls.SHARE)
        rest = [q for q in range(len(text)) if q not in at]
        assert index.idf[text[np.array(rest, int)]].sum() < ls.SHARE * index.idf[text].sum()
        assert len(at) == 1 or index.idf[text[[*rest, at[-1]]]].sum() >= ls.SHARE * index.idf[text].sum() * (1 - 1e-8)


def test_word_frequency_counts_documents(spark, docs, texts):
    n, counts = ls.word_frequency(docs, [b"one", b"two", b"absent"])
    want = [set(WORD.findall(lowered(t))) for _, t, _ in texts]
    assert n == len(texts)
    assert counts == {w.encode(): sum(w in s for s in want) for w in ("one", "two", "absent")}


def plain_facts(text, vocabulary):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    tokens = [t for w in words for t in vocabulary.model.encode(w)]
    n = Counter(tokens)
    entropy = -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in n.values()) / math.log2(len(tokens)) if len(tokens) > 1 else 0.0
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
        len(tokens),
        round(sum(map(len, words)) / max(len(tokens), 1), 9),
        round(sum(vocabulary.model.is_byte(t) for t in tokens) / max(len(tokens), 1), 9),
        round(entropy, 9),
    )


def test_quality_facts_equal_plain_counts(docs, texts):
    vocabulary = qr.Vocabulary()
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens)
        + tuple(round(x, 9) for x in (r.chars_per_token, r.byte_share, r.entropy))
        for r in qr.quality_facts(docs).collect()
    )
    assert got == Counter((i, *plain_facts(t, vocabulary)) for i, t, _ in texts)


def test_bands_follow_the_main_script_and_keep_prose():
    vocabulary = qr.Vocabulary()
    from tests.llm.fixtures import prose

    texts = [prose(1, 200), "Āẞꞷⱳ " * 60, "日本語 のテキスト です ね " * 3 + " ".join(f"東{i}" for i in range(40)), "Привет мир это текст " * 2 + prose(3, 0)]
    got = qr.rate([t.encode() for t in texts], vocabulary)
    assert list(got["script"]) == ["latin", "latin", "cjk", "cyrillic"]
    assert got["kept"][0]
    # hexadecimal digests, and Latin text among code points that the vocabulary lacks
    import hashlib

    digests = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(40))
    broken = " ".join(w + "\U00013000" * 3 for w in prose(2, 60).split())
    odd = qr.rate([digests.encode(), broken.encode()], vocabulary)
    assert not odd["base_failed"].any() and not odd["kept"].any()
    narrow = {**qr.BANDS, "latin": ((50.0, 60.0), (0.0, 1.0), (0.0, 1.0))}
    assert not qr.rate([texts[0].encode()], vocabulary, narrow)["kept"][0]
    assert qr.rate([b"a b c " * 3], vocabulary, narrow)["base_failed"][0]


def test_clean_text_of_a_script_without_vocabulary_stays():
    import random

    vocabulary = qr.Vocabulary()
    for first, n, script in [(0x0E94, 1, "other"), (0x13A0, 80, "other"), (0x1E922, 30, "other"), (0x0E01, 40, "thai"), (0x05D0, 27, "hebrew"), (0x10D0, 33, "georgian")]:
        letters = [chr(first + i) for i in range(n)] if n > 1 else list("ກຂຄງຈຊຍດຕຖທນບປຜຝພຟມຢຣລວສຫອຮ")
        r = random.Random(first)
        # short and long texts: the entropy is a share of log2(tokens)
        for words in (40, 20_000):
            text = " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 14))) for _ in range(words))
            got = qr.rate([text.encode()], vocabulary)
            assert got["script"] == [script] and got["n_tokens"][0] >= qr.MIN_TOKENS
            assert got["kept"][0], (script, words, {c: got[c][0] for c in qr.FACTS})


def test_second_vocabulary_is_measured_and_judges():
    vocabulary = qr.Vocabulary()
    from tests.llm.fixtures import prose

    text = prose(1, 200) + " " + "ab" * 20_000
    got = qr.rate([text.encode()], vocabulary)
    tokens = [t for w in text.split() for at in range(0, len(w) + 1, qr.PIECE) for t in vocabulary.multi.encode_ordinary((" " + w)[at : at + qr.PIECE])]
    assert got["n_multi_tokens"][0] == len(tokens)
    assert got["multi_chars_per_token"][0] == pytest.approx(sum(map(len, text.split())) / len(tokens))
    lao = vocabulary.multi.encode_ordinary("ກຂຄ")
    assert vocabulary.multi_is_byte[lao].all() and not vocabulary.multi_is_byte[vocabulary.multi.encode_ordinary(" the text")].any()
    narrow = {**qr.MULTI_BANDS, "latin": ((50.0, 60.0), (0.0, 1.0), (0.0, 1.0))}
    clean = prose(1, 200).encode()
    assert qr.rate([clean], vocabulary)["kept"][0] and not qr.rate([clean], vocabulary, qr.BANDS, narrow)["kept"][0]


def test_rejected_documents_go_whole(docs, no_docs):
    kept = {(r.doc_id, r.n_words) for r in qr.quality_facts(docs).where("kept").collect()}
    out = qr.drop_rejected(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _ in kept}
    assert qr.drop_rejected(no_docs).count() == qr.quality_facts(no_docs).count() == ls.scan(no_docs).count() == 0
