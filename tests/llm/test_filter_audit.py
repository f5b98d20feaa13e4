"""Filter interaction audit against a walk of every document through every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sylvagrid.llm import filter_audit as fa
from sylvagrid.llm.registry import oracle_sql
from tests.llm.fixtures import DOC, prose, rows_of

LABELS = "doc_id long, quality int, toxic int, part string"


def verdicts(rows):
    """Letters of the failed filters of each document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and first[t] < i,
        ]
        out.append("".join(f for f, failed in zip("ABCDE", fails) if failed))
    return out


def walk(rows, labels):
    good = {i for i, q, *_ in labels if q == 1}
    bad = {i for i, _, t, *_ in labels if t == 1}
    counts = {}
    parts = Counter(s or "" for _, _, s in rows)
    orders = ["".join(p) for p in permutations("ABCDE")]
    for p in parts:
        for o in orders:
            for k in range(5):
                counts[p, o, k + 1] = Counter()
    shapley = Counter()
    for (i, _, s), fails in zip(rows, verdicts(rows)):
        for o in orders:
            gone = False
            for k, f in enumerate(o):
                c = counts[s or "", o, k + 1]
                if f in fails:
                    c["unique_fails"] += fails == f
                    if gone:
                        c["redundant"] += 1
                    else:
                        gone = True
                        c["removed"] += 1
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in bad
                        shapley[s or "", f] += 1
                c["kept"] += not gone
    return {(p, o, k, *(c[n] for n in fa.COUNTS[:-1]), shapley[p, o[k - 1]]) for (p, o, k), c in counts.items()}


def odd_rows(texts):
    long = prose(3, 260)
    extra = [(300, long, "s0"), (301, long, "s1"), (302, long + " #", "s1"), (300, long, "s2"), (None, long, "s2"), (303, "AB " * 210, ""), (304, None, None)]
    varied = " ".join(f"w{k}" for k in range(220))
    return texts + extra + [(400 + k, f"{varied} x{k % 3}" + ("|" if k % 2 else ""), "s0") for k in range(12)]


def test_equals_a_walk(spark, texts):
    rows = odd_rows(texts)
    labels = [(i, k % 2, (k + 1) % 3 % 2, "x") for k, (i, *_) in enumerate(rows) if k % 4] + [(300, 0, 1, "x"), (300, 1, None, "x"), (None, 1, 1, "x")]
    docs = spark.createDataFrame(rows_of(rows), DOC).repartition(3)
    # a null id carries no label
    want = walk(rows, [x for x in labels if x[0] is not None])
    got = [tuple(r) for r in fa.audit(fa.masked(docs), spark.createDataFrame(labels, LABELS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_documents_and_no_labels(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], LABELS)
    assert fa.audit(fa.masked(no_docs), none).count() == 0
    assert {tuple(r) for r in fa.audit(fa.masked(docs), none).collect()} == walk(texts, [])


def test_ranks_are_the_first_failing_step():
    masks = np.arange(32)
    positions, ranks = fa.removal_ranks(masks, 5)
    for j, order in enumerate(permutations(range(5))):
        assert [positions[j, f] for f in order] == [1, 2, 3, 4, 5]
        for m in masks:
            steps = [k + 1 for k, f in enumerate(order) if m >> f & 1]
            assert ranks[m, j] == (steps[0] if steps else fa.FAR)


def test_partial_counts_of_a_part_add_up():
    rng = np.random.default_rng(4)
    mask, n, good, toxic = rng.integers(0, 32, 40), rng.integers(1, 9, 40), rng.integers(0, 3, 40), rng.integers(0, 2, 40)
    whole = fa.tallies(mask, n, good, toxic, 5)
    halves = [fa.tallies(mask[s], n[s], good[s], toxic[s], 5) for s in (slice(0, 17), slice(17, 40))]
    for c in fa.COUNTS:
        assert np.array_equal(whole[c], halves[0][c] + halves[1][c])


@pytest.mark.parametrize("filters", ["AB", "ABC"])
def test_other_numbers_of_filters(spark, filters):
    masks = spark.createDataFrame([(i, "p", i % (1 << len(filters))) for i in range(50)], "doc_id long, part string, mask int")
    got = fa.audit(masks, spark.createDataFrame([], LABELS), filters)
    orders = len(list(permutations(filters)))
    assert got.count() == orders * len(filters)
    assert {r.kept + r.n for r in got.where(f"step = {len(filters)}").selectExpr("kept", "50 - kept n").collect()} == {50}


def test_query_has_sql():
    assert "op12_filter_audit" in oracle_sql()
