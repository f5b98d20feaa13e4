"""Line dedup, decontamination, mixture, URL filter and fixity audit against plain versions."""

import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from sylvagrid.llm import common, decontaminate, fixity, line_dedup, mixture, url_filter
from sylvagrid.llm.common import KEY, row_key
from tests.llm import plain
from tests.llm.fixtures import DOC, prose, rows_of


def keyed(docs):
    return {(r[0], r[1]): r[2] for r in docs.select(*row_key(), "text").collect()}


def test_lines_that_go(docs):
    gone = plain.line_dedup(keyed(docs))
    got = {(r[0], r[1]): set(r.gone) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == dict(gone) and len(got) > 5
    out = line_dedup.drop_repeated_lines(docs, counts=["n_chars"])
    assert out.columns == docs.columns
    want = Counter()
    for key, text in ((tuple(r)[:2], r[2]) for r in docs.select(*row_key(), "text").collect()):
        kept = plain.without_lines(text, gone[key]) if key in gone else text
        if key not in gone or kept.strip(plain.BLANK + "\n"):
            want[key[0], kept, len(kept or "")] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want


def items(spark):
    passage = prose(8, 70)
    rows = [(1, " ".join(passage.split()[20:60])), (2, "one"), (3, None), (4, "!!"), (None, "two WORDS"), (5, passage.upper()), (5, passage.upper())]
    return rows, spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "item_id long, text string, words string, len int")


@pytest.mark.parametrize("broadcast", [True, False])
def test_overlaps_equal_reading(spark, docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(common, "BROADCAST_ENTRIES", 0)
    rows, benchmark = items(spark)
    got = Counter((r[0], r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.overlap_report(docs, benchmark).collect())
    want, clean = Counter(), Counter()
    for r in docs.select("doc_id", "text").collect():
        words, hit, found = plain.overlaps(r.text, [("" if i is None else i, t) for i, t in rows])
        want[r.doc_id, len(words), len(hit), tuple(found)] += 1
        clean[r.doc_id] += not (hit and 20 * len(hit) >= len(words))
    assert got == want and any(k[2] for k in got)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == +clean


def test_spans_are_cut(spark, docs):
    _, benchmark = items(spark)
    out = decontaminate.cut_spans(docs, benchmark)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert decontaminate.find_overlaps(out.where("doc_id between 60 and 71"), benchmark).count() == 0
    whole = {r.doc_id: r.text for r in docs.where("doc_id between 60 and 71").collect()}
    for r in out.where("doc_id between 60 and 71").collect():
        assert r.text.startswith(whole[r.doc_id].split("\n")[0]) and len(r.text) < len(whole[r.doc_id])


def test_decontamination_without_items_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlap_report(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
    assert decontaminate.overlap_report(no_docs, items(spark)[1]).count() == 0


def test_plan_has_no_python(spark, docs):
    plan = decontaminate.overlap_report(docs, items(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, "s1": 300.0}])
def test_copies_follow_the_rates(docs, texts, weights):
    got = mixture.replicate(docs, mixture.source_rates(docs, weights)).select("_row.doc_id", "_source", "_copy", "_order").collect()
    assert Counter((r.doc_id, r["_source"], r["_copy"]) for r in got) == plain.copies(texts, weights=weights)
    orders = [r["_order"] for r in got]
    assert orders == sorted(orders)


def test_mean_number_of_copies(spark):
    rows = [(i, "x" * 50, "big" if i % 10 else "small") for i in range(20000)]
    docs = spark.createDataFrame(rows_of(rows), DOC)
    n = Counter(r["_source"] for r in mixture.replicate(docs, mixture.source_rates(docs, {"big": 1.0, "small": 1.0})).collect())
    assert abs(n["big"] - 10000) < 400 and abs(n["small"] - 10000) < 400
    high = mixture.replicate(docs.where("source = 'small'"), mixture.source_rates(docs.where("source = 'small'"), epochs=150.0)).groupBy("_row.doc_id").count()
    mean, var = high.agg(F.avg("count"), F.var_samp("count")).first()
    assert abs(mean - 150) < 2 and abs(var - 150) < 25


def test_mix_keeps_columns(docs, no_docs):
    assert mixture.mix(docs).columns == [*docs.columns, "_copy"]
    assert mixture.mix(no_docs).count() == 0


URLS = [
    "http://a.Example.com/en/7/x?q#f",
    "https://example.com/en/8",
    "http://example.com",
    "http://com/en/",
    "http://xcom/en/",
    "http://notexample.com/en/7",
    "https://de.net/de/8",
    "https://example.net/de/80#x",
    "ftp://x.org/es/1/://y.com/en/",
    "no scheme example.com/en/",
    "",
    None,
    "http://",
    "http:///en/",
    "http://é.com/en/ü",
    "http://x.org?a/es/",
    "http://x.org/es",
]
MORE = [("com", "/", "allow"), ("b.com", None, "block"), ("com", "/en/", "allow"), (None, "/", "block"), ("com", "/en/", "block"), ("", "/", "block")]


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = plain.lowered(rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for h, p, action in rules:
        p = "/" if p is None else p
        if h and action and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]) or (h + p == best[0] and action == "block"):
                best = (h + p, action)
    return (host, path, *(best or (None, default)))


@pytest.mark.parametrize("rules", [url_filter.RULES, url_filter.RULES + MORE, []])
def test_urls_equal_every_rule_tried(spark, rules):
    urls = [(None if i % 7 == 3 else i, u) for i, u in enumerate(URLS * 3 + [f"http://h{i % 40}.b.com/en/{i}" for i in range(400)])]
    table = spark.createDataFrame(urls, "id long, url string").repartition(4)
    known = spark.createDataFrame(rules, "host string, path string, action string")
    got = Counter(tuple(r) for r in url_filter.with_verdict(table, known).collect())
    assert got == Counter((i, *judged(u, rules)) for i, u in urls)


def test_blocked_pages_go(spark):
    pages = spark.createDataFrame([(i, u, "x", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    known = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    out = url_filter.drop_blocked(pages, known)
    assert out.columns == pages.columns
    assert {r.page_id for r in out.collect()} == {i for i, u in enumerate(URLS) if judged(u, url_filter.RULES)[3] != "block"}
    empty = spark.createDataFrame([], "id long, url string")
    assert url_filter.with_verdict(empty, known).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "file string, offset long, length long, payload binary, node string, hash string")


def archive(n=300, files=("a", "b", None)):
    return [(f, i * 700, 700, None if i % 50 == 9 else f"{f}-{i}".encode() * 5, "x", "y") for f in files for i in range(n)]


def test_audit_finds_what_differs(spark):
    ours = archive()
    theirs = [r for i, r in enumerate(ours) if i not in (5, 640)]
    theirs[10] = (*theirs[10][:3], b"flipped", "x", "y")
    theirs[800] = (*theirs[800][:2], 701, *theirs[800][3:])
    theirs += [("c", 0, 10, b"new", "x", "y"), theirs[20], theirs[20]]
    a, b = (fixity.record_digests(records(spark, x)) for x in (ours, theirs))
    got = {(r.file, r.offset, r.length, r.other_length, r.status) for r in fixity.audit(a, b, leaf_bytes=2000, fanout=3).collect()}
    digest = lambda r: (r[0], r[1], r[2], hashlib.sha256(r[3] or b"").hexdigest())
    x, y = {digest(r) for r in ours}, {digest(r) for r in theirs}
    places = {r[:2] for r in x ^ y}
    assert {(f, o) for f, o, *_ in got} == places and len(got) == 5
    assert Counter(s for *_, s in got) == {"missing": 2, "changed": 2, "extra": 1}
    assert fixity.audit(a, a).count() == 0
    none = fixity.record_digests(records(spark, []))
    assert fixity.audit(none, none).count() == 0
    assert fixity.audit(a, none).where("status = 'missing'").count() == len(ours)


def test_tree_hashes_are_those_of_a_plain_tree(spark):
    rows = archive(40, ("a",))
    found = fixity.merkle_levels(fixity.record_digests(records(spark, rows)), 2, leaf_bytes=2000, fanout=3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = {}
    for f, o, n, p, *_ in rows:
        leaves.setdefault(o // 2000, []).append(f"{o}:{n}:{hashlib.sha256(p or b'').hexdigest().upper()}")
    level = {k: sha(",".join(v)) for k, v in leaves.items()}
    for df in found:
        assert {r.node: r.hash for r in df.collect()} == level
        up = {}
        for k in sorted(level):
            up.setdefault(k // 3, []).append(f"{k}:{level[k]}")
        level = {k: sha(",".join(v)) for k, v in up.items()}


def test_archive_of_pages(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i % 50)) for i in range(2500)] + [(None, None, None), (None, "u", "h")], "page_id long, url string, html string")
    got = fixity.archive_records(pages).where("page_id is not null").orderBy("page_id").collect()
    at = {}
    for r in got:
        assert (r.file, r.offset) == (r.page_id // 1000, at.get(r.file, 0))
        at[r.file] = r.offset + r.length
    assert fixity.archive_records(pages).count() == 2502
