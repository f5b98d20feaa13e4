"""The registered queries against SQL, and the whole pipeline against its brute-force version."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sylvagrid.llm import quality_rules as qr
from sylvagrid.llm.common import row_key
from sylvagrid.llm.registry import oracle_sql, queries
from tests.llm import plain
from tests.llm.fixtures import DOC, prose, rows_of

SF = "/root/testdata/sf0.001"


def row(values):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in values)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    sql = oracle_sql().get(name)
    if not sql:
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(row(r[n] for n in names) for r in rows) == Counter(map(row, got.fetchall()))


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_suffix_and_join_queries_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keyed = {(r[0], r[1]): r[2] for r in docs.select(*row_key(), "text").collect()}
    want = plain.repeats(keyed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op6_suffix_dedup"](spark, SF).collect()}
    assert got == {k[0]: v for k, v in want.items()}
    first, sizes = plain.classes(keyed, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op4_jaccard_join"](spark, SF).collect()}
    assert got == {k[0]: (sizes[k], first[k][0]) for k in keyed}


def brute_force(rows, key_of, items):
    """rows: (doc_id, text, source)."""
    vocabulary = qr.Vocabulary()
    rows = [r for r in rows if qr.rate([(r[1] or "").encode()], vocabulary)["kept"][0]]
    gone = plain.line_dedup({(r[0], key_of[r[0], r[1]]): r[1] for r in rows})
    cut = []
    for i, t, s in rows:
        g = gone.get((i, key_of[i, t]))
        kept = plain.without_lines(t, g) if g else t
        if not g or kept.strip(plain.BLANK + "\n"):
            cut.append((i, kept, s))
    first, _ = plain.classes({(i, t): t for i, t, _ in cut}, 5, 80, 100)
    cut = [r for r in cut if first[r[0], r[1]] == (r[0], r[1])]
    clean = []
    for r in cut:
        words, hit, _ = plain.overlaps(r[1], items)
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append(r)
    return clean, plain.copies(clean)


def test_pipeline_equals_brute_force(spark, texts, tmp_path):
    seen, rows = set(), []
    for i, t, s in texts:
        # ids that repeat with another text would need the order of row hashes after the cuts
        if i is not None and i not in seen:
            rows.append((i, t, s))
            seen.add(i)
    rows += [(500 + i, prose(900 + i, 60), f"s{i % 3}") for i in range(30)]
    items = [(1, prose(903, 60)), (2, " ".join(prose(8, 70).split()[10:50]))]
    spark.createDataFrame(rows_of(rows), DOC).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key_of = {(r.doc_id, r.text): r[2] for r in docs.select("doc_id", "text", row_key()[1]).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "copy"]
    clean, copies = brute_force(rows, key_of, items)
    assert Counter((r.doc_id, r.source, r.copy) for r in out.collect()) == copies
    text = {r[0]: r[1] for r in clean}
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in out.collect())
    assert 30 < len(clean) < len(rows) and 503 not in text


def test_stages_take_empty_tables(spark, no_docs, tmp_path):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0
