"""Benchmark decontamination: a broadcast hash set of benchmark n-grams meets every training window.

Native DataFrame functions only. Windows of `n` words (a shorter item is one window
of its own length) are hashed on both sides; the hash set of the benchmark is
broadcast when its counted size is below a bound and shuffled otherwise. Windows
that hit by hash are verified word by word on the documents that hold them.

Nulls: a null text or item has no words; null ids are kept and match each other.
Items that repeat count once per item_id; documents alike in doc_id and text get the
same facts. Columns besides those named are ignored, and kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import KEY, attach, free_name, load, row_key, word_count, words_of
from sylvagrid.session import stage

N = 13
# a hash set of at most so many windows (16 bytes each) is broadcast
BROADCAST_WINDOWS = 1_000_000


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(len, words, hash, items): every distinct window with the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of().alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    windows = items.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("len")))).alias("words"))
    return windows.groupBy("len", "words").agg(
        F.collect_set(F.coalesce("item", F.lit(""))).alias("items"), F.first(window_hash(F.col("words"))).alias("hash")
    )


def window_hash(words):
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Facts by row key for documents with a hit: `hits`, array of (at, len, items), sorted; words count from 0."""
    windows = stage(item_windows(benchmark, n), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n numbers
    wanted = windows.select("len", "hash").distinct()
    if windows.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    hashed = docs.select(*row_key(), F.transform(words_of(), lambda w: F.xxhash64(w)).alias("h"))

    def grams(length: int):
        starts = F.sequence(F.lit(1), F.size("h") - length + 1)
        return F.when(F.size("h") >= length, F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, length))))

    found = None
    for length in lengths:
        # the outer form keeps the optimizer from testing (and so computing) the array twice
        rows = hashed.select(*KEY, F.posexplode_outer(grams(length)).alias("at", "hash")).withColumn("len", F.lit(length))
        rows = rows.join(wanted, ["len", "hash"]).select(*KEY, F.struct("at", "len").alias("hit"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.select(*row_key(), F.lit(None).cast("struct<at:int,len:int>").alias("hit")).where(F.lit(False))
    near = found.groupBy(*KEY).agg(F.collect_set("hit").alias("near"))
    # word by word, on the whole texts that have a hit by hash
    texts = attach(docs.select("doc_id", "text"), near, F.size("near"), "inner").dropDuplicates(list(KEY))
    words = texts.select(*KEY, "near", words_of("_row.text").alias("w"))
    exact = words.select(
        *KEY, F.explode(F.transform("near", lambda h: F.struct(h.at, h.len, F.slice("w", h.at + 1, h.len).alias("words")))).alias("hit")
    ).select(*KEY, "hit.*")
    return (
        exact.join(windows.select("len", "words", "items"), ["len", "words"])
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("at", "len", "items"))).alias("hits"))
    )


def covered(hits) -> F.Column:
    """Number of words inside any hit; `hits` sorted by start."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc, hit):
        end = hit.at + hit.len
        fresh = F.greatest(end - F.greatest(acc.upto, hit.at), F.lit(0))
        return F.struct(F.greatest(acc.upto, end).alias("upto"), (acc.n + fresh).alias("n"))

    return F.aggregate(hits, zero, add, lambda acc: acc.n)


def overlap_report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per document row: _doc, _hash, n_words, n_hit, items (distinct, sorted as strings), hits."""
    hits = find_overlaps(docs, benchmark, n)
    facts = hits.select(
        *KEY,
        covered(F.col("hits")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("hits.items"))).alias("items"),
        "hits",
    )
    all_rows = docs.select("doc_id", "text")
    thin = all_rows.select(*row_key(), word_count().cast("long").alias("n_words"))
    facts = stage(facts, "overlaps").withColumnsRenamed({KEY[0]: "_d", KEY[1]: "_h"})
    joined = thin.join(facts, thin[KEY[0]].eqNullSafe(facts["_d"]) & (thin[KEY[1]] == facts["_h"]), "left")
    return joined.select(
        *KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hits",
    )


def is_contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """A document counts as contaminated when a twentieth of its words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    hits = find_overlaps(docs, benchmark, n).select(*KEY, covered(F.col("hits")).alias("n_hit"))
    rows = attach(docs, hits).where(
        F.col("n_hit").isNull() | ~is_contaminated(F.col("n_hit"), word_count("_row.text"))
    )
    return rows.select("_row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """All documents, with the words of benchmark windows (and what follows each of them) cut from `text`."""
    hits = find_overlaps(docs, benchmark, n)
    spots = hits.select(
        *KEY,
        F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.at, h.at + h.len - 1)))).alias("gone"),
    )
    rows = attach(docs, spots, F.size("gone"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.col("_row.text")
    rows = rows.withColumn("_w", F.regexp_extract_all(text, F.lit(word), F.lit(0))).withColumn("_s", F.split(text, word))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_w") - 1), "gone")
    cut = F.concat(F.get("_s", F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get("_w", i), F.get("_s", i + 1))), ""))
    out = rows.withColumn("_t", F.when(F.col("gone").isNull(), text).otherwise(cut))
    return out.select(*[(F.col("_t") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = overlap_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return report.select(
        F.col(KEY[0]).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k AS len, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k AS len, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT len AS k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, len, item_id FROM dw JOIN bw USING (len, g)),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
