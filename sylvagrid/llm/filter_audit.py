"""Filter interaction audit: what every order of a set of filters would remove.

A document is a row of a mask matrix, with 0 where a filter fails it and infinity where it
passes; an order of the filters is a column of a position matrix, the inverse permutation. Their
min-plus product is the step at which the order removes the document (infinity: it stays). From
these removal ranks come, per order and step, the documents removed, kept, redundantly failed and
lost, as weighted scatter counts.

The masks are one native pass over the texts. Documents alike in part, mask and labels are counted
before they are ranked, so that the matrices have at most (2 ** filters x label kinds) rows a part,
whatever the input; the parts are spread over the executors and ranked in Arrow batches. Whether a
text occurs under a smaller id is asked through the smallest id of each text digest, found before
the shuffle and joined by (digest, id): a text that a third of the table shares is no hot key.

Nulls and odd cases: a null text is the empty text, a null part the empty string. A document with a
null id has no smaller one, is none to others, and carries no label. Repeated rows count each; rows
with the same id and text are no copies of each other. Labels that repeat count as 1 if any row
says so. An empty table gives no rows. Other columns of the inputs are ignored. Texts are digested
with SHA-256; very long ones are read whole by the same expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import load
from sylvagrid.session import stage

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
FAR = np.int64(1 << 20)  # infinity of the min-plus product: beyond every step


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that judge a text alone; no nulls."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": F.translate(text, "#$%&*|", "") != text,
    }


def mask_of(fails: Sequence[Column]) -> Column:
    """Bit i is set where filter i fails the document."""
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return sum(bits[1:], bits[0])


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask) per document, for the filters A, B, C, D and E (a copy of a smaller id's text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        mask_of(list(failures(text).values())).alias("mask"),
    )
    thin = stage(thin, "masks")
    known = thin.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return thin.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def removal_ranks(masks: np.ndarray, filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders x filters as positions, and masks x orders as the step (from 1) that removes; FAR for none."""
    orders = np.array(list(permutations(range(filters))), np.int64)
    positions = np.argsort(orders, axis=1) + 1
    fail = np.where((masks[:, None] >> np.arange(filters)) & 1, 0, FAR)
    ranks = np.full((len(masks), len(orders)), FAR)
    for f in range(filters):  # the min-plus product, one filter at a time
        np.minimum(ranks, fail[:, f, None] + positions[None, :, f], out=ranks)
    return positions, ranks


def tallies(mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts as orders x steps, for rows of one part: masks and how many documents have them."""
    positions, ranks = removal_ranks(mask, filters)
    orders = len(positions)
    at = np.arange(orders) * (filters + 1)
    cell = at[None, :] + np.where(ranks <= filters, ranks - 1, filters)

    def scattered(weight: np.ndarray) -> np.ndarray:
        spread = np.repeat(weight, orders)
        return np.bincount(cell.ravel(), weights=spread, minlength=orders * (filters + 1)).reshape(orders, -1)[:, :filters].astype(np.int64)

    removed = scattered(n)
    redundant, alone = np.zeros_like(removed), np.zeros(filters, np.int64)
    for f in range(filters):
        fails = (mask >> f) & 1 == 1
        late = ranks[fails] < positions[None, :, f]
        redundant[np.arange(orders), positions[:, f] - 1] = (late * n[fails, None]).sum(axis=0)
        alone[f] = n[mask == 1 << f].sum()
    by_step = np.argsort(positions, axis=1)
    per_filter = np.array([removed[by_step == f].sum() for f in range(filters)], np.int64)
    return {
        "kept": n.sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": alone[by_step],
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": per_filter[by_step],
    }


def audit(masks: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """COUNTS per (part, filter_order, step) from the masks and labels of documents."""
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")]
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*flags)
    joined = masks.join(known, "doc_id", "left")
    table = joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    names = ["".join(p) for p in permutations(filters)]
    size = len(filters)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b["part"].dictionary_encode()
            group = part.indices.to_numpy()
            columns = [b[c].to_numpy() for c in ("mask", "n", "good", "toxic")]
            for g, name in enumerate(part.dictionary.to_pylist()):
                counts = tallies(*(c[group == g].astype(np.int64) for c in columns), filters=size)
                rows = len(names) * size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * rows),
                        pa.array(np.repeat(names, size).tolist()),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(names))),
                        *[pa.array(counts[c].ravel()) for c in COUNTS],
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    # the rows of a part, 32 at most, come together; where a batch ends among them its partial counts are added
    ranked = table.repartition("part").sortWithinPartitions("part").mapInArrow(rank, schema)
    return ranked.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masked(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
failing AS (
  SELECT part, doc_id,
    concat(CASE WHEN len(words) < 200 THEN 'A' END,
     CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
     CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' END,
     CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
     CASE WHEN doc_id > first_id THEN 'E' END) AS fails
  FROM worded),
known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
patterns AS (
  SELECT part, fails, count(*) AS n,
    coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM failing LEFT JOIN known USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE length(o) < 5 AND NOT contains(o, f)),
steps AS (
  SELECT o, CAST(s AS INTEGER) AS step, o[s:s] AS f, o[1:s - 1] AS before
  FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5),
judged AS (
  SELECT part, o, step, f, n, good, bad, fails,
    contains(fails, f) AS failed,
    regexp_matches(fails, '[' || before || '#]') AS gone
  FROM patterns, steps),
counted AS (
  SELECT part, o, step, f,
    sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND failed THEN bad ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
