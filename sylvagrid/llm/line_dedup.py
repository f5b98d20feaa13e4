"""Line dedup: overlapping windows of three lines, hashed; later windows that repeat are removed.

A line counts without the white space around it; blank lines are skipped when windows
are formed, and stay. A window that occurs before (smaller doc_id, nulls first; within
a document at a smaller line) is a repeat. All its lines go, so overlapping repeated
windows merge into one cut. Documents with fewer than `size` lines that are not blank
have no window and stay whole. Documents alike in doc_id and text count as one.
A null text has no lines and stays null; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import KEY, attach, load, row_key
from sylvagrid.session import stage

SIZE = 3
BLANK = " \t\r\x0b\x0c"


def line_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, at, lines, h1, h2): where each window starts, the numbers of its lines and 128 bits of hash."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("at"), F.trim(line, F.lit(BLANK)).alias("line")))
    full = docs.select(*row_key(), F.filter(lines, lambda x: F.length(x.line) > 0).alias("l"))

    def window(i):
        part = F.slice("l", i, size)
        return F.struct(
            part["at"].alias("lines"),
            F.xxhash64(part["line"]).alias("h1"),
            F.xxhash64(F.lit("window"), F.reverse(part["line"])).alias("h2"),
        )

    starts = F.sequence(F.lit(1), F.size("l") - (size - 1))
    windows = F.when(F.size("l") >= size, F.transform(starts, window))
    return full.select(*KEY, F.explode_outer(windows).alias("w")).where(F.col("w").isNotNull()).select(
        *KEY, F.get("w.lines", F.lit(0)).alias("at"), "w.lines", "w.h1", "w.h2"
    )


def repeated_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Facts by row key: `gone`, the sorted numbers of the lines inside a repeated later window."""
    windows = stage(line_windows(docs, size), "line-windows")
    # counted before the shuffle, so a window that every document has is one row of each task
    place = F.struct(*KEY, "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = first.where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    later = windows.join(again, ["h1", "h2"]).where(F.struct(*KEY, "at") != F.col("first"))
    return later.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("gone"))


def kept_lines(text: Column, gone: Column) -> Column:
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def with_kept_text(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(_row, _text, gone): each document with its remaining text and the lines that went (null: none)."""
    rows = attach(docs, repeated_lines(docs, size), F.size("gone"))
    text = F.col("_row.text")
    return rows.select("_row", F.when(F.col("gone").isNull(), text).otherwise(kept_lines(text, F.col("gone"))).alias("_text"), "gone")


def drop_repeated_lines(docs: DataFrame, counts: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """The documents with repeated lines cut from `text`, and the columns `counts` set to its new length
    where it changed.

    Documents that lose lines and keep no character but white space are left out.
    """
    rows = with_kept_text(docs, size).where(F.col("gone").isNull() | (F.length(F.trim("_text", F.lit(BLANK + "\n"))) > 0))
    size = F.when(F.col("gone").isNotNull(), F.length("_text"))
    new = {"text": F.col("_text")} | {c: F.coalesce(size.cast(docs.schema[c].dataType), F.col(f"_row.`{c}`")) for c in counts}
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(F.split("_row.text", "\n")))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return with_kept_text(docs).select(
        "_row.doc_id",
        n_lines.cast("long").alias("n_lines"),
        n_removed.cast("long").alias("n_removed"),
        F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l
  WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
w AS (
  SELECT doc_id, pos, lead(pos, 1) OVER s AS pos1, lead(pos, 2) OVER s AS pos2,
         t || chr(10) || lead(t, 1) OVER s || chr(10) || lead(t, 2) OVER s AS g
  FROM f WINDOW s AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS nth FROM w WHERE g IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos1, pos2]) AS pos FROM r WHERE nth > 1),
k AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS kept, count(*) AS n_lines, count(gone.pos) AS n_removed
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
