"""What the training-data operators share: table access, row keys, checked broadcasts, byte-level word rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# bytes of a UTF-8 text outside words (words: digits, letters and all code points from U+0080) become spaces
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
# names of the row key that facts about a document are joined back by
KEY = ("_doc", "_hash")
# facts of at most so many array entries and rows (8 to 24 bytes each) may be broadcast; above it they are shuffled
BROADCAST_ENTRIES = 2_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: str = "text") -> list[Column]:
    """Key of a document row: its id and a hash of its text. Rows alike in both get the same facts."""
    return [F.col("doc_id").alias(KEY[0]), F.xxhash64(F.col(text)).alias(KEY[1])]


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """`wanted`, with underscores before it until no column has that name."""
    lowered = {t.lower() for t in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def attach(docs: DataFrame, facts: DataFrame, entries: Column | None = None, how: str = "left", most: int = BROADCAST_ENTRIES) -> DataFrame:
    """Join facts, unique by row key, to the documents with that key. Null ids match each other.

    The facts are staged and measured: up to `most` entries they are
    broadcast, so that texts stay where they are; beyond it both sides are shuffled.
    The columns of `docs` come first and keep their names.
    """
    facts = stage(facts, "facts")
    size = facts.agg(F.sum(entries if entries is not None else F.lit(1))).first()[0] or 0
    if size <= most:
        facts = F.broadcast(facts)
    doc, text_hash = row_key()
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), doc.alias("_d"), text_hash.alias("_h"))
    on = left["_d"].eqNullSafe(facts[KEY[0]]) & (left["_h"] == facts[KEY[1]])
    return left.join(facts, on, how)


def words_of(text: str = "text") -> Column:
    """Words of digits, a-z (A-Z lower-cased) and code points from U+0080; none for a null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def word_count(text: str = "text") -> Column:
    """Number of `words_of`, without building them."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "t", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about `most` bytes of text, at least one row each, and their texts; a text is never cut."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            read = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, read + most, side="right")))
            part = b.slice(start, end - start)
            yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
            start = end
