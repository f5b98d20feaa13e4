"""Merkle fixity audit of archive replicas.

Records (file, offset, length, digest) hash into a tree per file: a leaf covers
`leaf_bytes` of offsets, a node of the next level `fanout` nodes. Replicas compare
their roots first, then only the children of nodes that differ, down to the leaves;
only the records of differing leaves meet. Nodes are placed by offset, not by rank,
so a file with a third of all records needs no ordering across tasks, and digests of
a level are reduced before they move.

Alike records (same offset, length, digest) count as one. Null files and offsets match
each other; a null payload hashes as empty; a record that one replica lacks is
`missing` or `extra`. Empty replicas have no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.llm.common import load
from sylvagrid.session import stage

LEAF_BYTES, FANOUT = 1 << 16, 16
RECORD = ("file", "offset", "length", "digest")


def record_digests(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(file, offset, length, digest) of records with a binary payload; the rest of the columns is ignored."""
    data = F.coalesce(F.col(payload), F.lit(b""))
    return records.select("file", "offset", "length", F.unhex(F.sha2(data, 256)).alias("digest")).distinct()


def leaf_level(records: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(file, node, hash): one row per range of `leaf_bytes` that has records.

    A range holds its records and their alike copies once, so at most as many entries
    as bytes; their order is that of (offset, length, digest).
    """
    entry = F.struct("offset", "length", "digest")
    ordered = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda r: F.concat_ws(":", r.offset.cast("string"), r.length.cast("string"), F.hex(r.digest)),
    )
    node = F.floor(F.col("offset") / leaf_bytes).cast("long")
    return records.groupBy("file", node.alias("node")).agg(F.sha2(F.array_join(ordered, ",").cast("binary"), 256).alias("hash"))


def parent_level(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes above: each hashes the numbers and hashes of its at most `fanout` children in order."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws(":", c.node.cast("string"), c.hash))
    up = F.floor(F.col("node") / fanout).cast("long")
    return level.groupBy("file", up.alias("node")).agg(F.sha2(F.array_join(children, ",").cast("binary"), 256).alias("hash"))


def merkle_levels(records: DataFrame, height: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels 0 (leaves) to `height` (one root per file), staged."""
    levels = [stage(leaf_level(records, leaf_bytes), "leaves")]
    for _ in range(height):
        levels.append(stage(parent_level(levels[-1], fanout), "nodes"))
    return levels


def tree_height(last: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node covers offsets 0 to `last`."""
    height, nodes = 0, last // leaf_bytes + 1
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // fanout)
    return height


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    a, b = ours.alias("a"), theirs.alias("b")
    on = F.col("a.file").eqNullSafe(F.col("b.file")) & F.col("a.node").eqNullSafe(F.col("b.node"))
    differ = ~F.col("a.hash").eqNullSafe(F.col("b.hash"))
    both = a.join(b, on, "full").where(differ)
    some = F.col("a.hash").isNotNull()
    return both.select(
        F.when(some, F.col("a.file")).otherwise(F.col("b.file")).alias("file"),
        F.when(some, F.col("a.node")).otherwise(F.col("b.node")).alias("node"),
    )


def _below(rows: DataFrame, parent: Column, nodes: DataFrame) -> DataFrame:
    """The rows whose parent is one of `nodes`."""
    tagged = rows.withColumn("_up", parent)
    picked = nodes.withColumnsRenamed({"file": "_file", "node": "_node"})
    on = tagged["file"].eqNullSafe(picked["_file"]) & tagged["_up"].eqNullSafe(picked["_node"])
    return tagged.join(picked, on, "left_semi").drop("_up")


def audit(ours: DataFrame, theirs: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, length, digest, other_length, other_digest, status) of every record that differs.

    `ours` and `theirs` are tables of RECORD columns. Status: changed, missing (in
    theirs) or extra. Where an offset has several records on a side, each that the
    other side lacks is listed.
    """
    ours, theirs = (stage(x.select(*RECORD).distinct(), "records") for x in (ours, theirs))
    last = max(x.agg(F.max("offset")).first()[0] or 0 for x in (ours, theirs))
    height = tree_height(last, leaf_bytes, fanout)
    a, b = (merkle_levels(x, height, leaf_bytes, fanout) for x in (ours, theirs))
    nodes = stage(_differing(a[height], b[height]), "differing")
    for level in range(height - 1, -1, -1):
        up = F.floor(F.col("node") / fanout).cast("long")
        nodes = stage(_differing(_below(a[level], up, nodes), _below(b[level], up, nodes)), "differing")
    leaf = F.floor(F.col("offset") / leaf_bytes).cast("long")
    x, y = _below(ours, leaf, nodes), _below(theirs, leaf, nodes)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in RECORD]
    only_x = x.alias("x").join(y.alias("y"), same[0] & same[1] & same[2] & same[3], "left_anti")
    only_y = y.alias("y").join(x.alias("x"), same[0] & same[1] & same[2] & same[3], "left_anti")
    p, q = only_x.alias("p"), only_y.alias("q")
    pair = p.join(q, F.col("p.file").eqNullSafe(F.col("q.file")) & F.col("p.offset").eqNullSafe(F.col("q.offset")), "full")
    here, there = F.col("p.digest").isNotNull(), F.col("q.digest").isNotNull()
    return pair.select(
        F.when(here, F.col("p.file")).otherwise(F.col("q.file")).alias("file"),
        F.when(here, F.col("p.offset")).otherwise(F.col("q.offset")).alias("offset"),
        F.col("p.length").alias("length"),
        F.hex("p.digest").alias("digest"),
        F.col("q.length").alias("other_length"),
        F.hex("q.digest").alias("other_digest"),
        F.when(here & there, "changed").when(here, "missing").otherwise("extra").alias("status"),
    )


# an archive file of the derived replicas holds so many consecutive page ids
PAGES_PER_FILE = 1000


def archive_records(pages: DataFrame) -> DataFrame:
    """Pages as archive records: a header line with the url, then the page; files of consecutive page ids.

    Offsets are running lengths within a file, which holds PAGES_PER_FILE ids. Pages
    without an id go to files of negative numbers by a hash of their content.
    """
    payload = F.concat(F.lit("WARC/1.1 response\r\n"), F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")))
    rows = pages.select(
        "page_id",
        F.floor(F.coalesce("page_id", -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 60))) / PAGES_PER_FILE).cast("long").alias("file"),
        payload.cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"length": F.octet_length("payload").cast("long"), "_digest": F.sha2("payload", 256)})
    before = W.partitionBy("file").orderBy("page_id", "_digest").rowsBetween(W.unboundedPreceding, -1)
    thin = rows.select("page_id", "file", "length", F.unhex("_digest").alias("digest"), "_digest")
    return thin.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("_digest")


def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archived pages against a replica in which some records went wrong.

    The replica is derived from the pages: of every 97 ids one record has changed
    bytes, of every 211 one is lost, of every 301 one was written over by other bytes
    of another length. Length 0 and a null digest stand for a record that a side lacks.
    """
    ours = stage(archive_records(load(spark, sf_dir, "pages")), "archive")
    page = F.col("page_id")
    wrong = F.when(page % 97 == 5, F.unhex(F.sha2(F.concat(F.col("digest"), F.lit(b"!")), 256))).when(
        page % 301 == 7, F.unhex(F.sha2(F.concat(F.lit(b"?"), F.col("digest")), 256))
    )
    theirs = ours.where(~F.coalesce(page % 211 == 11, F.lit(False))).select(
        "file",
        "offset",
        F.when((page % 301 == 7) & (page % 97 != 5), F.col("length") + 1).otherwise(F.col("length")).alias("length"),
        F.coalesce(wrong, F.col("digest")).alias("digest"),
    )
    found = audit(ours.select(*RECORD), theirs)
    return found.select(
        "file",
        "offset",
        F.coalesce("length", F.lit(0).cast("long")).alias("length"),
        F.coalesce("other_length", F.lit(0).cast("long")).alias("other_length"),
        F.lower("digest").alias("digest"),
        F.lower("other_digest").alias("other_digest"),
        "status",
    )


OP10_SQL = f"""
WITH p AS (
  SELECT page_id, page_id // {PAGES_PER_FILE} AS file,
         'WARC/1.1 response' || chr(13) || chr(10) || coalesce(url, '') || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS payload
  FROM pages),
r AS (
  SELECT page_id, file, strlen(payload) AS length, sha256(payload) AS digest,
         CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM p)
SELECT file, "offset", length,
       CASE WHEN page_id % 211 = 11 THEN 0 WHEN page_id % 97 = 5 THEN length WHEN page_id % 301 = 7 THEN length + 1 END AS other_length,
       digest,
       CASE WHEN page_id % 211 = 11 THEN NULL WHEN page_id % 97 = 5 THEN sha256(unhex(digest || '21')) ELSE sha256(unhex('3f' || digest)) END AS other_digest,
       CASE WHEN page_id % 211 = 11 THEN 'missing' ELSE 'changed' END AS status
FROM r WHERE page_id % 97 = 5 OR page_id % 211 = 11 OR page_id % 301 = 7
"""
