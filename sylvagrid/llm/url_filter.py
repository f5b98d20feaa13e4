"""URL block lists as a sort-merge range join.

A host is reversed label by label (`com.example.m.`), so a rule's host and all its
subdomains are one interval of keys, and intervals are nested or disjoint. Urls and
rules are sorted by key together; a sweep keeps the stack of rules whose interval is
open. A url looks its path up in the rules on the stack only; the longest rule wins.

Cut points from a bounded sample of keys (id hash as tie-break, so one host may fill
many parts) place the urls; they balance the parts and change no result. A rule goes
to every part that its interval meets, so each part is swept by itself, row by row.

A url is judged by host and path as `host_of` and `path_of` give them; null, or without
`://`, both are empty and no rule fits. Of rules alike in host and path the blocking one
counts. Rules with a null or empty host, or a null action, are ignored; a null path is `/`. Rows repeat as
given; without rules every url gets the default verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import LOWER, UPPER, load, partitions

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT = "allow"
# keys read per part to place the cut points
SAMPLE_PER_PART = 64
# sorts after every key that starts with the text before it
END = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """`m.example.com` as `com.example.m.`; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def with_verdict(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) for `urls` (id, url) and `rules` (host, path, action)."""
    spark = urls.sparkSession
    parts = partitions(spark)
    url = F.col("url")
    keyed = urls.select(F.col("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64("id", "url").alias("tie"))
    keyed = keyed.withColumn("key", host_key(F.col("host")))
    # a bounded sample, the same for every run: the smallest hashes
    sample = keyed.select("key", "tie").orderBy(F.xxhash64("tie", F.lit(1))).limit(SAMPLE_PER_PART * parts)
    seen = sorted((r.key, r.tie) for r in sample.collect())
    cuts = [seen[i * len(seen) // parts] for i in range(1, parts)] if seen else []
    host = F.translate("host", UPPER, LOWER)
    known = rules.where((F.col("host") != "") & F.col("action").isNotNull()).select(
        host_key(host).alias("key"), host.alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "action"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(cuts, k) for k in zip(b["key"].to_pylist(), b["tie"].to_pylist())]
            yield b.append_column("part", pa.array(at, pa.int32()))

    def open_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rules, once for every part that their interval meets."""
        low = float("-inf")
        for b in batches:
            rows, at = [], []
            for i, key in enumerate(b["key"].to_pylist()):
                met = range(bisect_left(cuts, (key, low)), bisect_right(cuts, (key + END, low)) + 1)
                rows += [i] * len(met)
                at += met
            yield b.take(pa.array(rows, pa.int64())).append_column("part", pa.array(at, pa.int32()))

    placed = keyed.mapInArrow(place, f"id {urls.schema['id'].dataType.simpleString()}, host string, path string, tie long, key string, part int")
    opened = known.mapInArrow(open_in, "key string, host string, path string, action string, part int")
    both = opened.select("part", "key", F.lit(0).alias("kind"), "host", "path", "action", F.lit(None).cast(urls.schema["id"].dataType).alias("id"))
    both = both.unionByName(placed.select("part", "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("action"), "id"))
    swept = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind")
    return swept.mapInArrow(
        lambda batches: sweep(batches, default),
        f"id {urls.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string",
    )


class Open:
    """The rules of one host while its interval is open: action by path, and the lengths of the paths."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.actions: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, action: str) -> None:
        if self.actions.get(path) != "block":
            self.actions[path] = action
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if path[:n] in self.actions), None)


def sweep(batches: Iterator[pa.RecordBatch], default: str = DEFAULT) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, kind); rules (kind 0) come before the urls of the same key."""
    stack: list[Open] = []
    part = None
    for b in batches:
        out: list[list] = [[], [], []]
        keys, hosts, paths, actions = (b[c].to_pylist() for c in ("key", "host", "path", "action"))
        for i, (p, kind) in enumerate(zip(b["part"].to_pylist(), b["kind"].to_pylist())):
            if p != part:
                part, stack = p, []
            while stack and not keys[i].startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != keys[i]:
                    stack.append(Open(keys[i], hosts[i]))
                stack[-1].add(paths[i], actions[i])
                continue
            rule, verdict = None, default
            for level in reversed(stack):
                found = level.longest(paths[i])
                if found is not None and (rule is None or len(level.host + found) > len(rule)):
                    rule, verdict = level.host + found, level.actions[found]
            for column, x in zip(out, (i, rule, verdict)):
                column.append(x)
        rows = b.take(pa.array(out[0], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [rows["id"], rows["host"], rows["path"], pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
            names=["id", "host", "path", "rule", "verdict"],
        )


def drop_blocked(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """The pages whose url is not blocked, with all their columns; urls alike get the same verdict."""
    judged = with_verdict(pages.select(F.col("url").alias("id"), "url").distinct(), rules)
    blocked = judged.where(F.col("verdict") == "block").select(F.col("id").alias("_url"))
    return pages.join(blocked, pages["url"] == blocked["_url"], "left_anti")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return with_verdict(urls, rules).withColumnRenamed("id", "page_id")


OP9_SQL = r"""
WITH r(host, path, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
