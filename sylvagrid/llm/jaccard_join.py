"""N-gram Jaccard join by grouped prefixes.

A document is the set of hashes of its distinct word shingles. Documents with the same
set are one node. Shingles are ordered by how often they occur (a sketch over all
documents; any order gives the same links), rare ones first. Two sets can only be similar
enough if their prefixes share a shingle; nodes with the same prefix and size are one
group, and groups whose positions and sizes cannot meet in any shingle are filtered
out before their members are expanded and verified on whole sets.

Only components are asked for, so pairs that are already connected need no check. In
every shingle's bucket the least deviating member leads first and is compared with the
others; then members outside its component lead, more of them in each round, and
a bucket is finished when one component is left of those that have not led. Every pair
that could link is thereby compared or already connected, and a bucket of m near copies
costs about m comparisons.

Texts are read whole. Documents without words, and nulls, have an empty set and link
with nothing; with fewer words than a shingle the whole sequence is one. Documents alike
in doc_id and text are one document; null ids count as larger than any id when a
component is named, and a component of null ids has a null name. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import BROADCAST_ENTRIES, KEY, attach, load, row_key, text_slices
from sylvagrid.llm.components import components
from sylvagrid.llm.hashing import gram_hashes, mixed, word_hashes
from sylvagrid.session import stage

# words per shingle and least similarity of the near-duplicate stage, unless told otherwise
SHINGLE, SIMILARITY = 5, Fraction(80, 100)
# counters of the frequency sketch; they order shingles and so change cost, never links
SKETCH_BITS, SKETCH_BLOCK_BITS = 20, 14
# each round has so many times the leaders of the one before
GROWTH = 8


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, words between ASCII white space."""
    h, n = word_hashes(texts)
    ends = np.cumsum(n)
    grams = gram_hashes(h, k)
    out = []
    for size, end in zip(n.tolist(), ends.tolist()):
        if size >= k:
            out.append(np.unique(grams[end - size : end - k + 1]))
        elif size:
            # mixed with its length: never equal to a shingle of k words
            out.append(mixed(gram_hashes(h[end - size : end], size) ^ np.uint64(size)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """64-bit hashes as one column of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))


def needed(n: int, similarity: Fraction) -> int:
    """Least number of shared shingles of a set of `n` with any similar set."""
    return -(-similarity.numerator * n // similarity.denominator)


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), F.col("text").cast("binary").alias("t"))


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Occurrences per hash bucket over all documents: a table of fixed size, summed by blocks on the executors."""
    block = 1 << SKETCH_BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in text_slices(batches):
            grams = np.concatenate(shingle_sets(texts, k))
            np.add.at(total, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        used = [i for i in range(len(total) // block) if total[i * block : (i + 1) * block].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([total[i * block : (i + 1) * block].tobytes() for i in used], pa.binary())], names=["block", "n"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b["block"].to_pylist(), b["n"].to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "n"])

    schema = "block int, n binary"
    # each task has one row per block; a block's rows are summed in one task, 1/64 of all
    parts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, schema)
    summed = parts.repartition("block").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in summed.collect():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.n, np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefix_table(docs: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """Staged (key, n, node, grp, prefix): set size, fingerprint of the set, fingerprint of (size, prefix), prefix."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = sketch.value
        for b, texts in text_slices(batches):
            sets = shingle_sets(texts, k)
            prefixes = []
            for s in sets:
                often = frequency[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                length = len(s) - needed(len(s), similarity) + 1 if len(s) else 0
                prefixes.append(s[np.lexsort((s, often))[:length]])
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            groups = [xxhash.xxh3_128_digest(p.tobytes(), seed=len(s)) for s, p in zip(sets, prefixes)]
            columns = [
                b[KEY[0]],
                b[KEY[1]],
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array(names, pa.binary()),
                pa.array(groups, pa.binary()),
                _lists(prefixes),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "n", "node", "grp", "prefix"])

    schema = f"{KEY[0]} {docs.schema['doc_id'].dataType.simpleString()}, {KEY[1]} long, n int, node binary, grp binary, prefix array<long>"
    return stage(_thin(docs).mapInArrow(run, schema), "prefixes")


def _could_meet(entries: DataFrame) -> DataFrame:
    """Drop entries of buckets without a partner whose size and position allow a link."""
    bucket = entries.groupBy(F.col("tok").alias("_tok")).agg(F.sum("members").alias("_m"), F.min("n").alias("_n"), F.max("hi").alias("_hi"))
    bucket = bucket.where(F.col("_m") > 1)
    met = entries.join(bucket, F.col("tok") == F.col("_tok")).where((F.col("hi") >= F.col("_n")) & (F.col("n") <= F.col("_hi")))
    return met.select(*entries.columns)


def open_entries(table: DataFrame, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n, grp, first key) and the staged entries (tok, node, n, hi) of those that may have a partner.

    `hi` is the largest partner that the position still allows: with position i of n,
    at most n - i shingles are shared, and a partner of size m needs
    s / (1 + s) * (n + m) of them. A pair may link only if each is within the other's `hi`.
    """
    num, den = similarity.numerator, similarity.denominator
    some = table.where(F.col("n") > 0)
    nodes = some.groupBy("node").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.min(F.struct(*KEY)).alias("key"))
    nodes = stage(nodes, "nodes")
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    one = nodes.groupBy("grp").agg(F.min("key").alias("_k")).select("grp", "_k.*")
    # the prefix of one document speaks for its group
    groups = some.select(*KEY, "n", "grp", "prefix").join(
        one.withColumnsRenamed({KEY[0]: "_d", KEY[1]: "_h", "grp": "_g"}),
        (F.col("grp") == F.col("_g")) & F.col(KEY[0]).eqNullSafe(F.col("_d")) & (F.col(KEY[1]) == F.col("_h")),
        "left_semi",
    )
    groups = groups.dropDuplicates(["grp"]).join(sizes, "grp")
    entries = groups.select("grp", "n", "members", F.posexplode_outer("prefix").alias("i", "tok"))
    shared = F.col("n") - F.col("i")
    hi = F.floor(((num + den) * shared.cast("long") - num * F.col("n").cast("long")) / num).cast("int")
    entries = entries.select("tok", "grp", "n", "members", hi.alias("hi"))
    entries = stage(_could_meet(entries), "entries")
    entries = stage(_could_meet(entries), "entries")
    expanded = entries.join(nodes.select("grp", "node"), "grp").select("tok", "node", "n", "hi")
    return nodes, stage(expanded, "open")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b, linked): pairs of nodes compared on their whole sets. Only the sets of these nodes move."""
    num, den = similarity.numerator, similarity.denominator
    pairs = stage(pairs, "pairs")
    if pairs.count() <= BROADCAST_ENTRIES:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    total = F.size("x") + F.size("y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", ((num + den) * shared >= num * total).alias("linked"))


def _ends(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(ca, cb): labels that links connect and that differ, in both directions."""
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
    ends = ends.join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").select("ca", "cb")
    ends = ends.where(F.col("ca") != F.col("cb"))
    return ends.unionByName(ends.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels after some links: each label goes to the smallest one at most two links away.

    Labels may still differ within a component, which costs comparisons and loses none.
    """
    ends = _ends(comp, links)
    low = ends.groupBy(F.col("ca").alias("via")).agg(F.min("cb").alias("low")).select("via", F.least("via", "low").alias("low"))
    new = ends.join(low, F.col("cb") == F.col("via")).groupBy("ca").agg(F.min(F.least("low", "cb")).alias("new"))
    moved = comp.join(new, F.col("comp") == F.col("ca"), "left")
    return stage(moved.select("node", F.coalesce(F.least("new", "comp"), "comp").alias("comp")), "labels")


def node_components(docs: DataFrame, entries: DataFrame, nodes: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """(node, root) of the nodes of `entries`; every link that joins two of them is verified."""
    wanted = entries.select("node").distinct().join(nodes, "node").select("node", "key.*")
    sets = stage(_sets_of(docs, wanted, k), "sets")
    n, distinct = sets.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if n > distinct:  # rows that repeat in id and text
        sets = stage(sets.dropDuplicates(["node"]), "sets")
    comp = stage(sets.select("node", F.col("node").alias("comp")), "labels")
    live, checked, leaders = entries, None, 1
    while True:
        labelled = live.join(comp, "node")
        bucket = labelled.groupBy(F.col("tok").alias("_tok")).agg(
            F.min("n").alias("_n"),
            F.max("hi").alias("_hi"),
            F.min("comp").alias("_c0"),
            F.max("comp").alias("_c1"),
            F.max_by("comp", F.struct("hi", "node")).alias("_core"),
        )
        bucket = bucket.where(F.col("_c0") != F.col("_c1"))
        labelled = labelled.join(bucket, F.col("tok") == F.col("_tok")).where((F.col("hi") >= F.col("_n")) & (F.col("n") <= F.col("_hi")))
        labelled = stage(labelled.select("tok", "node", "n", "hi", "comp", (F.col("comp") == F.col("_core")).alias("core")), "live")
        # first the least deviating member of a bucket, later members outside its component
        able = labelled if leaders == 1 else labelled.where(~F.col("core"))
        slot = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders))
        lead = able.groupBy("tok", slot.alias("slot")).agg(F.max(F.struct("hi", "node", "n", "comp")).alias("l"))
        lead = stage(lead.select("tok", F.col("l.node").alias("ln"), F.col("l.n").alias("lsize"), F.col("l.hi").alias("lhi"), F.col("l.comp").alias("lc")), "leaders")
        if lead.isEmpty():
            break
        met = labelled.join(lead, "tok").where(
            (F.col("node") != F.col("ln")) & (F.col("comp") != F.col("lc")) & (F.col("n") <= F.col("lhi")) & (F.col("lsize") <= F.col("hi"))
        )
        pairs = met.select(F.least("node", "ln").alias("a"), F.greatest("node", "ln").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        now = stage(_verified(pairs, sets, similarity), "verified")
        checked = now if checked is None else checked.unionByName(now)
        comp = _relabelled(comp, now.where("linked").select("a", "b"))
        done = lead.select(F.col("tok").alias("_t"), "ln")
        live = labelled.join(done, (F.col("tok") == F.col("_t")) & (F.col("node") == F.col("ln")), "left_anti").select("tok", "node", "n", "hi")
        leaders *= GROWTH
    if checked is None:
        return comp.withColumnRenamed("comp", "root")
    # the labels are nearly final; links between different ones settle the rest
    ends = _ends(comp, checked.where("linked").select("a", "b"))
    roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return comp.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set): whole shingle sets, read from the text of one document of each wanted node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b["node"], _lists(shingle_sets(texts, k))], names=["node", "set"])

    rows = attach(docs.select("doc_id", "text"), wanted, how="inner").select("node", F.col("_row.text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "node binary, set array<long>")


def document_classes(docs: DataFrame, k: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(key, n, component): per document row the size of its set and the smallest id of its component.

    `component` is a struct of the first key (doc_id, hash) in the component; `least` its smallest doc_id.
    """
    docs = docs.select("doc_id", "text")
    table = prefix_table(docs, k, similarity)
    nodes, entries = open_entries(table, similarity)
    roots = node_components(docs, entries, nodes, k, similarity)
    rooted = nodes.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min(F.when(F.col(f"key.{KEY[0]}").isNotNull(), F.col("key"))).alias("named"), F.min("key").alias("any"))
    named = rooted.join(least, "root").select("node", F.coalesce("named", "any").alias("component"))
    own = F.struct(*KEY)
    return (
        table.select(*KEY, "n", "node")
        .join(stage(named, "named"), "node", "left")
        .select(*KEY, "n", F.when(F.col("n") == 0, own).otherwise(F.col("component")).alias("component"))
    )


def keep_one_of_each(docs: DataFrame, k: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One document of each component (the smallest id), with all its columns; one row of rows alike in id and text."""
    classes = document_classes(docs, k, similarity)
    spare = classes.where(F.struct(*KEY) != F.col("component")).select(*KEY).distinct()
    left = attach(docs, spare, how="left_anti").select("_row.*")
    again = stage(classes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*KEY), "again")
    if again.isEmpty():
        return left
    one = attach(left, again, how="inner").dropDuplicates(list(KEY)).select("_row.*")
    return attach(left, again, how="left_anti").select("_row.*").unionByName(one)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = document_classes(load(spark, sf_dir, "documents"), k=4, similarity=Fraction(85, 100))
    return classes.select(
        F.col(KEY[0]).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col(f"component.{KEY[0]}").alias("component_id")
    )
