"""Removal of byte strings that start earlier elsewhere, by merged Burrows-Wheeler transforms.

A byte goes when a string of `length` bytes covers it that also starts earlier: in a
document of smaller id (nulls first), or in the same one before. Strings never cross
documents and are judged on the input.

1. Every window of `length` bytes has a lowest-hash gram; windows in a row with the same
   one form a run. Equal windows have equal lowest grams at equal offsets, so they are
   found among runs of one gram. Grams that occur once are dropped: most of the text.
2. Runs alike in every byte are counted before they move: one row per content goes on, with
   its first place and its count, also where a gram has a single content.
3. The contents of a gram that has several are dealt out by gram; one that is alone stays
   with its document, joined with its neighbours. A task sorts the suffixes of shards of them, each into a Burrows-Wheeler transform over symbols of length / 4
   bytes (hash order), and merges the transforms by refining their interleave: each of
   four passes deals the merged rows out by the symbol before them, which sorts by one
   symbol more, without sorting suffixes again. The pass in which two neighbours part is
   their common prefix; intervals with a common prefix of four symbols hold equal windows.
   Of an interval whose counts add up to two or more all but the first place go: in the first
   copies at once, and in the later copies by a join with what repeats in their content.

Runs of grams with more than HOT contents are not gathered by gram: each of their
windows gets the key (gram, its offset in the window, hash of the window), the first place
of a key is found before the shuffle, and the other places of repeated keys go. Texts are read whole. A null text is empty; documents
alike in doc_id and text are one document; other columns are ignored; shorter texts
than `length` lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import KEY, attach, load, row_key, text_slices
from sylvagrid.llm.hashing import gram_hashes, span_hashes
from sylvagrid.session import stage

LENGTH, GRAM = 100, 20
# compression of the staged tables, which are most of the disk
CODEC = "zstd"
# symbols of a window; a power of two, so that shards are sorted by doubling
DEPTH = 4
# bytes of texts or runs that a task works on at once (some 100 bytes of memory each), and of one shard of runs
BLOCK, SHARD = 1 << 20, 1 << 18
# differing runs of one gram that one task takes; the windows of grams with more are settled one by one
HOT = 20_000
# repeated grams (8 bytes each) up to this number are broadcast; above it the runs are shuffled
BROADCAST_GRAMS = 4_000_000
# positions that fit the low bits of a window's key; longer texts are read in overlapping pieces
PIECE_BITS = 23


def window_runs(x: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, end of bytes, place of the lowest gram, its hash) of each run of windows with one lowest gram."""
    starts, ends, grams, hashes = [], [], [], []
    step = 1 << PIECE_BITS
    for at in range(0, max(len(x) - length + 1, 0), step):
        piece, own = x[at : at + step + length - 1], owner[at : at + step + length - 1]
        h = gram_hashes(piece, gram)
        low = np.uint64((1 << (PIECE_BITS + 1)) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, wanted = 1, length - gram + 1
        while width * 2 <= wanted:
            key, width = np.minimum(key[:-width], key[width:]), width * 2
        if wanted > width:
            key = np.minimum(key[: width - wanted], key[wanted - width :])
        inside = np.flatnonzero(own[: len(key)] == own[length - 1 :])
        if not len(inside):
            continue
        place = (key[inside] & low).astype(np.int64)
        new = np.flatnonzero(np.append(True, (np.diff(inside) != 1) | (np.diff(place) != 0)))
        starts.append(inside[new] + at)
        ends.append(inside[np.append(new[1:], len(inside)) - 1] + length + at)
        grams.append(place[new] + at)
        hashes.append(h[place[new]])
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(map(np.concatenate, (starts, ends, grams, hashes)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the text of each byte and where each text begins."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts), dtype=np.int32), size), np.cumsum(size) - size


def _thin(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), F.col("text").cast("binary").alias("t"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Staged (key, start, size, lead, gram, content): the runs whose lowest gram occurs again."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, most=BLOCK):
            x, owner, _ = _joined(texts)
            got, n = np.unique(window_runs(x, owner, length, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], names=["gram", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, most=BLOCK):
            x, owner, begin = _joined(texts)
            start, end, place, h = window_runs(x, owner, length, gram)
            row = pa.array(owner[start] if len(start) else np.empty(0, np.int32))
            content = span_hashes(x, start, end)
            columns = [start - begin[owner[start]], end - start, place - start]
            yield pa.RecordBatch.from_arrays(
                [b[KEY[0]].take(row), b[KEY[1]].take(row), *[pa.array(c.astype(np.int32)) for c in columns], pa.array(h.view(np.int64)), pa.array(content.view(np.int64))],
                names=[*KEY, "start", "size", "lead", "gram", "content"],
            )

    thin = _thin(docs)
    again = thin.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    again = stage(again.select("gram"), "grams")
    if again.count() <= BROADCAST_GRAMS:
        again = F.broadcast(again)
    schema = f"{KEY[0]} {docs.schema['doc_id'].dataType.simpleString()}, {KEY[1]} long, start int, size int, lead int, gram long, content long"
    return stage(thin.mapInArrow(read, schema).join(again, "gram"), "runs", codec=CODEC)


def shard_transform(symbol: np.ndarray, before: np.ndarray, left: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard sorted by DEPTH symbols, and the symbol before each: its Burrows-Wheeler transform.

    `rows` are consecutive positions; `left` is how many bytes of its text follow a row.
    """
    rank, span = symbol[rows], width
    while span < width * DEPTH:
        follow = np.zeros(len(rows), np.int64)
        has = np.flatnonzero(left[rows] >= span)
        follow[has] = rank[has + span]
        rank, span = rank * (int(rank.max()) + 1) + follow, span * 2
        if span < width * DEPTH:
            rank = np.unique(rank, return_inverse=True)[1]
    order = rows[np.argsort(rank)]
    return order, before[order]


def merge_transforms(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge two transforms (rows, symbols before) by refining their interleave; the third array is the common prefix
    of each row with the one above, in symbols up to DEPTH."""
    rows, before = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    n, n_a = len(rows), len(a[0])
    second = np.arange(n) >= n_a
    block, common = np.zeros(n, np.int64), np.full(n, DEPTH, np.int8)
    counter = np.arange(n, dtype=np.uint64)

    def interleaved() -> np.ndarray:
        at = np.empty(n, np.int64)
        at[~second] = np.arange(n_a)
        at[second] = np.arange(n_a, n)
        return at

    for depth in range(DEPTH):
        symbols = before[interleaved()]
        # stable: equal symbols keep the order of the pass before
        order = (np.sort((symbols.astype(np.uint64) << np.uint64(32)) | counter) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        second, symbols, block = second[order], symbols[order], block[order]
        parts = np.append(True, (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1]))
        common[parts & (common == DEPTH)] = depth
        block = np.cumsum(parts)
    at = interleaved()
    return rows[at], before[at], common


def repeated_windows(texts: list[bytes], place: np.ndarray, copies: np.ndarray, length: int, merge: Callable = merge_transforms) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all texts, in order: whether an equal window has a smaller place, and whether it occurs twice or more.

    `place` is the place of each text's first window; those of the next ones follow it. `copies` is how often each window
    occurs, in the same order.
    """
    width = length // DEPTH
    size = np.array([len(t) + 1 for t in texts], np.int64)
    x = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    left = end[owner] - 1 - np.arange(len(x))  # bytes of the text from a row on
    full = np.flatnonzero(left >= width)
    symbol = np.zeros(len(x), np.int64)
    symbol[full] = np.unique(gram_hashes(x, width)[full], return_inverse=True)[1] + 1
    before = np.zeros(len(x), np.int64)
    inner = np.arange(len(x)) - (end - size)[owner] >= width
    before[inner] = symbol[np.flatnonzero(inner) - width]
    shards = min(len(texts), max(2, len(x) // SHARD))
    cut = np.append((end - size)[np.linspace(0, len(texts), shards, endpoint=False).astype(np.int64)], len(x))
    merged = [shard_transform(symbol, before, left, np.arange(lo, hi), width) for lo, hi in zip(cut, cut[1:])]
    common = None
    while len(merged) > 1:
        pairs = [merge(a, b) for a, b in zip(merged[::2], merged[1::2])]
        common = pairs[0][2]
        merged = [p[:2] for p in pairs] + (merged[-1:] if len(merged) % 2 else [])
    windows = np.flatnonzero(left >= length)
    if common is None:  # a single shard meets an empty one
        none = np.empty(0, np.int64)
        rows, _, common = merge(merged[0], (none, none))
        merged = [(rows, none)]
    interval = np.full(len(x), -1)
    interval[merged[0][0]] = np.cumsum(common < DEPTH)
    of = interval[windows]
    if (of < 0).any():  # rows that no merge gave back belong to no interval
        return np.zeros(len(windows), bool), np.zeros(len(windows), bool)
    at = place[owner[windows]] + windows - (end - size)[owner[windows]]
    order = np.lexsort((at, of))
    later = np.zeros(len(windows), bool)
    later[order] = np.append(False, np.diff(of[order]) == 0)
    times = np.bincount(of, weights=copies, minlength=1)
    return later, times[of] > 1


def stretches(marked: np.ndarray, owner: np.ndarray, offset: np.ndarray, length: int) -> tuple[list[int], list[int], list[int]]:
    """(text, start, end) of the bytes that windows in a row, all marked, cover."""
    new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (marked[1:] != marked[:-1])))
    last = np.append(new[1:], len(marked)) - 1
    first, last = new[marked[new]], last[marked[new]]
    return owner[first].tolist(), offset[first].tolist(), (offset[last] + length).tolist()


# decisions: without a content the bytes `start` to `end` of a document go; with one, the same bytes counted from the start
# of a run repeat, and go in all copies of that content but the first, which starts at `head` of the document
DECIDED = f"{KEY[1]} long, start int, end int, gram long, content long, head int"


def alone_cuts(b: pa.RecordBatch, texts: list[bytes], w: pa.StructArray, row: np.ndarray, length: int, merge: Callable) -> list[pa.Array]:
    """Decisions, without the key, about the contents that are the only one of their gram, and the row of each.

    No other document holds their windows, so they stay with their document: runs in a row are one text.
    """
    alone = np.flatnonzero(w.field("alone").to_numpy(zero_copy_only=False))
    columns = {c: w.field(c).to_numpy(zero_copy_only=False)[alone] for c in ("start", "size", "gram", "content", "n")}
    order = np.lexsort((columns["start"], row[alone]))
    columns, row = {c: v[order] for c, v in columns.items()}, row[alone][order]
    start, n = columns["start"].astype(np.int64), columns["size"].astype(np.int64) - length + 1
    first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (start[1:] != start[:-1] + n[:-1])))[: len(row)]
    last = np.append(first[1:], len(row)) - 1
    stitched = [texts[row[i]][start[i] : start[j] + n[j] + length - 1] for i, j in zip(first.tolist(), last.tolist())] if len(row) else []
    if not stitched:
        return [np.empty(0, np.int64)] * 6
    place = (row[first].astype(np.int64) << 32) + start[first]
    _, again = repeated_windows(stitched, place, np.repeat(columns["n"], n), length, merge)
    owner, offset = np.repeat(np.arange(len(row)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    run, lo, hi = (np.array(x, np.int64) for x in stretches(again, owner, offset, length))
    return [row[run], lo, hi, columns["gram"][run], columns["content"][run], start[run]]


def settled(contents: DataFrame, length: int, id_type: str, merge: Callable = merge_transforms) -> DataFrame:
    """(key, DECIDED): what repeats in the contents of grams that have several; a task holds all contents of a gram."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
        documents = sorted({r[:2] for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        number = {d: i for i, d in enumerate(documents)}
        place = np.array([(number[r[:2]] << 32) + r[2] for r in rows], np.int64)
        n = np.array([len(r[4]) - length + 1 for r in rows], np.int64)
        copies = np.array([r[6] for r in rows], np.int64)
        later, again = repeated_windows([r[4] for r in rows], place, np.repeat(copies, n), length, merge)
        owner, offset = np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out: list[list] = [[] for _ in range(7)]
        for i, lo, hi in zip(*stretches(later, owner, offset, length)):
            r = rows[i]
            for column, value in zip(out, (r[0], r[1], r[2] + lo, r[2] + hi, r[3], None, r[2])):
                column.append(value)
        for i, lo, hi in zip(*stretches(again & (copies > 1)[owner], owner, offset, length)):
            r = rows[i]
            for column, value in zip(out, (r[0], r[1], lo, hi, r[3], r[5], r[2])):
                column.append(value)
        types = [ids, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[*KEY, "start", "end", "gram", "content", "head"])

    ids = pa.int64() if id_type in ("bigint", "int") else pa.string()
    columns = [*KEY, "start", "gram", "text", "content", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, gram = [], 0, None
        for b in batches:
            for r in zip(*[b[c].to_pylist() for c in columns]):
                if size >= BLOCK and r[3] != gram:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size, gram = size + len(r[4]), r[3]
        if rows:
            yield settle(rows)

    dealt = contents.select(*columns).repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, f"{KEY[0]} {'bigint' if pa.types.is_integer(ids) else 'string'}, {DECIDED}")


def hot_cuts(contents: DataFrame, length: int, id_type: str) -> DataFrame:
    """The same for grams with more than HOT contents, window by window: no task needs all contents of a gram."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a window takes some 40 bytes, and a run has up to one window a byte
        for b, texts in text_slices(batches, "text", BLOCK):
            x, owner, begin = _joined(texts)
            h = gram_hashes(x, length)
            at = np.flatnonzero(owner[: len(h)] == owner[length - 1 :])
            row = pa.array(owner[at])
            offset = at - begin[owner[at]]
            start, lead = (b[c].to_numpy()[owner[at]] for c in ("start", "lead"))
            yield pa.RecordBatch.from_arrays(
                [
                    *[b[c].take(row) for c in (*KEY, "gram", "content", "n")],
                    pa.array((start + offset).astype(np.int32)),
                    pa.array(offset.astype(np.int32)),
                    pa.array((lead - offset).astype(np.int32)),
                    pa.array(h[at].view(np.int64)),
                ],
                names=[*KEY, "gram", "content", "n", "start", "offset", "lead", "window"],
            )

    schema = f"{KEY[0]} {id_type}, {KEY[1]} long, gram long, content long, n long, start int, offset int, lead int, window long"
    windows = contents.select(*KEY, "start", "gram", "content", "n", "lead", "text").mapInArrow(read, schema)
    key, place = ["gram", "lead", "window"], F.struct(*KEY, "start")
    heads = windows.groupBy(*key).agg(F.min(place).alias("head"), F.sum("n").alias("times")).where(F.col("times") > 1)
    again = windows.join(stage(heads, "heads"), key)
    # windows that start within `length` bytes touch, so that one stretch covers them
    first, near = again.where(place != F.col("head")), F.floor(F.col("start") / length)
    first = first.groupBy(*KEY, "gram", near.alias("near")).agg(F.min("start").alias("start"), (F.max("start") + length).alias("end"))
    first = first.select(*KEY, "start", "end", "gram", F.lit(None).cast("long").alias("content"), F.lit(0).alias("head"))
    near = F.floor(F.col("offset") / length)
    run = (F.col("start") - F.col("offset")).alias("head")
    copies = again.where("n > 1").groupBy(*KEY, "gram", "content", run, near.alias("near")).agg(F.min("offset").alias("start"), (F.max("offset") + length).alias("end"))
    return first.unionByName(copies.select(*KEY, "start", "end", "gram", "content", "head"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, merge: Callable = merge_transforms) -> DataFrame:
    """Staged facts by row key: `starts` and `ends` of the removed byte runs, merged and sorted."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = repeated_runs(docs, length, gram)
    # one row per run content of a gram: its first place and how often it occurs
    first = runs.groupBy("gram", "content").agg(F.min(F.struct(*KEY, "start", "size", "lead")).alias("r"), F.count(F.lit(1)).alias("n"))
    first = stage(first, "contents", codec=CODEC)
    many = first.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    variants = first.join(many, "gram").select("gram", "content", "n", "r.*", (F.col("k") > HOT).alias("hot"), (F.col("k") == 1).alias("alone"))
    entry = ["gram", "content", "n", "start", "size", "lead", "hot", "alone"]
    wanted = variants.groupBy(*KEY).agg(F.collect_list(F.struct(*entry)).alias("w"))
    fields = ["start", "gram", "content", "n", "lead", "hot"]
    types = {"start": pa.int32(), "gram": pa.int64(), "content": pa.int64(), "n": pa.int64(), "lead": pa.int32(), "hot": pa.bool_(), "text": pa.binary(), "end": pa.int32(), "head": pa.int32()}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, most=BLOCK):
            lists = b["w"]
            row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            w = lists.flatten()
            several = np.flatnonzero(~w.field("alone").to_numpy(zero_copy_only=False))
            at, part = pa.array(row[several]), w.take(pa.array(several))
            start, size = part.field("start").to_pylist(), part.field("size").to_pylist()
            text = [texts[i][s : s + n] for i, s, n in zip(at.to_pylist(), start, size)]
            none = pa.nulls(len(text), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b[KEY[0]].take(at), b[KEY[1]].take(at), *[part.field(c).cast(types[c]) for c in fields], pa.array(text, pa.binary()), none, none], names=[*KEY, *types]
            )
            at, lo, hi, grams, content, head = alone_cuts(b, texts, w, row, length, merge)
            known = dict(zip(("start", "end", "gram", "content", "head"), (lo, hi, grams, content, head)))
            columns = [pa.array(known[c], t) if c in known else pa.nulls(len(at), t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([b[KEY[0]].take(pa.array(at)), b[KEY[1]].take(pa.array(at)), *columns], names=[*KEY, *types])

    # the facts grow with the text: they meet it by a shuffle at every size
    rows = attach(docs, wanted, F.size("w"), "inner", most=-1).select(*KEY, "w", F.col("_row.text").cast("binary").alias("t"))
    schema = f"{KEY[0]} {id_type}, {KEY[1]} long, start int, gram long, content long, n long, lead int, hot boolean, text binary, end int, head int"
    contents = stage(rows.mapInArrow(cut_out, schema), "differing", codec=CODEC)
    decided = [*KEY, "start", "end", "gram", "content", "head"]
    cuts = contents.where("text IS NULL").select(*decided)
    contents = contents.where("text IS NOT NULL")
    cuts = cuts.unionByName(settled(contents.where(~F.col("hot")), length, id_type, merge).select(*decided))
    if not many.where(F.col("k") > HOT).isEmpty():
        cuts = cuts.unionByName(hot_cuts(contents.where("hot"), length, id_type).select(*decided))
    cuts = stage(cuts, "cuts", codec=CODEC)
    # what repeats in a content goes back to its later copies, which have not moved
    head = F.struct(*[F.col(k) for k in KEY], F.col("head").alias("start")).alias("head")
    back = cuts.where("content IS NOT NULL").select("gram", "content", F.col("start").alias("lo"), F.col("end").alias("hi"), head)
    later = runs.join(back, ["gram", "content"]).where(F.struct(*KEY, "start") != F.col("head"))
    later = later.select(*KEY, (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("end"))
    spans = later.unionByName(cuts.where("content IS NULL").select(*KEY, "start", "end"))
    gathered = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("s"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = [], []
            for s in b["s"]:
                lo, hi = merged_spans(*[s.values.field(c).to_numpy() for c in ("start", "end")])
                starts.append(lo)
                ends.append(hi)
            lists = [pa.array(c, pa.list_(pa.int32())) for c in (starts, ends)]
            yield pa.RecordBatch.from_arrays([b[KEY[0]], b[KEY[1]], *lists], names=[*KEY, "starts", "ends"])

    return stage(gathered.mapInArrow(merge, f"{KEY[0]} {id_type}, {KEY[1]} long, starts array<int>, ends array<int>"), "spans")


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def remaining(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, starts, ends, kept): removed byte runs (null: none) and the bytes that stay, per document row."""
    spans = repeated_spans(docs, length, gram)
    rows = attach(docs.select("doc_id", "text"), spans, F.size("starts")).select(
        "_row.doc_id", F.coalesce(F.col("_row.text").cast("binary"), F.lit(b"")).alias("t"), "starts", "ends"
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, most=BLOCK):
            kept = []
            for t, lo, hi in zip(texts, b["starts"].to_pylist(), b["ends"].to_pylist()):
                kept.append(t if lo is None else b"".join(t[i:j] for i, j in zip([0, *hi], [*lo, len(t)])))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["starts"], b["ends"], pa.array(kept, pa.binary())], names=["doc_id", "starts", "ends", "kept"])

    return rows.mapInArrow(keep, f"doc_id {id_type}, starts array<int>, ends array<int>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remaining(load(spark, sf_dir, "documents"))
    n_removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    n_removed = F.coalesce(n_removed, F.lit(0).cast("long"))
    return left.select(
        "doc_id",
        (F.octet_length("kept") + n_removed).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("starts")).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
