"""Alignment of two tokenizers over a corpus, as an Arrow pipeline.

Every text is encoded by two public vocabularies. The token lists of a batch are flattened beside
their parent indices, byte lengths become end offsets by segmented cumulative sums, and an outer
Acero hash join on document-end keys lays both tokenizations on one line: an end that both have
closes a group, and each interval between neighbouring ends lies in one token of either side, a
link. Links are counted per document by Table.group_by; how many documents hold an id pair is
counted per batch by Table.group_by and merged by Spark.

Neither vocabulary merges across a space that follows another character, so texts are cut there and
frequent pieces are encoded once, new ones many at a time as one text (checked when the vocabulary
is loaded; the joined bytes of every document are compared with its text). Documents beyond `AT_ONCE` bytes are aligned in parts that
end at such spaces, one after the other.

The counts of id pairs grow with the variety of the corpus. They are staged and counted: up to
PAIRS of them (17 bytes each) go to all tasks as sorted arrays, more are joined by shuffle with the
pairs of the documents. A document holds a pair once, so no pair is a hot key by itself.

Nulls and odd cases: a text that is null, empty, not valid UTF-8, or that either vocabulary does not
give back byte for byte (as one with U+2581) has no tokens: zeros, and an empty digest. A null id
stays null, repeated rows count as documents of their own, ties of the highest count all count, an
empty table gives an empty result, and other columns are ignored. A run of any length without
spaces is one piece and has to fit into the memory of a task.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.llm.common import load, text_slices
from sylvagrid.session import scratch, stage

TOKENIZERS = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# pairs of token ids whose counts may go to every task
PAIRS = 2_000_000
# bytes of text that are aligned at once, pieces that a worker remembers, pieces encoded in one run, pairs counted before they leave a task
AT_ONCE, REMEMBERED, RUN, COUNTED = 1 << 20, 1 << 18, 1 << 8, 1 << 20
SPACE = re.compile(r"(?<=\S) ")
MARK = "▁"
END = 40  # bits of an end offset in a document-end key
FACTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbers(dict):
    """Number of a piece by lookup; a new piece gets the next number."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the pieces encoded so far."""

    def __init__(self, folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, first))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, second))
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_a = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size = [np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.mark = self.b.piece_to_id(MARK)
        # a piece that goes on with a space after another character would cross a cut
        crossing = [re.search(f"[^{MARK}]{MARK}", p) for p in pieces] + [re.search(r"\S ", t.decode("utf-8", "replace")) for t in self.bytes_a]
        self.cuts = not any(crossing)
        strings = [f"{i}{s}" for i in range(max(len(names), len(pieces))) for s in (",", "|", ";", "")]
        self.strings = pa.array(strings)
        self.forget()

    def forget(self) -> None:
        self.at = Numbers()
        self.flat = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.starts, self.counts = ([np.empty(0, np.int64)] * 2 for _ in range(2))
        self.same = np.empty(0, bool)  # both sides give the piece back
        self.open = np.empty(0, bool)  # no cut may follow: the piece is empty or ends in white space

    def one_by_one(self, pieces: Sequence[str]) -> tuple[list[list[np.ndarray]], list[bool]]:
        """Per side the tokens and token counts of pieces, each encoded by itself behind a space, and which of them both sides give back."""
        first = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        second = self.b.encode(list(pieces), num_threads=1) if pieces else []
        second = [ids if p else [self.mark] for p, ids in zip(pieces, second)]
        raw = [b" " + p.encode("utf-8", "replace") for p in pieces]
        same = [
            b"".join(map(self.bytes_a.__getitem__, x)) == r and b"".join(map(self.bytes_b.__getitem__, y)) == r
            for x, y, r in zip(first, second, raw)
        ]
        return [[np.array(list(chain.from_iterable(got)), np.int64), np.array([len(g) for g in got], np.int64)] for got in (first, second)], same

    def as_a_run(self, pieces: Sequence[str]) -> list[list[np.ndarray]] | None:
        """Per side the tokens and token counts of pieces that a cut may follow, encoded as one text; None if a side does not give it back.

        The ends of the pieces part its tokens, as no token crosses a cut.
        """
        text = " ".join(pieces)
        raw = b" " + text.encode("utf-8", "replace")
        sides = [self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)]
        ends = np.cumsum([1 + (len(p) if p.isascii() else len(p.encode("utf-8", "replace"))) for p in pieces])
        out = []
        for got, decoded, size in zip(sides, (self.bytes_a, self.bytes_b), self.size):
            if b"".join(map(decoded.__getitem__, got)) != raw:
                return None
            flat = np.array(got, np.int64)
            upto = np.cumsum(size[flat])
            last = np.searchsorted(upto, ends)
            if (upto[last] != ends).any():
                return None
            out.append([flat, np.diff(last, prepend=-1)])
        return out

    def remember(self, pieces: Sequence[str]) -> None:
        """Encode new pieces, each as behind a space: in runs where a cut may follow, else one by one."""
        ends_open = np.array([not p or p[-1].isspace() for p in pieces], bool)
        # what a side may not give back is not ASCII, as a rule, and keeps to runs of its own
        kind = np.where(ends_open, 2, [not p.isascii() for p in pieces])
        order, kinds = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=3)
        tokens, good = [], []
        for k, group in enumerate(np.split(order, np.cumsum(kinds)[:-1])):
            for i in range(0, len(group), RUN):
                run = [pieces[j] for j in group[i : i + RUN]]
                got, same = self.as_a_run(run) if self.cuts and k < 2 else None, [True] * len(run)
                if got is None:
                    got, same = self.one_by_one(run)
                tokens.append(got)
                good += same
        new = np.empty(len(pieces), np.int64)
        for s in range(2):
            n = np.concatenate([np.empty(0, np.int64), *[got[s][1] for got in tokens]])
            for kept, values in ((self.starts, len(self.flat[s]) + np.cumsum(n) - n), (self.counts, n)):
                new[order] = values
                kept[s] = np.concatenate([kept[s], new])
            self.flat[s] = np.concatenate([self.flat[s], *[got[s][0] for got in tokens]])
        same = np.empty(len(pieces), bool)
        same[order] = good
        self.same = np.concatenate([self.same, same])
        self.open = np.concatenate([self.open, ends_open])

    def numbered(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has."""
        if len(self.at) > REMEMBERED or len(self.flat[0]) > 16 * REMEMBERED:
            self.forget()
        n = np.array([len(p) for p in texts], np.int64)
        known = len(self.at)
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        if len(self.at) > known:
            self.remember(list(self.at)[known:])
        return ids, n

    def encode(self, texts: list[str]) -> tuple[list[pa.ListArray], np.ndarray]:
        """Token lists of both sides, and which texts both sides give back; the others have empty lists."""
        pieces = [t.split(" ") if self.cuts else [t] for t in texts]
        ids, n = self.numbered(pieces)
        if self.cuts:
            last = np.cumsum(n) - 1
            wrong = self.open[ids]
            wrong[last[n > 0]] = False  # nothing follows the last piece
            text = np.repeat(np.arange(len(texts)), n)
            again = np.unique(text[wrong])
            if len(again):
                for i in again:
                    pieces[i] = SPACE.split(texts[i])
                ids, n = self.numbered(pieces)
        text = np.repeat(np.arange(len(texts)), n)
        good = np.array([bool(t) for t in texts], bool)
        for i in np.unique(text[~self.same[ids]]):
            good[i] = good[i] and self._whole(ids[text == i], texts[i])
        ids, text = ids[good[text]], text[good[text]]
        lists = []
        for s in range(2):
            tokens = self.counts[s][ids]
            ends = np.cumsum(tokens)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.flat[s][np.repeat(self.starts[s][ids] - (ends - tokens), tokens) + np.arange(total)]
            per_text = np.bincount(text, weights=tokens, minlength=len(texts)).astype(np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), pa.array(flat)))
        return lists, good

    def _whole(self, ids: np.ndarray, text: str) -> bool:
        """Both sides give the whole text back, though not each piece of it."""
        raw = b" " + text.encode("utf-8", "replace")
        for side, decoded in enumerate((self.bytes_a, self.bytes_b)):
            spans = zip(self.starts[side][ids], self.counts[side][ids])
            if b"".join(decoded[t] for at, n in spans for t in self.flat[side][at : at + n]) != raw:
                return False
        return True


@functools.cache
def vocabularies_of(folder: str, first: str, second: str) -> Vocabularies:
    """Loaded once in a worker; its tasks share the pieces encoded so far."""
    return Vocabularies(folder, first, second)


def token_table(tokens: pa.ListArray, sizes: np.ndarray, name: str) -> pa.Table:
    """One row per token: its id and the document-end key, its document and end offset in one number."""
    flat, parent = tokens.flatten(), pc.list_parent_indices(tokens)
    running = pc.cumulative_sum(pc.take(pa.array(sizes), flat))
    offsets = tokens.offsets.to_numpy()
    before = np.concatenate([[0], running.to_numpy()])[offsets[:-1]]
    key = pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(END, pa.int64())), pc.subtract(running, pc.take(pa.array(before), parent)))
    return pa.table({"key": key, name: flat})


def align(lists: list[pa.ListArray], vocabularies: Vocabularies) -> dict[str, pa.Array | np.ndarray]:
    """Per text: FACTS, the groups as one string, its distinct id pairs and how often each is linked."""
    n = len(lists[0])
    a, b = (token_table(tokens, size, name) for tokens, size, name in zip(lists, vocabularies.size, "ab"))
    line = a.join(b, "key", join_type="full outer", use_threads=False).sort_by("key")
    doc = pc.shift_right(line["key"], END).to_numpy()
    has_a, has_b = (pc.is_valid(line[c]).to_numpy() for c in "ab")
    closes = has_a & has_b
    # the next end of a side closes the token that an interval lies in
    link_a, link_b = (pc.fill_null_backward(line[c]).to_numpy() for c in "ab")
    links = pa.table({"doc": doc, "pair": link_a * len(vocabularies.bytes_b) + link_b})
    pairs = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    ends = np.concatenate([[0], np.cumsum(np.bincount(pairs["doc"].to_numpy(), minlength=n))])
    times = pairs["count_all"].cast(pa.int32()).combine_chunks()

    # tokens in order of group and side, each with the mark that follows it
    group = np.cumsum(closes) - closes
    sides = [(link_a[has_a], group[has_a], closes[has_a], 1), (link_b[has_b], group[has_b], closes[has_b], 2)]
    groups = int(closes.sum())
    upto = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for _, g, _, _ in sides]
    order = np.empty(sum(len(x) for x, *_ in sides), np.int64)
    for s, (ids, g, close, mark) in enumerate(sides):
        order[np.arange(len(ids)) + upto[1 - s][g + s]] = ids * 4 + np.where(close, mark, 0)
    n_a, n_b = (pc.list_value_length(x).to_numpy() for x in lists)
    stops = np.cumsum(n_a + n_b)
    order[stops[n_a > 0] - 1] += 1  # nothing follows the last group
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pc.take(vocabularies.strings, pa.array(order)))
    return {
        "n_a": n_a.astype(np.int64),
        "n_b": n_b.astype(np.int64),
        "n_groups": np.bincount(doc[closes], minlength=n),
        "n_links": np.bincount(doc, minlength=n),
        "groups": pc.binary_join(words, ""),
        "pairs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs["pair"].combine_chunks()),
        "times": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), times),
    }


def parts_of(text: str, most: int = AT_ONCE) -> Iterator[str]:
    """The text cut at spaces into parts of about `most` characters; a cut takes its space away."""
    at = 0
    while len(text) - at > most:
        cut = SPACE.search(text, at + most)
        if cut is None or cut.end() == len(text):
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def align_long(text: str, vocabularies: Vocabularies, most: int = AT_ONCE) -> dict[str, list]:
    """The same columns for one text of any length, aligned part by part."""
    facts, pairs, digest = np.zeros(len(FACTS), np.int64), pa.table({"pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())}), hashlib.sha256()
    nothing = {"sha": [""], "pairs": [[]], "times": [[]]} | {c: [0] for c in FACTS}
    for k, part in enumerate(parts_of(text, most) if vocabularies.cuts else [text]):
        lists, good = vocabularies.encode([part])
        if not good[0]:
            return nothing
        got = align(lists, vocabularies)
        facts += np.array([got[c][0] for c in FACTS])
        digest.update((";" if k else "").encode() + got["groups"][0].as_py().encode())
        more = pa.table({"pair": got["pairs"].flatten(), "times": got["times"].flatten().cast(pa.int64())})
        pairs = pa.concat_tables([pairs, more]).group_by("pair", use_threads=False).aggregate([("times", "sum")]).rename_columns(["pair", "times"])
    return {"sha": [digest.hexdigest()], "pairs": [pairs["pair"].to_pylist()], "times": [pairs["times"].to_pylist()]} | {c: [int(v)] for c, v in zip(FACTS, facts)}


def aligned(docs: DataFrame, folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(doc_id, FACTS, groups_sha256, pairs, times) per document row. Executors read the vocabularies from `folder`."""
    fields = ["doc_id", *FACTS, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = vocabularies_of(folder, first, second)
        for b, raw in text_slices(batches, most=AT_ONCE):
            texts = [t.decode("utf-8", "replace") for t in raw]
            texts = [t if t.isascii() or t.encode() == r else "" for t, r in zip(texts, raw)]  # valid UTF-8 only
            if len(texts) == 1 and len(raw[0]) > AT_ONCE:
                got = align_long(texts[0], vocabularies)
                sha = got["sha"]
            else:
                lists, _ = vocabularies.encode(texts)
                got = align(lists, vocabularies)
                sha = [hashlib.sha256(g.as_py().encode()).hexdigest() if n else "" for g, n in zip(got["groups"], got["n_a"])]
            columns = [pa.array(got[c], pa.int64()) for c in FACTS]
            lists = [got["pairs"] if isinstance(got["pairs"], pa.Array) else pa.array(got["pairs"], pa.list_(pa.int64()))]
            lists.append(got["times"] if isinstance(got["times"], pa.Array) else pa.array(got["times"], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns, pa.array(sha, pa.string()), *lists], names=fields)

    thin = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    numbers = ", ".join(f"{c} long" for c in FACTS)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {numbers}, groups_sha256 string, pairs array<long>, times array<int>"
    return thin.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, second_size: int) -> DataFrame:
    """(pair, n, best): documents that hold each id pair linked, and whether no pair of its first id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        kept: list[pa.Table] = []
        for b in batches:
            flat = pa.table({"pair": b["pairs"].flatten()})
            kept.append(flat.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]))
            if sum(t.num_rows for t in kept) > COUNTED:
                kept = [merged(kept)]
                if kept[0].num_rows > COUNTED // 2:
                    yield from kept[0].combine_chunks().to_batches()
                    kept = []
        if kept:
            yield from merged(kept).combine_chunks().to_batches()

    counts = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # partners of an id: at most the size of the other vocabulary
    own = W.partitionBy(F.floor(F.col("pair") / second_size))
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def with_counts(rows: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """`rows` with n_best and count_sum; counts go to every task up to `most` pairs, beyond it pairs are shuffled."""
    if counts.count() <= most:
        table = counts.toArrow().sort_by("pair")
        arrays = (table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy())
        shared = rows.sparkSession.sparkContext.broadcast(arrays)  # counted: at most `most` rows of 17 bytes

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = shared.value
            for b in batches:
                at = np.searchsorted(keys, b["pairs"].flatten().to_numpy())
                times = b["times"].flatten().to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b["pairs"]).to_numpy(zero_copy_only=False))]).astype(np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * n[at])]
                found = [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]
                yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], *found], names=[*kept, "n_best", "count_sum"])

        kept = [c for c in rows.columns if c not in ("pairs", "times")]
        fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
        return rows.mapInArrow(look_up, f"{fields}, n_best long, count_sum long")
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", "p.pairs", "p.times")
    joined = links.join(counts, links["pairs"] == counts["pair"])
    sums = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    out = rows.drop("pairs", "times").join(sums, "_row", "left")
    return out.fillna(0, ["n_best", "count_sum"])


def alignment(docs: DataFrame, folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND, most: int = PAIRS) -> DataFrame:
    """(doc_id, FACTS, n_best, count_sum, groups_sha256) per document row."""
    import sentencepiece

    spark = docs.sparkSession
    rows = aligned(docs, folder, first, second).withColumn("_row", F.monotonically_increasing_id())
    path = scratch(spark, "aligned")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    size = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, second)).vocab_size()
    counts = stage(pair_counts(rows, size), "pairs")
    return with_counts(rows, counts, most).select("doc_id", *FACTS, "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(load(spark, sf_dir, "documents"))
