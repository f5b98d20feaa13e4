"""Quality rules on tokenizer fertility, with rejection bands per script.

Every word is encoded by public vocabularies, alone; a word that repeats is encoded
once per batch. Per document: characters per token, share of byte-fallback tokens
(code points that the vocabulary lacks), entropy of the token distribution as a share of
its largest value, log2(tokens), by two vocabularies: one with byte fallback and one of bytes
for many languages (`multi_`, where tokens that are not whole characters count as bytes).
A document outside a band of its main script is rejected,
as is one that the base rules fail: under 20 words, or over 30 % of its words in 8-word
windows that repeat in the text. Fertility needs a sample of tokens to speak, so bands
apply from MIN_TOKENS tokens on. A script whose letters a vocabulary lacks as a whole has
no limit of the byte share there, as the share says nothing about the text.

Words are runs between ASCII white space of the whole text. A null or empty text has no
words and fails. Rows repeat as given; `drop_rejected` keeps all columns.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import load, text_slices

TOKENIZERS = "/opt/tokenizers"
MODEL, MULTI = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
# the split before the merges of MULTI, and the characters of a word that are split at once
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 10_000
MIN_WORDS, REPEAT_SHARE, WINDOW, MIN_TOKENS = 20, 30, 8, 50
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
# other scripts with letters in the vocabulary, and limits for those without: up to four bytes and a word mark a letter
NAMED = ("arabic", "hebrew", "devanagari", "bengali", "tamil", "thai", "georgian", "armenian", "khmer")
LACKED = ((0.19, 12.0), (0.0, 1.0), (0.08, 1.0))
# main script: (characters per token, byte-fallback share, normalised entropy), each lowest and highest
BANDS = {
    "latin": ((1.5, 12.0), (0.0, 0.2), (0.35, 1.0)),
    "cyrillic": ((1.0, 12.0), (0.0, 0.2), (0.35, 1.0)),
    "greek": ((0.6, 12.0), (0.0, 0.5), (0.3, 1.0)),
    "cjk": ((0.3, 6.0), (0.0, 0.8), (0.3, 1.0)),
    **dict.fromkeys(NAMED, ((0.25, 12.0), (0.0, 0.95), (0.2, 1.0))),
    "other": LACKED,
    "none": ((0.25, 12.0), (0.0, 0.95), (0.2, 1.0)),
}
# the same by MULTI, which lacks most letters of the scripts marked so
MULTI_BANDS = {
    "latin": ((1.0, 12.0), (0.0, 0.5), (0.3, 1.0)),
    "cyrillic": ((0.8, 12.0), (0.0, 0.5), (0.3, 1.0)),
    "greek": ((0.4, 12.0), (0.0, 0.8), (0.25, 1.0)),
    "cjk": ((0.25, 6.0), (0.0, 0.95), (0.2, 1.0)),
    **dict.fromkeys(("arabic", "hebrew", "thai", "tamil"), ((0.25, 12.0), (0.0, 0.95), (0.2, 1.0))),
    **dict.fromkeys(("devanagari", "bengali", "georgian", "armenian", "khmer", "other", "none"), LACKED),
}
SCRIPTS = {
    "latin": r"\p{Latin}",
    "cyrillic": r"\p{Cyrillic}",
    "greek": r"\p{Greek}",
    "cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]",
    **{name: rf"(?=\p{{L}})\p{{{name.capitalize()}}}" for name in NAMED},
    "other": r"\p{L}",
}
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", "chars_per_token", "byte_share", "entropy", "n_multi_tokens", "multi_chars_per_token", "multi_byte_share", "multi_entropy", "script", "kept"]
FACT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double, "
    "n_multi_tokens long, multi_chars_per_token double, multi_byte_share double, multi_entropy double, script string, kept boolean"
)


class Vocabulary:
    """The vocabularies: token ids of words and which ids are single bytes (of `multi`: no whole characters)."""

    def __init__(self, folder: str = TOKENIZERS, model: str = MODEL, multi: str = MULTI):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, model))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        with open(os.path.join(folder, multi), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.multi = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.multi_is_byte = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            self.multi_is_byte[rank] = "\ufffd" in token.decode("utf-8", "replace") and token != "\ufffd".encode()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)

    def encode_multi(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for w in words:
            t = " " + w.decode("utf-8", "replace")
            if len(t) <= PIECE:
                out.append(self.multi.encode_ordinary(t))
            else:
                out.append([i for at in range(0, len(t), PIECE) for i in self.multi.encode_ordinary(t[at : at + PIECE])])
        return out


def script_of(words: list[bytes]) -> np.ndarray:
    """(words, scripts): letters of each word by script; `other` holds the letters of none of them."""
    out = np.zeros((len(words), len(SCRIPTS)), np.int64)
    find = [regex.compile(p) for p in SCRIPTS.values()]
    for i, w in enumerate(words):
        if w.isascii():
            out[i, 0] = len(w.translate(None, NOT_LETTERS))
        else:
            t = w.decode("utf-8", "replace")
            letters, latin = len(find[-1].findall(t)), len(find[0].findall(t))
            out[i, 0], left = latin, letters - latin
            for j, p in enumerate(find[1:-1], 1):
                if left <= 0:
                    break
                out[i, j] = len(p.findall(t))
                left -= out[i, j]
            out[i, -1] = left
    return out


def repeat_cover(ids: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per word: inside a window of `window` words that occurs twice or more in its document.

    Windows are ranked by doubling: ranks of 2, 4 and 8 words, exact, for the whole batch at once.
    """
    rank, width = ids.astype(np.int64), 1
    while width < window:
        if len(rank) <= width:
            return np.zeros(len(ids), bool)
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], width * 2
    starts = np.flatnonzero(doc[: len(rank)] == doc[window - 1 :][: len(rank)])
    keys = rank[starts] * (int(doc.max()) + 1) + doc[starts] if len(starts) else rank[starts]
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    again = starts[n[back] > 1]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def fertility(tokens: list[list[int]], is_byte: np.ndarray, ids: np.ndarray, n: np.ndarray, word_chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, characters per token, byte share, entropy) of each text of `n` words, for the tokens of its distinct words."""
    doc, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    n_tokens = np.array([len(t) for t in tokens], np.int64)
    flat = np.fromiter((i for t in tokens for i in t), np.int64, int(n_tokens.sum()))
    begin = np.concatenate([[0], np.cumsum(n_tokens)])
    byte_sums = np.concatenate([[0], np.cumsum(is_byte[flat])])
    n_bytes = byte_sums[begin[1:]] - byte_sums[begin[:-1]]
    all_tokens, byte_tokens = (np.bincount(doc, weights=c[ids], minlength=len(n)).astype(np.int64) for c in (n_tokens, n_bytes))
    entropy = np.zeros(len(n))
    for i in np.flatnonzero(all_tokens > 1):
        ws, times = np.unique(ids[ends[i] - n[i] : ends[i]], return_counts=True)
        spans = n_tokens[ws]
        at = np.repeat(begin[ws] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        _, back = np.unique(flat[at], return_inverse=True)
        p = np.bincount(back, weights=np.repeat(times, spans)) / all_tokens[i]
        entropy[i] = -(p * np.log2(p)).sum() / np.log2(all_tokens[i])
    return all_tokens, word_chars / np.maximum(all_tokens, 1), byte_tokens / np.maximum(all_tokens, 1), entropy


def rate(texts: list[bytes], vocabulary: Vocabulary, bands: dict = BANDS, multi_bands: dict = MULTI_BANDS) -> dict[str, np.ndarray | list]:
    """The columns FACTS for some whole texts."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(n.sum()))
    distinct = list(number)
    chars = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in distinct], np.int64)
    scripts = script_of(distinct)

    def per_doc(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=of_word[ids], minlength=len(texts)).astype(np.int64)

    word_chars = per_doc(chars)
    measured = [
        fertility(vocabulary.encode(distinct) if distinct else [], vocabulary.is_byte, ids, n, word_chars),
        fertility(vocabulary.encode_multi(distinct), vocabulary.multi_is_byte, ids, n, word_chars),
    ]
    letters = np.stack([per_doc(scripts[:, j]) for j in range(len(SCRIPTS))], axis=1)
    names = [*SCRIPTS, "none"]
    main = np.where(letters.sum(axis=1) > 0, letters.argmax(axis=1), len(SCRIPTS))
    repeats = np.bincount(doc, weights=repeat_cover(ids, doc), minlength=len(texts)).astype(np.int64) if len(ids) else np.zeros(len(texts), np.int64)
    failed = (n < MIN_WORDS) | (100 * repeats > REPEAT_SHARE * n)
    inside = np.ones(len(texts), bool)
    for j, name in enumerate(names):
        for (tokens, *values), limits in zip(measured, (bands, multi_bands)):
            for value, (low, high) in zip(values, limits[name]):
                inside &= (main != j) | (tokens < MIN_TOKENS) | ((value >= low) & (value <= high))
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeats,
        "base_failed": failed,
        **dict(zip(("n_tokens", "chars_per_token", "byte_share", "entropy"), measured[0])),
        **dict(zip(("n_multi_tokens", "multi_chars_per_token", "multi_byte_share", "multi_entropy"), measured[1])),
        "script": [names[j] for j in main],
        "kept": ~failed & inside,
    }


def quality_facts(docs: DataFrame, folder: str = TOKENIZERS, bands: dict = BANDS) -> DataFrame:
    """(doc_id, FACTS) per document row. Executors read the vocabulary from `folder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder)
        for b, texts in text_slices(batches):
            got = rate(texts, vocabulary, bands)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(got[c]) for c in FACTS]], names=["doc_id", *FACTS])

    thin = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    return thin.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FACT_SCHEMA}")


def drop_rejected(docs: DataFrame, folder: str = TOKENIZERS, bands: dict = BANDS) -> DataFrame:
    """The documents kept by the rules, with all their columns; nothing moves between tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder)
        for b, texts in text_slices(batches, "text"):
            yield b.filter(pa.array(rate(texts, vocabulary, bands)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_facts(load(spark, sf_dir, "documents"))
