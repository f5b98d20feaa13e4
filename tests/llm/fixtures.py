"""Documents with the odd cases that every operator must handle."""

import random

from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("n_words", T.StringType()),
        T.StructField("hits", T.StringType()),
        T.StructField("_hash", T.StringType()),
        T.StructField("copy", T.StringType()),
        T.StructField("gone", T.StringType()),
    ]
)


def rows_of(texts):
    """(doc_id, text, source) as rows of DOC."""
    return [(i, t, "en", s, len(t or ""), "a", "b", "c", "d", "e") for i, t, s in texts]


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    own = random.Random(1)
    stems = ["".join(own.choice("abcdefghiklmnoprstuvw") for _ in range(own.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(words):
        w = stems[min(int(r.expovariate(0.02)), vocabulary - 1)]
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += ".\n" if i % 27 == 26 else "."
    return " ".join(out).replace("\n ", "\n")


def edited(text, seed, n):
    """`n` words replaced by new ones."""
    r = random.Random(seed)
    words = text.split(" ")
    for k in range(n):
        words[r.randrange(len(words))] = f"new{seed}x{k}"
    return " ".join(words)


def corpus():
    """Null, empty, short and very long texts, exact and near copies, shared passages, repeated rows, null ids."""
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "Two words"), (None, prose(99, 60))]
    base = prose(7, 150)
    texts += [(10 + i, base) for i in range(6)]
    texts += [(20 + i, edited(base, i, i % 4 + 1)) for i in range(25)]
    passage = prose(8, 70)
    texts += [(60 + i, prose(100 + i, 40) + "\n" + passage + "\n" + prose(200 + i, 30)) for i in range(12)]
    texts += [(80 + i, prose(300 + i, 30 + 10 * i)) for i in range(12)]
    texts += [(100, prose(500, 9000)), (101, prose(500, 9000) + " end"), (102, "word " * 400)]
    texts += [(103, "日本語 のテキスト " * 30), (104, "é" * 300 + " ünïcödé"), (105, "### $$$ %%% " * 20), (106, "x y z w v " * 30)]
    texts += [(107, "\n".join(["same line here", "and another line", "third one"] * 5))]
    texts += [(10, base), (80, prose(300, 30))]  # repeated rows
    return [(i, t, None if k % 11 == 0 else f"s{k % 3 if k % 4 else 0}") for k, (i, t) in enumerate(texts)]
