"""License scan: a positional index of rare licence words, intersected by relative position.

Templates are licence texts and notices with mandatory key phrases. Document frequencies of the
template words are counted over all documents. The index maps a word to its postings (template,
place), and to the phrases that it is the rarest word of. A template is posted under its words of
the highest IDF only: under so many that the others hold less than `share` of its IDF mass. An
alignment that reaches `share` therefore has one of them in place, so nothing is lost, and a file
that lacks them never meets the template. A file's words are looked up from the highest IDF down: a
word at place p of the file and q of a template proposes the alignment p - q, and each proposed
alignment is weighed once. The cost of a file follows the postings of its words, not the number of
templates. The label is given where the aligned share of the IDF mass reaches `share` and all key
phrases of the template stand near the alignment, at most a template's length away. The score is the
largest such share; one half at least where a base phrase stands, else 0.

Words of equal IDF are taken by name, of equal alignments the first counts (the share is the same).
Whole texts of any length are read, batch by batch; only the words of the templates are kept, so a
task holds one batch. A null or empty text has no words, no labels and score 0. Null ids and
repeated rows come back as given, an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import ALNUM, load, text_slices

# fixed values: phrases and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# fixed values: public licence notices as templates; label: (text, mandatory key phrases)
TEMPLATES = {
    "gpl-notice": ("this work is licensed under the gnu general public license version", ["gnu general public license", "licensed under the"]),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "lgpl": ("this library is free software distributed under the gnu lesser general public license", ["gnu lesser general public license"]),
    "agpl": ("licensed under the gnu affero general public license", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "mit-notice": ("released under the mit license", ["mit license", "under the"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ["permission is hereby granted free of charge", "copy of this software"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "with or without modification"],
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license v 2 0"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify and or distribute this software"],
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc0": ("released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    "mit-full": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        ["permission is hereby granted free of charge", "the software is provided as is", "shall be included in all copies"],
    ),
    "isc-full": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims "
        "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["permission to use copy modify and or distribute this software", "the author disclaims all warranties"],
    ),
    "bsd-2-full": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors "
        "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
        "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
        "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "are disclaimed"],
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ["licensed under the apache license version 2 0", "unless required by applicable law or agreed to in writing"],
    ),
    "gpl-3-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        ["under the terms of the gnu general public license", "either version 3 of the license"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
        "and to alter it and redistribute it freely subject to the following restrictions",
        ["permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"],
    ),
}
SHARE = 0.6


@dataclass
class Index:
    """Words numbered by falling IDF; texts as their word numbers; what a word leads to."""

    idf: np.ndarray
    ids: dict[bytes, int]
    phrases: dict[str, np.ndarray] = field(default_factory=dict)
    templates: dict[str, tuple[np.ndarray, list[str]]] = field(default_factory=dict)
    # word: (template, place), and the phrases that it is the rarest word of
    postings: dict[int, list[tuple[str, int]]] = field(default_factory=dict)
    anchors: dict[int, list[str]] = field(default_factory=dict)


def entering(text: np.ndarray, idf: np.ndarray, share: float) -> list[int]:
    """Places of the template's rarest words, so many that the others hold less than `share` of its mass."""
    order = sorted(range(len(text)), key=lambda q: (int(text[q]), q))
    rest, total, out = float(idf[text].sum()), float(idf[text].sum()), []
    for q in order:
        if rest < share * total * (1 - 1e-9):
            break
        out.append(q)
        rest -= float(idf[text[q]])
    return out


def vocabulary(templates: dict = TEMPLATES, phrases: dict = BASE) -> list[bytes]:
    texts = [*phrases, *(t for t, _ in templates.values()), *(k for _, keys in templates.values() for k in keys)]
    return sorted({w for t in texts for w in t.encode().split()})


def build_index(n_docs: int, frequency: dict[bytes, int], templates: dict = TEMPLATES, phrases: dict = BASE, share: float = SHARE) -> Index:
    words = sorted(vocabulary(templates, phrases), key=lambda w: (frequency.get(w, 0), w))
    idf = np.array([math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for w in words])
    index = Index(idf, {w: i for i, w in enumerate(words)})
    numbers = lambda text: np.array([index.ids[w] for w in text.encode().split()])
    for text in [*phrases, *(k for _, keys in templates.values() for k in keys)]:
        index.phrases[text] = numbers(text)
    index.templates = {label: (numbers(text), keys) for label, (text, keys) in templates.items()}
    for phrase, text in index.phrases.items():
        index.anchors.setdefault(int(text.min()), []).append(phrase)
    for label, (text, _) in index.templates.items():
        for q in entering(text, idf, share):
            index.postings.setdefault(int(text[q]), []).append((label, q))
    return index


def word_frequency(docs: DataFrame, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and documents with each of the words: counts over the whole table, one row per word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, rows = set(words), dict.fromkeys(words, 0), 0
        for _, texts in text_slices(batches):
            rows += len(texts)
            for t in texts:
                for w in known.intersection(t.translate(ALNUM).split()):
                    total[w] += 1
        yield pa.RecordBatch.from_pydict({"w": [b"", *total], "n": [rows, *total.values()]}, schema=pa.schema([("w", pa.binary()), ("n", pa.int64())]))

    counted = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, "w binary, n long")
    got = {bytes(r.w): r.n for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}  # the vocabulary of the templates
    return got.pop(b"", 0), got


def places(numbers: np.ndarray, text: np.ndarray, where: dict[int, np.ndarray]) -> np.ndarray:
    """Starts of `text` in the document: the places of its rarest word, kept while every word stands at its own place."""
    rare = int(text.argmin())
    starts = where.get(int(text[rare]), np.empty(0, np.int64)) - rare
    starts = starts[(starts >= 0) & (starts + len(text) <= len(numbers))]
    for i, w in enumerate(text):
        starts = starts[numbers[starts + i] == w]
    return starts


def alignments(index: Index, numbers: np.ndarray, where: dict[int, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per template that a word of the file is posted for: the alignments it proposes, and the share of mass in place."""
    proposed: dict[str, list[np.ndarray]] = {}
    for w, spots in where.items():  # from the highest IDF down
        for label, q in index.postings.get(w, ()):
            proposed.setdefault(label, []).append(spots - q)
    out = {}
    for label, lists in proposed.items():
        offsets, (text, _) = np.unique(np.concatenate(lists)), index.templates[label]
        mass = np.zeros(len(offsets))
        for q, w in enumerate(text):
            at = offsets + q
            inside = (at >= 0) & (at < len(numbers))
            mass[inside] += index.idf[w] * (numbers[at[inside]] == w)
        out[label] = offsets, np.minimum(1.0, mass / index.idf[text].sum())
    return out


def near(starts: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """For each alignment: some start lies at most `length` words before it or behind its end."""
    at = np.searchsorted(starts, offsets - length)
    return (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] <= offsets + 2 * length) if len(starts) else np.zeros(len(offsets), bool)


def scan_text(words: list[bytes], index: Index, base: dict = BASE, share: float = SHARE) -> dict:
    """Places of every phrase, labels and score of one document."""
    numbers = np.fromiter((index.ids.get(w, -1) for w in words), np.int32, len(words))
    known = np.flatnonzero(numbers >= 0)
    out = {"n_words": len(words), "spots": {}, "labels": set(), "score": 0.0}
    if not len(known):
        return out
    order = known[np.argsort(numbers[known], kind="stable")]
    ids, first = np.unique(numbers[order], return_index=True)
    where = {int(w): p for w, p in zip(ids, np.split(order, first[1:]))}
    found = {p: places(numbers, index.phrases[p], where) for w in where for p in index.anchors.get(w, ())}
    out["spots"] = {p: found[p] for p in base if p in found and len(found[p])}
    out["labels"] = {base[p] for p in out["spots"]}
    for label, (offsets, shares) in alignments(index, numbers, where).items():
        text, keys = index.templates[label]
        good = shares >= share
        for k in keys:
            good &= near(found.get(k, np.empty(0, np.int64)), offsets, len(text))
        if good.any():
            out["labels"].add(label)
            out["score"] = max(out["score"], float(shares[good].max()))
    if out["spots"]:
        out["score"] = max(out["score"], 0.5)
    return out


def scan(docs: DataFrame, templates: dict = TEMPLATES, base: dict = BASE, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, spots, base_labels, labels, score); `spots` lists (phrase, first, last, n) by word."""
    n_docs, frequency = word_frequency(docs, vocabulary(templates, base))
    index = build_index(n_docs, frequency, templates, base, share)
    spot = pa.struct([("phrase", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])
    labels = pa.list_(pa.string())
    types = {"n_words": pa.int64(), "spots": pa.list_(spot), "base_labels": labels, "labels": labels, "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches):
            found = [scan_text(t.translate(ALNUM).split(), index, base, share) for t in texts]
            columns = {
                "n_words": [f["n_words"] for f in found],
                "spots": [
                    [{"phrase": p, "first": int(s[0]), "last": int(s[-1]), "n": len(s)} for p, s in f["spots"].items()] for f in found
                ],
                "base_labels": [sorted({base[p] for p in f["spots"]}) for f in found],
                "labels": [sorted(f["labels"]) for f in found],
                "score": [f["score"] for f in found],
            }
            arrays = [pa.array(columns[c], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *arrays], names=["doc_id", *types])

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, "
        "spots array<struct<phrase:string,first:long,last:long,n:long>>, base_labels array<string>, labels array<string>, score double"
    )
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spots.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_base"),
        F.array_min("spots.first").alias("first_word"),
        F.array_max("spots.last").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
