"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows that the one before it kept and returns the columns of
`documents`; the last adds the number of the copy.

* quality_rules: documents that the fertility bands or the base rules reject go.
* line_dedup: lines in later copies of a three-line window go, and documents that lose all text.
* jaccard_join: one document (the smallest id) of each group of near duplicates stays:
  five-word shingles, similarity 0.8 or more.
* decontamination: documents with a twentieth of their words or more in benchmark windows go.
* mixture: documents repeat by Poisson counts to the target weights of their sources, in a shuffled order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvagrid.llm.common import load
from sylvagrid.llm.decontaminate import drop_contaminated
from sylvagrid.llm.jaccard_join import keep_one_of_each
from sylvagrid.llm.line_dedup import drop_repeated_lines
from sylvagrid.llm.mixture import mix
from sylvagrid.llm.quality_rules import drop_rejected
from sylvagrid.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs, counts=[c for c in ("n_chars",) if c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

# the first stage tokenises, which SQL cannot express; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
