"""Mixing sources to target weights by Poisson replication.

The rate of a source is its target share of the characters over its present share,
times `epochs`: on average a document of it then occurs so many times. The number of
copies of a document inverts the Poisson distribution of that rate at a uniform number
hashed from (seed, doc_id), so a recomputed task repeats it. Copies are dealt
out and sorted by another hash, which shuffles them globally.

A rate above PIECE is cut into equal pieces, each inverted by its own hash and summed
(sums of Poisson numbers are Poisson), so no tail is cut and no table grows with the
rate. Null sources are one source; rows of one doc_id draw alike, and a null id draws by its
text; null and empty texts count as one character; a source without target weight
has rate 0 and goes. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm.common import free_name, load, partitions
from sylvagrid.session import stage

# bytes of rate tables (some 2 kB a source) that may be sent to every task; above it documents meet them by a shuffle
RATES_BYTES = 32 << 20
# largest rate that one inversion serves: its table of probabilities has some 200 entries
PIECE = 64.0
# present shares are raised to this power for the target of a source that is given none
FLATTEN = 0.7


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below the resolution of `uniform`."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def add(acc, k):
        p = acc.p * rate / k
        return F.struct(p.alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, add, lambda acc: acc.cdf)


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = FLATTEN, epochs: float = 1.0
) -> DataFrame:
    """(_source, _rate, _pieces, _cdf): one row per source."""
    size = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    per = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(size).alias("_size"))
    if weights is None:
        target = F.pow(F.col("_size").cast("double"), F.lit(flatten))
    else:
        target = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("_source")), F.lit(0.0))
    per = per.withColumn("_target", target)
    whole = per.agg(F.sum("_size").cast("double").alias("s"), F.sum("_target").alias("t"))
    rate = F.lit(float(epochs)) * F.col("_target") / whole.select("t").scalar() * whole.select("s").scalar() / F.col("_size")
    per = per.select("_source", F.coalesce(rate, F.lit(0.0)).alias("_rate"))
    per = per.withColumn("_pieces", F.greatest(F.ceil(F.col("_rate") / PIECE), F.lit(1)).cast("int"))
    return per.withColumn("_cdf", poisson_table(F.col("_rate") / F.col("_pieces")))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """(_row, _source, _rate, _copy, _order): every copy of every document, dealt out and sorted by `_order`.

    The rates are staged and measured first. Sent to all tasks, they let copies be counted where the documents are
    read, and the documents move once.
    """
    rates = stage(rates, "rates")
    size = rates.agg(F.sum(8 * F.size("_cdf") + F.octet_length(F.coalesce("_source", F.lit(""))) + 64)).first()[0] or 0
    rates = F.broadcast(rates) if size <= RATES_BYTES else rates
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source").alias("_src"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("_who"),
    )
    rows = rows.join(rates, rows["_src"].eqNullSafe(rates["_source"]))
    drawn = F.transform(
        F.sequence(F.lit(1), "_pieces"),
        lambda j: F.size(F.filter("_cdf", lambda c: c < uniform(seed, F.col("_who"), j))),
    )
    rows = rows.withColumn("_n", F.aggregate(drawn, F.lit(0), lambda a, x: a + x)).where(F.col("_n") > 0)
    rows = rows.select("_row", "_who", "_source", "_rate", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"))
    rows = rows.withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), "_who", "_copy")))
    # the digest is uniform, so equal ranges of it are equal parts: a global sort without sampling
    parts = partitions(docs.sparkSession)
    part = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("_order").drop("_who")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = FLATTEN, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """The documents repeated to the target weights and shuffled, with all their columns, and the number of the copy."""
    copies = replicate(docs, source_rates(docs, weights, flatten, epochs), seed)
    return copies.select("_row.*", F.col("_copy").alias(free_name("copy", docs.columns)))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    thin = docs.select("doc_id", "source", F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"))
    return replicate(thin, source_rates(docs)).select(
        "_row.doc_id", F.col("_source").alias("source"), F.col("_copy").cast("long").alias("copy"), F.col("_order").alias("order_key")
    )


OP8_SQL = r"""
WITH per AS (SELECT source, CAST(sum(greatest(length(coalesce(text, '')), 1)) AS DOUBLE) AS size FROM documents GROUP BY source),
rate AS (
  SELECT source, pow(size, 0.7) / (SELECT sum(pow(size, 0.7)) FROM per) * (SELECT sum(size) FROM per) / size AS rate FROM per),
pieces AS (SELECT source, rate, greatest(ceil(rate / 64.0), 1) AS m FROM rate),
cdf AS (
  SELECT source, m, k, sum(exp(-rate / m + k * ln(rate / m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate, m, unnest(range(0, 740)) AS k FROM pieces) WHERE k <= ceil(rate / m + 10 * sqrt(rate / m) + 30)),
u AS (
  SELECT doc_id, source, (CAST('0x' || substr(md5('7|' || doc_id || '|' || j), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM (SELECT doc_id, source, unnest(range(1, CAST(m AS BIGINT) + 1)) AS j FROM documents JOIN pieces USING (source))),
n AS (SELECT doc_id, source, count(*) FILTER (WHERE c < u) AS n FROM u JOIN cdf USING (source) GROUP BY doc_id, source),
x AS (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, source, copy, md5('8|' || doc_id || '|' || copy) AS order_key FROM x
"""
