"""Allometric density and Monte Carlo uncertainty."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylvagrid.functions.noise import STEP_U, STEP_V, box_muller, digest, rotate, uniform, uniform_from
from sylvagrid.session import spread

# Standard normal quantiles at 0.85 and 0.95, and the 95 % half-width.
Z85 = 1.0364333894937898
Z95 = 1.6448536269514722
HALF_WIDTH = 1.96


def allometric_density(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Median density and the spreads of density and ratio per cell.

    Expects `height`, power-law parameters (a50, b50, a15, b15, a85, b85) and the
    ratio (ratio_mean, ratio_p5, ratio_p95) on each row. Heights <= 0 become null,
    heights below the threshold count as 0.
    """
    h = F.when(F.col("height") > 0, F.when(F.col("height") < threshold, F.lit(0.0)).otherwise(F.col("height")))
    with_h = cells.withColumn("_h", h)

    def curve(p):
        return F.col(f"a{p}") * F.pow("_h", F.col(f"b{p}"))

    return (
        with_h.withColumns({"p50": curve(50), "p15": curve(15), "p85": curve(85)})
        .withColumns(
            {
                "agb_sd": ((F.col("p50") - F.col("p15")) / Z85 + (F.col("p85") - F.col("p50")) / Z85) / 2.0,
                "ratio_sd": (
                    (F.col("ratio_mean") - F.col("ratio_p5")) / Z95 + (F.col("ratio_p95") - F.col("ratio_mean")) / Z95
                )
                / 2.0,
            }
        )
        .drop("_h")
    )


def cell_monte_carlo(cells: DataFrame, keys: Sequence[str], draws: int = 250, seed: int = 42) -> DataFrame:
    """Mean and 95 % half-width of above-, below-ground and total density per cell.

    Narrow cell rows are dealt out by key once; the draws of a cell are generated,
    evaluated and reduced inside that task, with no second shuffle. One digest per
    cell starts the noise of all its draws. Draws are summed as deviations from
    the cell's median values, so plain sums and sums of squares lose no precision.
    """
    started = (
        spread(cells.where(F.col("p50").isNotNull()).select(*keys, "p50", "agb_sd", "ratio_mean", "ratio_sd"), *keys)
        .withColumn("_d", digest(seed, *keys))
        .withColumns({"_u": uniform_from(F.col("_d"), 0), "_v": uniform_from(F.col("_d"), 1)})
        .drop("_d")
    )
    drawn = started.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    turned = drawn.withColumns(
        {"_uk": rotate(F.col("_u"), F.col("_k"), STEP_U), "_vk": rotate(F.col("_v"), F.col("_k"), STEP_V)}
    )
    z1, z2 = box_muller(F.col("_uk"), F.col("_vk"))
    noise = turned.withColumns({"_a": z1 * F.col("agb_sd"), "_c": z2 * F.col("ratio_sd")})
    # agbd = p50 + a and bgbd = agbd (ratio_mean + c), each less its value without noise
    off = noise.withColumn("_b", F.col("_a") * F.col("ratio_mean") + (F.col("p50") + F.col("_a")) * F.col("_c"))
    off = off.withColumn("_t", F.col("_a") + F.col("_b"))
    sums = off.groupBy(*keys, "p50", "ratio_mean").agg(
        *[F.sum(c).alias(f"{c}1") for c in ("_a", "_b", "_t")],
        *[F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in ("_a", "_b", "_t")],
    )
    below = F.col("p50") * F.col("ratio_mean")
    out = []
    for name, c, centre in (("agbd", "_a", F.col("p50")), ("bgbd", "_b", below), ("tbd", "_t", F.col("p50") + below)):
        mean = F.col(f"{c}1") / draws
        spread_sd = F.sqrt(F.greatest(F.col(f"{c}2") / draws - mean * mean, F.lit(0.0)))
        out.append((centre + mean).alias(f"{name}_mean"))
        out.append((spread_sd * HALF_WIDTH).alias(f"{name}_uncertainty"))
    return sums.select(*keys, *out)


def block_columns(size: int):
    return [F.floor(F.col(i) / size).cast("int").alias(f"b{i}") for i in ("r", "c")]


def spatial_blocks(cells: DataFrame, size: int, width: int) -> DataFrame:
    """Block number of every cell of a grid that is `width` cells wide."""
    across = -(-width // size)
    return cells.withColumn(
        "block", (F.floor(F.col("r") / size) * across + F.floor(F.col("c") / size)).cast("int")
    )


def block_normals(seed: int, br: int, bc: int, draws: int) -> np.ndarray:
    """`noise.normal(seed, br, bc, sample)` of the samples 0 to draws - 1."""
    head = f"{seed}|{br}|{bc}|".encode()
    words = np.frombuffer(b"".join([md5(head + b"%d" % k).digest() for k in range(draws)]), ">u4").reshape(draws, 4)
    u, v = ((words[:, k] + 0.5) / 4294967296.0 for k in (0, 1))
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)


# keys whose sums a task holds before it passes them on, and cells that it evaluates at once
HELD, RUN = 64, 512


def country_samples(
    cells: DataFrame, keys: Sequence[str], mean: str, half_width: str, size: int, draws: int, seed: int, area_ha: float = 1.0
) -> DataFrame:
    """Totals (Mt) of `draws` samples with one error per spatial block and sample.

    A sample's total is the sum over cells of max(mean + z sd, 0), z shared by a block. Narrow cell rows are dealt out
    by block once and ordered there; a task draws the errors of a block once for all keys, evaluates the cells of the
    block in a batch (cells x draws numbers that stay in the task) and adds them to one sum per key and sample. Only
    these sums move: tasks x keys x draws rows, whatever the number of blocks. Cells without a place, a mean or a
    width take no part.
    """
    keys = list(keys)
    known = cells.where(F.col(mean).isNotNull() & F.col(half_width).isNotNull() & F.col("r").isNotNull() & F.col("c").isNotNull())
    sd = F.col(half_width).cast("double") / HALF_WIDTH
    narrow = known.select(*keys, *block_columns(size), F.col(mean).cast("double").alias("_m"), sd.alias("_s"))
    dealt = spread(narrow, "br", "bc").sortWithinPartitions("br", "bc", *keys)
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("sample", T.IntegerType()), T.StructField("_total", T.DoubleType())])
    types = to_arrow_schema(schema)

    def rows_of(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([key[k] for key in held for _ in range(draws)], types.field(k).type) for k in range(len(keys))]
        sample = pa.array(np.tile(np.arange(draws, dtype=np.int32), len(held)))
        return pa.RecordBatch.from_arrays([*columns, sample, pa.array(np.concatenate(list(held.values())))], names=types.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        block, z = None, np.zeros(draws)
        for b in batches:
            if not b.num_rows:
                continue
            m, s = b["_m"].to_numpy(), b["_s"].to_numpy()
            code = np.stack([pc.dictionary_encode(b[c], null_encoding="encode").indices.to_numpy() for c in ("br", "bc", *keys)])
            turns = (np.diff(code, prepend=-1) != 0).any(axis=0) | (np.arange(b.num_rows) % RUN == 0)
            starts = np.append(np.flatnonzero(turns), b.num_rows)  # runs of one block and key
            for at, end in zip(starts[:-1], starts[1:]):
                here = b["br"][at].as_py(), b["bc"][at].as_py()
                if here != block:
                    block, z = here, block_normals(seed, *here, draws)
                key = tuple(b[k][at].as_py() for k in keys)
                if key not in held:
                    if len(held) == HELD:
                        yield rows_of(held)
                        held = {}
                    held[key] = np.zeros(draws)
                held[key] += np.maximum(m[at:end, None] + s[at:end, None] * z, 0.0).sum(axis=0)
        if held:
            yield rows_of(held)

    return dealt.mapInArrow(add, schema).groupBy(*keys, "sample").agg((F.sum("_total") * area_ha / 1e6).alias("total"))


def interval(samples: DataFrame, keys: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Low, mean and high per key; a key holds the configured number of samples."""
    q = F.percentile("total", F.array(F.lit(low), F.lit(high)))
    return samples.groupBy(*keys).agg(
        F.get(q, F.lit(0)).alias("biomass_low"),
        F.avg("total").alias("biomass_mean"),
        F.get(q, F.lit(1)).alias("biomass_high"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def interannual_flux(samples: DataFrame, combinations: int = 10000, seed: int = 42, carbon: float = 0.5) -> DataFrame:
    """Flux between consecutive years from random pairs of their samples.

    `samples(yr, sample, total)` numbers samples from 0. Pairs are drawn with
    replacement by hashed indexes, the same ones for every pair of years.
    """
    counts = samples.groupBy("yr").agg(F.count(F.lit(1)).alias("n"))
    by_year = W.partitionBy(F.lit(0)).orderBy("yr")
    pairs = counts.select(
        F.col("yr").alias("year1"),
        F.lead("yr").over(by_year).alias("year2"),
        F.col("n").alias("n1"),
        F.lead("n").over(by_year).alias("n2"),
    ).where("year2 IS NOT NULL")
    drawn = pairs.withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("n1", "n2", F.lit(combinations).cast("bigint")) - 1))
    ).withColumns(
        {
            "i1": F.floor(uniform(seed, "j", word=0) * F.col("n1")).cast("int"),
            "i2": F.floor(uniform(seed, "j", word=1) * F.col("n2")).cast("int"),
        }
    )
    s1 = samples.select(F.col("yr").alias("year1"), F.col("sample").alias("i1"), F.col("total").alias("t1"))
    s2 = samples.select(F.col("yr").alias("year2"), F.col("sample").alias("i2"), F.col("total").alias("t2"))
    flux = drawn.join(s1, ["year1", "i1"]).join(s2, ["year2", "i2"])
    flux = flux.withColumn("flux", (F.col("t2") - F.col("t1")) * carbon)
    q = F.percentile("flux", F.array(*[F.lit(p) for p in (0.025, 0.25, 0.5, 0.75, 0.975)]))
    return flux.groupBy("year1", "year2").agg(
        F.avg("flux").alias("mean_flux"),
        F.get(q, F.lit(2)).alias("median_flux"),
        F.stddev_pop("flux").alias("std_flux"),
        F.min("flux").alias("min_flux"),
        F.max("flux").alias("max_flux"),
        F.get(q, F.lit(0)).alias("lower_ci"),
        F.get(q, F.lit(4)).alias("upper_ci"),
        F.get(q, F.lit(1)).alias("q25"),
        F.get(q, F.lit(3)).alias("q75"),
        F.count(F.lit(1)).alias("n_samples"),
    )
