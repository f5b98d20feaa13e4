"""Accuracy of predictions, binned error tables, histograms, patch statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.noise import uniform
from sylvagrid.operators.ranking import exact_percentiles, group_key, running_totals
from sylvagrid.session import stage



def poisson_steps(resolution: float = 2.0**-33) -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean 1, until the rest is below the resolution."""
    steps = [math.exp(-1.0)]
    while 1.0 - steps[-1] > resolution:
        steps.append(steps[-1] + math.exp(-1.0) / math.factorial(len(steps)))
    return steps


POISSON_STEPS = poisson_steps()


def cleaned(pairs: DataFrame, cap: float = 60.0, cutoff: float = 0.99) -> DataFrame:
    """Negative predictions to 0, values above the cap dropped, then residuals above their percentile dropped."""
    p = F.when(F.col("pred") < 0, F.lit(0.0)).otherwise(F.col("pred"))
    kept = (
        pairs.withColumn("pred", p)
        .where((F.col("pred") <= cap) & (F.col("target") <= cap))
        .withColumn("residual", F.col("pred") - F.col("target"))
    )
    kept = stage(kept, "residuals", spread_rows=True)
    limit = exact_percentiles(kept, [], "residual", {"q": cutoff}, staged=True).scalar()
    return kept.where(F.col("residual") <= limit)


def regression_metrics(rows: DataFrame) -> DataFrame:
    """MAE, bias, RMSE, Pearson r, R2, count and RMSE relative to the mean target, in one pass."""
    e = F.col("residual")
    n = F.count(F.lit(1))
    rmse = F.sqrt(F.avg(e * e))
    return rows.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        rmse.alias("rmse"),
        F.corr("target", "pred").alias("r_pearson"),
        (1.0 - F.try_divide(F.sum(e * e), n * F.var_pop("target"))).alias("r2"),
        n.alias("n_samples"),
        (F.try_divide(rmse, F.avg("target")) * 100.0).alias("rel_rmse"),
    )


# a prime just below 2**31: squares of what is left by it fit into 64 bits in any engine
PRIME = 2**31 - 1
# rows weighted at once in a task: 8 kB a row for 1,000 replicates
TOGETHER = 32


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME up to one PRIME, in place, for 0 <= x < 2**62: the high bits added to the low ones, twice."""
    for _ in range(2):
        high = x >> 31
        x &= PRIME
        x += high
    return x


def poisson_weights(keys: np.ndarray, replicates: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """rows x replicates: Poisson(1) counts drawn by squarings modulo PRIME of the row's key and the replicate."""
    k, b = keys[:, None], replicates[None]
    more = k + b * 7919
    x = folded(k * 48271 + b * 69621)
    for _ in range(2):
        x *= x
        x += more
        folded(x)
        more += k
    x[x >= PRIME] -= PRIME
    x = x.astype(np.int32)
    often, seldom = limits[:5].astype(np.int32), limits[5:]
    out = (x >= often[0]).view(np.int8)
    for limit in often[1:]:
        out += (x >= limit).view(np.int8)
    rare = np.flatnonzero(out == len(often))  # one weight in 270
    out.ravel()[rare] += np.searchsorted(seldom, x.ravel()[rare], side="right").astype(np.int8)
    return out


def bootstrap_intervals(rows: DataFrame, ids: Sequence[str], replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile intervals of MAE, RMSE and R2.

    Each row enters each replicate with a Poisson(1) weight that depends only on the whole numbers `ids` and the
    replicate, so no resampling shuffle is needed. A task weighs its rows in blocks, as a matrix of rows x replicates,
    and adds five sums per replicate: only (tasks x replicates) rows move, and no row is multiplied.
    """
    key = F.lit(seed).cast("long")
    for i in ids:
        key = F.pmod(key * 1000003 + F.pmod(F.col(i).cast("long"), F.lit(PRIME)), F.lit(PRIME))
    limits = np.array([math.ceil(step * PRIME - 0.5) for step in POISSON_STEPS], np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, replicates))
        numbers = np.arange(replicates, dtype=np.int64)
        for batch in batches:
            k, e, t = (batch[c].to_numpy() for c in ("k", "e", "t"))
            values = np.column_stack([np.ones(len(k)), np.abs(e), e * e, t, t * t])
            for at in range(0, len(k), TOGETHER):
                part = slice(at, at + TOGETHER)
                total += values[part].T @ poisson_weights(k[part], numbers, limits)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *map(pa.array, total)], names=["replicate", "n", "a", "s", "t", "tt"])

    thin = rows.where(F.col("residual").isNotNull() & F.col("target").isNotNull())
    thin = thin.select(key.alias("k"), F.col("residual").cast("double").alias("e"), F.col("target").cast("double").alias("t"))
    parts = thin.mapInArrow(add, "replicate long, n double, a double, s double, t double, tt double")
    sums = parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "a", "s", "t", "tt")])
    spread = F.col("tt") - F.col("t") * F.col("t") / F.col("n")
    values = sums.where("n > 0").select(
        (F.col("a") / F.col("n")).alias("mae"),
        F.sqrt(F.col("s") / F.col("n")).alias("rmse"),
        (1.0 - F.try_divide(F.col("s"), spread)).alias("r2"),
    ).unpivot([], ["mae", "rmse", "r2"], "metric", "value")
    tail = (1.0 - level) / 2.0
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return values.groupBy("metric").agg(F.get(q, F.lit(0)).alias("lower"), F.get(q, F.lit(1)).alias("upper"))


def range_index(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Index of the half-open range that holds the value, null outside all."""
    out = F.when(value < ranges[0][0], F.lit(None).cast("int"))
    for i, (low, high) in enumerate(ranges):
        out = out.when((value >= low) if high is None else (value >= low) & (value < high), i)
    return out


def by_range(rows: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """Error of every range of the target; ranges without rows report 0."""
    e = F.col("pred") - F.col("target")
    stats = (
        rows.withColumn("range", range_index(F.col("target"), ranges))
        .where("range IS NOT NULL")
        .groupBy("range")
        .agg(
            F.avg(F.abs(e)).alias("mae"),
            F.stddev_samp(F.abs(e)).alias("std"),
            F.avg(e).alias("signed_mean"),
            F.stddev_samp(e).alias("signed_std"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    names = [(i, f"h_{low}_{high}") for i, (low, high) in enumerate(ranges)]
    table = rows.sparkSession.createDataFrame(names, "range int, range_name string")
    zeros = {"mae": 0.0, "std": 0.0, "signed_mean": 0.0, "signed_std": 0.0}
    out = table.join(stats, "range", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumns({c: F.when(F.col("n") == 0, z).otherwise(F.col(c)) for c, z in zeros.items()})


def frequency_weighted_l1(rows: DataFrame, target: str, error: str, ranges, alpha: float = 0.5, eps: float = 1e-6) -> DataFrame:
    """Mean absolute error with every range weighted by 1 / (frequency^alpha + eps).

    The weight is constant inside a range, so counts and error sums per range are enough.
    """
    per = (
        rows.withColumn("range", range_index(F.col(target), ranges))
        .groupBy("range")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(error)).alias("abs_error"))
    )
    # a handful of ranges: the total is a window over them
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))
    weighted = per.withColumn("frequency", share).withColumn(
        "weight", F.when(F.col("range").isNotNull(), 1.0 / (F.pow("frequency", F.lit(alpha)) + eps)).otherwise(0.0)
    )
    return weighted.agg(
        (F.sum(F.col("weight") * F.col("abs_error")) / F.sum("n")).alias("weighted_l1"),
        (F.sum("abs_error") / F.sum("n")).alias("l1"),
        F.sum("n").alias("n"),
    )


def histogram_2d(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    bins = [F.floor(F.col(c) / width).cast("int").alias(f"{c}_bin") for c in (x, y)]
    return rows.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"))


def histogram_pct(rows: DataFrame, value: str, width: float, top: float) -> DataFrame:
    """Percent of all rows per bin of [0, top]; the last bin includes the top."""
    last = int(top / width) - 1
    at = F.when(F.col(value) == top, last).otherwise(F.floor(F.col(value) / width)).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))
    return counts.withColumn("pct", share).where(F.col("bin").between(0, last))


def residual_boxes(rows: DataFrame, measured: str, residual: str, width: float, bins: int, least: int = 3) -> DataFrame:
    """Quartiles of the residual per bin of the measured value, for bins with enough members."""
    at = F.floor(F.col(measured) / width).cast("int")
    binned = rows.withColumn("bin", at).where(F.col("bin").between(0, bins - 1)).select("bin", residual)
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    q = exact_percentiles(binned, ["bin"], residual, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return counts.join(q, "bin").withColumn("midpoint", (F.col("bin") + 0.5) * width)


def mean_grid(rows: DataFrame, x: str, y: str, value: str, bins: int = 60, least: int = 5, share: float = 0.98) -> DataFrame:
    """Mean of `value` on a square grid whose half-width is the larger `share` percentile of |x| and |y|."""
    rows = stage(rows.select(x, y, value), "grid")
    q = exact_percentiles(
        rows.select(F.explode(F.array(F.struct(F.lit("x").alias("k"), F.abs(x).alias("v")), F.struct(F.lit("y").alias("k"), F.abs(y).alias("v")))).alias("s")).select("s.k", "s.v"),
        ["k"], "v", {"q": share},
    )
    half = q.agg(F.max("q")).scalar()

    def at(col):
        return F.floor((F.col(col) + F.col("_h")) / (2.0 * F.col("_h") / bins)).cast("int")

    placed = rows.withColumn("_h", half).withColumns({"x_bin": at(x), "y_bin": at(y)})
    placed = placed.where(F.col("x_bin").between(0, bins - 1) & F.col("y_bin").between(0, bins - 1))
    return (
        placed.groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max("_h").alias("half_width"))
        .where(F.col("n") > least)
    )


def linear_trend(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n")
    )


def patch_statistics(cells: DataFrame, keys: Sequence[str], value: str, size: int) -> DataFrame:
    """Height statistics of square patches; a patch holds at most size^2 cells of a layer.

    The diversity score is the cube root of std x range x IQR.
    """
    patch = [F.floor(F.col(i) / size).cast("int").alias(f"p{i}") for i in ("r", "c")]
    h = F.col(value)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = F.count(value)
    edges = [0, 1, 2, 4, 8, 12, 16, 20, 25]
    shares = {
        f"pct_{low}_{high if high else 'up'}": 100.0
        * F.count_if((h >= low) & ((h < high) if high else F.lit(True)))
        / n
        for low, high in zip(edges, [*edges[1:], None])
    }
    stats = (
        cells.where(h.isNotNull())
        .groupBy(*keys, *patch)
        .agg(
            n.alias("n_valid"),
            F.min(value).alias("min_height"),
            F.max(value).alias("max_height"),
            F.avg(value).alias("mean_height"),
            F.stddev_samp(value).alias("std_height"),
            q.alias("_q"),
            (F.count_if(h.between(0, 1.5)) / n).alias("low_ratio"),
            *[s.alias(name) for name, s in shares.items()],
        )
    )
    spread = F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)) + 1e-6
    return stats.withColumns(
        {
            "median_height": F.get("_q", F.lit(1)),
            "diversity": F.cbrt(F.col("std_height") * (F.col("max_height") - F.col("min_height")) * spread),
            "valid_ratio": F.col("n_valid") / F.lit(float(size * size)),
        }
    ).drop("_q")


# fixed values of the selection: highest and lowest diversity, share without data, share of low vegetation;
# progress from which thresholds relax, with the share of the batch up to which they do and their place between the limits
LIMITS = (10.0, 3.0, 0.3, 0.7)
LADDER = ((0.25, 0.25, 0.75), (0.5, 0.5, 0.5), (0.75, 0.75, 0.0))
LAST, LAST_DIVERSITY = 0.9, 3.0
EASED = ((0.5, 1.5), (0.75, 3.0))


def diverse_patches(patches: DataFrame, keys: Sequence[str], batch: int, attempts: int, seed: int) -> DataFrame:
    """Batches of `batch` diverse patches per key, with thresholds that relax along the attempts.

    The patches of a key, in hash order, are candidates in blocks of `attempts`, so each is a candidate of one batch.
    A batch tries its candidates in order until it is full. Its state is the number already chosen: the later the
    attempt and the fewer chosen, the lower the diversity that is asked; shares without data and of low vegetation ease
    along the attempts alone. A batch left short is completed by its first candidates that failed. A block is one
    bounded array, folded as an expression; progress is the attempt as a share of the block's candidates.
    """
    keys = list(keys)
    high, low, nodata, lowveg = LIMITS
    names = ["pr", "pc", "diversity", "valid_ratio", "low_ratio"]
    tagged = patches.select(*keys, *names).withColumns({"_u": uniform(seed, *keys, "pr", "pc"), "_one": F.lit(1)})
    ranked = running_totals(tagged, keys, ["_u", "pr", "pc"], ["_one"])
    place = (F.col("_one_run") - 1).cast("long")
    entry = F.struct((place % attempts).cast("int").alias("attempt"), *names)
    key = group_key(keys)
    blocks = ranked.groupBy(key.alias("_key"), F.floor(place / attempts).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(entry)).alias("_tried"))
    blocks = blocks.withColumn("_n", F.size("_tried").cast("double"))

    def judge(state: Column, x: Column) -> Column:
        progress, chosen = x["attempt"] / F.col("_n"), state["chosen"]
        ease = F.lit(1.0)
        for start, factor in EASED:
            ease = F.when(progress > start, factor).otherwise(ease)
        fits = (progress > LAST) | ((x["valid_ratio"] >= 1.0 - nodata * ease) & (x["low_ratio"] <= lowveg * ease))
        asked = F.lit(high)
        for start, share, part in LADDER:
            asked = F.when((progress > start) & (chosen <= batch * share), low + (high - low) * part).otherwise(asked)
        asked = F.when((progress > LAST) & (chosen <= batch), LAST_DIVERSITY).otherwise(asked)
        passed = (chosen < batch) & F.coalesce(fits & (x["diversity"] >= asked), F.lit(False))
        mark = F.when(chosen >= batch, F.lit(None).cast("boolean")).otherwise(passed)  # a full batch tries no more
        return F.struct((chosen + passed.cast("int")).alias("chosen"), F.concat(state["marks"], F.array(mark)).alias("marks"))

    start = F.struct(F.lit(0).alias("chosen"), F.array().cast("array<boolean>").alias("marks"))
    marks = F.aggregate("_tried", start, judge)["marks"]
    rows = blocks.withColumn("_m", marks).select("_key", "batch", F.explode(F.arrays_zip("_tried", "_m")).alias("t"))
    rows = rows.select("_key", "batch", "t._tried.*", F.coalesce("t._m", F.lit(False)).alias("passed"), F.col("t._m").isNotNull().alias("tried"))
    best = W.partitionBy("_key", "batch").orderBy(F.desc("passed"), F.desc("tried"), "attempt")
    rows = rows.withColumn("pick", F.row_number().over(best)).where(F.col("pick") <= batch)
    return rows.select(*[F.col(f"_key.{k}") for k in keys], "batch", "attempt", "pr", "pc", "passed", "diversity", "pick")
