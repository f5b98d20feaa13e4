"""Spatial autocorrelation: lag sums of a grid, binned semivariograms, model fit, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.operators import ranking
from sylvagrid.operators.ranking import exact_percentiles
from sylvagrid.session import stage


def lag_sums(
    cells: DataFrame, keys: Sequence[str], value: str, reach: int, references: int = 100_000, ident: Sequence[str] = ("r", "c"), seed: int = 17
) -> DataFrame:
    """(keys, lag, n_pairs, gamma_sum): half squared differences of all cells of a grid within `reach` of a reference cell.

    `lag` is the squared distance in cells; `r` and `c` are the places of a cell. At most `references` cells of a key
    are reference cells, an exact-size sample by hash; each is paired with every other cell in reach, so a pair of two
    reference cells counts twice. Cells are dealt out as square tiles of `reach` cells, each tile also to its eight
    neighbours, so that a task holds all that its own tile reaches: at most nine tiles, whatever the grid. It adds up
    one row shift of the tile against its surroundings at a time, for all columns by one product of matrices. Rows without a value take no part, and of rows that
    repeat a place the largest value counts.
    """
    keys = list(keys)
    known = cells.where(F.col(value).isNotNull()).groupBy(*keys, "r", "c", *[i for i in ident if i not in ("r", "c")]).agg(F.max(value).cast("double").alias("v"))
    known = stage(known, "cells")
    most = known.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > references:
        chosen = ranking.sample_exact(known.select(*keys, *ident), keys, list(ident), references, seed)
        chosen = chosen.select(ranking.group_key(keys).alias("_key"), *ident, F.lit(True).alias("ref"))
        known = known.withColumn("_key", ranking.group_key(keys)).join(chosen, ["_key", *ident], "left").withColumn("ref", F.coalesce("ref", F.lit(False)))
    else:
        known = known.withColumn("ref", F.lit(True))
    every = most <= references
    tile = [F.floor(F.col(i) / reach).cast("int") for i in ("r", "c")]
    # if all cells are reference cells each pair is found from its upper cell: no tile above the own one is needed
    sides = [(i, j) for i in ((0, 1) if every else (-1, 0, 1)) for j in (-1, 0, 1)]
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in sides]))
    dealt = known.select(*keys, "r", "c", "v", "ref", tile[0].alias("_r"), tile[1].alias("_c"), spot.alias("_s"))
    dealt = dealt.select(*keys, "r", "c", "v", (F.col("ref") & (F.col("_s.i") == 0) & (F.col("_s.j") == 0)).alias("own"), (F.col("_r") - F.col("_s.i")).alias("tr"), (F.col("_c") - F.col("_s.j")).alias("tc"))
    key_fields = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.own.to_numpy(bool)
        r, c, v = frame.r.to_numpy(), frame.c.to_numpy(), frame.v.to_numpy()
        n, gamma = np.zeros(reach * reach + 1), np.zeros(reach * reach + 1)
        if own.any():
            top, height = r[own].min(), int(np.ptp(r[own])) + 1
            first, width = c[own].min(), int(np.ptp(c[own])) + 1
            left, right = (int(min(reach, max(0, x))) for x in (first - c.min(), c.max() - c[own].max()))
            up = 0 if every else reach
            v = v - v[own].mean()  # differences do not change, and squares stay small
            inside = (r >= top - up) & (r < top + height + reach) & (c >= first - left) & (c < first + width + right)
            values, known = (np.zeros((up + height + reach, left + width + right)) for _ in range(2))
            spot = (r[inside] - (top - up), c[inside] - (first - left))
            values[spot], known[spot] = v[inside], 1.0
            mine, there = (np.zeros((height, width)) for _ in range(2))
            spot = (r[own] - top, c[own] - first)
            mine[spot], there[spot] = v[own], 1.0
            # sums of (a - b)^2 over all columns of the tile and of its surroundings, one product of matrices per row shift
            tile_side = np.concatenate([mine * mine, there, -2 * mine]).T.copy()
            around = [known, values * values, values]
            gap = np.arange(left + width + right)[None] - left - np.arange(width)[:, None]
            for dr in range(-up, reach + 1):
                part = [x[up + dr : up + dr + height] for x in around]
                if not part[0].any():
                    continue
                lag = dr * dr + gap * gap
                use = (lag <= reach * reach) & (lag > 0)
                if every and dr == 0:
                    use &= gap > 0
                at = lag[use]
                n += np.bincount(at, (there.T @ part[0])[use], len(n))
                gamma += np.bincount(at, (tile_side @ np.concatenate(part))[use], len(n))
        n = np.rint(n).astype(np.int64)
        found = np.flatnonzero(n)
        # from one side: each pair stands for both directions
        out = pd.DataFrame({"lag": found, "n_pairs": n[found] * (2 if every else 1), "gamma_sum": gamma[found] * (1 if every else 0.5)})
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "lag", "n_pairs", "gamma_sum"]]

    schema = f"{key_fields}{', ' if keys else ''}lag long, n_pairs long, gamma_sum double"
    per_tile = dealt.groupBy(*keys, "tr", "tc").applyInPandas(add, schema)
    return per_tile.groupBy(*keys, "lag").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("gamma_sum").alias("gamma_sum"))


def binned(lags: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Mean semivariance in equal-width distance bins from 0 to the largest distance of the key."""
    widest = lags.groupBy(*keys).agg((F.max("distance") / bins).alias("_w"))
    at = F.least(F.floor(F.col("distance") / F.col("_w")), F.lit(bins - 1)).cast("int")
    return (
        lags.join(widest, list(keys))
        .groupBy(*keys, at.alias("bin"))
        .agg(
            (F.sum("gamma_sum") / F.sum("n_pairs")).alias("semivariance"),
            F.sum("n_pairs").alias("n_pairs"),
            F.max("_w").alias("_w"),
        )
        .withColumn("distance", (F.col("bin") + 0.5) * F.col("_w"))
        .drop("_w")
    )


def autocorrelation_range(curve: DataFrame, keys: Sequence[str], share: float = 0.95) -> DataFrame:
    """Nugget, sill and the first bin centre that reaches `share` of the sill (0 below three bins)."""
    whole = W.partitionBy(*keys)
    reach = F.when(F.col("semivariance") >= share * F.col("_sill"), F.col("distance"))
    return (
        curve.withColumn("_sill", F.max("semivariance").over(whole))
        .groupBy(*keys)
        .agg(
            F.max("_sill").alias("sill"),
            F.coalesce(F.min(F.when(F.col("bin") == 0, F.col("semivariance"))), F.lit(0.0)).alias("nugget"),
            F.when(F.count(F.lit(1)) >= 3, F.min(reach)).otherwise(F.lit(0.0)).alias("range"),
            F.max("distance").alias("max_distance"),
            F.sum("n_pairs").alias("n_pairs"),
        )
    )


def fit_exponential(curve: DataFrame, keys: Sequence[str], ranges: Sequence[float]) -> DataFrame:
    """nugget + (sill - nugget)(1 - exp(-h / range)) by least squares over a list of ranges.

    For a given range the model is linear in (nugget, sill - nugget), so each
    candidate is one closed-form regression; a negative nugget is refitted at 0.
    """
    tried = curve.withColumn("range", F.explode(F.array(*[F.lit(float(r)) for r in ranges]))).withColumn(
        "_u", 1.0 - F.exp(-F.col("distance") / F.col("range"))
    )
    g = F.col("semivariance")
    fits = tried.groupBy(*keys, "range").agg(
        F.regr_intercept(g, F.col("_u")).alias("_n"),
        F.regr_slope(g, F.col("_u")).alias("_k"),
        (F.sum(g * F.col("_u")) / F.sum(F.col("_u") * F.col("_u"))).alias("_k0"),
    )
    fits = fits.withColumns(
        {
            "nugget": F.greatest("_n", F.lit(0.0)),
            "_k": F.when(F.col("_n") < 0, F.col("_k0")).otherwise(F.col("_k")),
        }
    ).withColumn("_k", F.greatest("_k", F.lit(0.0)))
    error = g - F.col("nugget") - F.col("_k") * F.col("_u")
    scored = (
        tried.join(fits, [*keys, "range"])
        .groupBy(*keys, "range", "nugget", (F.col("nugget") + F.col("_k")).alias("sill"))
        .agg(F.sum(error * error).alias("sse"))
    )
    best = F.min_by(F.struct("nugget", "sill", "range", "sse"), F.struct(F.round("sse", 6), "range"))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.nugget", "b.sill", "b.range", "b.sse")


def cluster_extent(points: DataFrame, cluster: str) -> DataFrame:
    """Centroid, size and 90th-percentile radius of every cluster."""
    centres = points.groupBy(cluster).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    far = points.join(centres, cluster).select(cluster, F.sqrt(dx * dx + dy * dy).alias("_d"))
    return centres.join(exact_percentiles(far, [cluster], "_d", {"radius": 0.9}), cluster)


def cluster_separation(extent: DataFrame, cluster: str) -> DataFrame:
    """Distance of every cluster to the nearest and to all other clusters.

    The centroids (one per cluster, a fixed small number) travel as one array.
    """
    every = extent.agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "cx", "cy"))).scalar()
    others = extent.withColumn("_all", every).withColumn("_o", F.explode("_all")).where(F.col("_o.id") != F.col(cluster))
    dx, dy = F.col("_o.cx") - F.col("cx"), F.col("_o.cy") - F.col("cy")
    return others.groupBy(cluster).agg(
        F.min(F.sqrt(dx * dx + dy * dy)).alias("nearest"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_separation")
    )
