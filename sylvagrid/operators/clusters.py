"""k-means on coordinates, for all cluster counts and restarts at once.

A step of all of them is one aggregate: each task adds up, per configuration and cluster, the count,
coordinate sums and squared distances of its points, and Spark adds the few rows of the tasks. Points
at one place are one with their count. The driver holds the centres alone. Starts are spread over a sample of fixed size, chosen by hash, so a
run repeats; a point between two centres belongs to the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagrid.operators import ranking, series
from sylvagrid.session import stage

# points that starts are drawn from, steps of a run, and the movement (squared, relative to the extent) that ends it
STARTS, STEPS, STILL = 512, 60, 1e-8
SUMS = "config int, cluster int, n long, sx double, sy double, cost double"


def spread_starts(points: np.ndarray, k: int, seed: Sequence[int]) -> np.ndarray:
    """`k` starts, each drawn with a chance that grows with the squared distance to those before."""
    random = np.random.default_rng(list(seed))
    centres = [points[random.integers(len(points))]]
    while len(centres) < k:
        gap = ((points[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
        if gap.sum() == 0:
            centres.append(points[random.integers(len(points))])
        else:
            centres.append(points[random.choice(len(points), p=gap / gap.sum())])
    return np.array(centres)


def nearest(xy: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of every point, the first of equal ones, and the squared distance; one centre at a time."""
    x, y = np.ascontiguousarray(xy[:, 0]), np.ascontiguousarray(xy[:, 1])
    at, least = np.zeros(len(xy), np.int64), np.full(len(xy), np.inf)
    for k, (cx, cy) in enumerate(centres):
        gap = (x - cx) ** 2 + (y - cy) ** 2
        at[gap < least] = k
        np.minimum(gap, least, out=least)
    return at, least


def step_sums(points: DataFrame, configs: list[np.ndarray]) -> list[np.ndarray]:
    """Per configuration: (n, sum x, sum y, cost) of each cluster; one aggregate over the points, which count `n` times if they say so."""
    weighted = "n" in points.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 4)) for c in configs]
        for b in batches:
            xy = np.column_stack([b["x"].to_numpy(), b["y"].to_numpy()])
            n = b["n"].to_numpy() if weighted else np.ones(len(xy))
            x, y = n * xy[:, 0], n * xy[:, 1]
            for c, sums in zip(configs, total):
                at, gap = nearest(xy, c)
                for j, w in enumerate((n, x, y, n * gap)):
                    sums[:, j] += np.bincount(at, w, len(c))
        config = np.repeat(np.arange(len(configs)), [len(c) for c in configs])
        cluster = np.concatenate([np.arange(len(c)) for c in configs])
        columns = np.concatenate(total).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(config, pa.int32()), pa.array(cluster, pa.int32()), pa.array(columns[0].astype(np.int64)), *map(pa.array, columns[1:])],
            names=["config", "cluster", "n", "sx", "sy", "cost"],
        )

    sums = points.mapInArrow(add, SUMS).groupBy("config", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "cost")])
    out = [np.zeros((len(c), 4)) for c in configs]
    for r in sums.collect():  # a row per centre
        out[r["config"]][r["cluster"]] = r["n"], r["sx"], r["sy"], r["cost"]
    return out


def lloyd(points: DataFrame, starts: list[np.ndarray], steps: int = STEPS) -> tuple[list[np.ndarray], list[float]]:
    """Centres and cost of each configuration after Lloyd steps; those at rest leave the aggregate."""
    centres, cost, moving = [c.copy() for c in starts], [np.inf] * len(starts), list(range(len(starts)))
    for _ in range(steps):
        for i, sums in zip(list(moving), step_sums(points, [centres[i] for i in moving])):
            cost[i] = float(sums[:, 3].sum())
            full = sums[:, 0] > 0
            new = centres[i].copy()
            new[full] = np.round(sums[full, 1:3] / sums[full, :1], 6)
            still = ((new - centres[i]) ** 2).sum(axis=1).max() <= STILL * max(1.0, (np.ptp(centres[i], axis=0) ** 2).sum())
            centres[i] = new
            if still:
                moving.remove(i)
        if not moving:
            break
    return centres, cost


def fit_all(points: DataFrame, counts: Sequence[int], restarts: int, seed: int = 42) -> dict[int, tuple[np.ndarray, float]]:
    """Best centres and cost over `restarts` starts, for each cluster count."""
    at = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    xy = stage(points.groupBy(*at).agg(F.count(F.lit(1)).alias("n")), "points", spread_rows=True)
    named = xy.withColumn("_id", F.xxhash64("x", "y")).dropDuplicates(["_id"])
    some = ranking.sample_exact(named, [], ["_id"], STARTS, seed).orderBy("x", "y").toPandas()[["x", "y"]].to_numpy()
    if not len(some):
        return {}
    configs = [(k, r) for k in counts for r in range(restarts)]
    centres, cost = lloyd(xy, [spread_starts(some, k, (seed, k, r)) for k, r in configs])
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), c, value in zip(configs, centres, cost):
        if k not in best or value < best[k][1]:
            best[k] = (c[np.lexsort(c.T[::-1])], value)  # centres from west to east
    return best


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """`points` with `cluster_id`, the number of the nearest centre; the first of equal ones."""
    gaps = [(F.col("x") - float(cx)) ** 2 + (F.col("y") - float(cy)) ** 2 for cx, cy in centres]
    return points.withColumn("cluster_id", F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))).cast("int") - 1)


def assign_nearest(points: DataFrame, centres: DataFrame, ident: str) -> DataFrame:
    """`points` with the `ident` and distance of the nearest centre, the smallest ident of equal ones; centres are few."""
    every = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"))))).scalar()

    def gap(c: Column) -> Column:
        return F.struct(((F.col("x") - c["cx"]) ** 2 + (F.col("y") - c["cy"]) ** 2).alias("d"), c["id"].alias("id"))

    found = points.withColumn("_every", every).withColumn("_c", F.array_min(F.transform("_every", gap)))
    return found.withColumns({ident: F.col("_c.id"), "distance": F.sqrt("_c.d")}).drop("_c", "_every")


def k_means(points: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> DataFrame:
    """`points` with `cluster_id` by the best of some restarts."""
    best = fit_all(points, [k], restarts, seed)
    return assign(points, best[k][0]) if best else points.withColumn("cluster_id", F.lit(None).cast("int"))


def cluster_count(points: DataFrame, least: int = 2, most: int = 15, min_size: int = 50, restarts: int = 5, seed: int = 42) -> int:
    """Cluster count at the knee of the cost over the full range; a range limited by the mean size of a cluster.

    Without a knee, two above the least; without a range, the least.
    """
    n = points.count()
    most = min(most, n // min_size, max(n // 10 - 1, 0))
    if most <= least:
        return least
    costs = [(float(k), cost) for k, (_, cost) in sorted(fit_all(points, range(least, most + 1), restarts, seed).items())]
    curve = points.sparkSession.createDataFrame(costs, "k double, cost double")
    knee = series.knee(curve, [], "k", "cost", increasing=False).first()
    found = int(knee["knee_x"]) if knee and knee["knee_gap"] and knee["knee_gap"] > 0 else least + 2
    return min(max(found, least), most)
