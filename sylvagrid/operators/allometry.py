"""Robust trimming and quantile regression of log height against log biomass.

Every step is a grouped aggregate over all rows; a tier such as General holds all
plots, so order statistics come from the value-partitioned percentiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.operators.ranking import exact_percentiles, group_key, part_levels, splitters, with_place
from sylvagrid.session import stage

# Chi-square quantiles (2 degrees of freedom) at 0.5 and 0.975.
CHI2_HALF = 2.0 * math.log(2.0)
CHI2_975 = -2.0 * math.log(0.025)


def _centre(used: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Staged centre and scatter per group: one row each."""
    fit = used.groupBy(group_key(keys).alias("_fit_key")).agg(
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"),
        F.covar_pop(x, y).alias("_vxy"),
    )
    return stage(fit, "centres")


def _measured(rows: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Squared Mahalanobis distance of all rows from the centre and scatter of their group."""
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    det = F.col("_vx") * F.col("_vy") - F.col("_vxy") * F.col("_vxy")
    d2 = F.try_divide(F.col("_vy") * dx * dx - 2.0 * F.col("_vxy") * dx * dy + F.col("_vx") * dy * dy, det)
    joined = rows.join(fit, group_key(keys) == F.col("_fit_key"))
    return joined.select(*rows.columns, F.coalesce(d2, F.lit(0.0)).alias("_d2"))


def trim_outliers(
    rows: DataFrame, keys: Sequence[str], x: str, y: str, contamination: float = 0.12, steps: int = 3
) -> DataFrame:
    """Drop the most distant `contamination` share of every group.

    Minimum-covariance steps: estimate from all rows, then repeatedly from the
    half nearest to the last estimate, then once from the rows inside the 97.5 %
    ellipse (scaled by the median distance); the final distances decide. The rows
    are staged once; a step stages its centres and cuts, one row per group, and
    distances are computed again where they are read.
    """
    rows = stage(rows, "trim", spread_rows=True)

    def within(measured, share, factor=1.0):
        cut = exact_percentiles(measured, keys, "_d2", {"_cut": share}, staged=True)
        cut = stage(cut.select(group_key(keys).alias("_cut_key"), "_cut"), "cuts")
        return measured.join(cut, group_key(keys) == F.col("_cut_key")).where(F.col("_d2") <= F.col("_cut") * factor)

    measured = _measured(rows, _centre(rows, keys, x, y), keys, x, y)
    for _ in range(steps):
        measured = _measured(rows, _centre(within(measured, 0.5), keys, x, y), keys, x, y)
    inside = within(measured, 0.5, CHI2_975 / CHI2_HALF)
    measured = _measured(rows, _centre(inside, keys, x, y), keys, x, y)
    return within(measured, 1.0 - contamination).select(*rows.columns)


def _lines(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged (candidate, qs): the group and slope of every candidate line as one struct."""
    return stage(candidates.withColumn("_c", F.struct(group_key(keys).alias("k"), F.col("slope").alias("s"))).select("_c", "qs"), "candidates")


def _tried(rows: DataFrame, lines: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(candidate, residual, number) of all rows and the candidates of their group."""
    lines = lines.select("_c", F.col("_c.k").alias("_line_key"), F.col("_c.s").alias("_s"))
    residual = (F.col(y) - F.col("_s") * F.col(x)).alias("_r")
    return rows.join(lines, group_key(keys) == F.col("_line_key")).select("_c", residual, "_w")


def _scored(rows: DataFrame, named: DataFrame, cuts: DataFrame | None, levels: int, keys: Sequence[str], x: str, y: str, alpha: float) -> DataFrame:
    """(keys, q, slope, intercept, loss): mean pinball loss plus the slope penalty of every candidate line.

    `named` are the candidates, each with the quantiles `qs` that it is tried for, a few
    rows per group. `rows` that are alike come once with their number `_w`. `cuts` are the 2**levels - 1
    splitters of the value parts. Residuals exist only where they are scanned: counts and sums per
    (candidate, value part) leave the scan, then the residuals between the ends of the parts that hold a
    quantile. The loss follows from the sums on both sides of the quantile.
    """
    ends = cuts.scalar() if cuts is not None else F.array().cast("array<double>")
    cut = with_place(_tried(rows, named, keys, x, y), "_part", ends, F.col("_r"), levels)
    before = W.partitionBy("_c").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_c")
    per = cut.groupBy("_c", "_part").agg(F.sum("_w").alias("_m"), F.sum(F.col("_w") * F.col("_r")).alias("_t"))
    per = per.select(
        "*",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_below"),
        F.sum("_m").over(whole).alias("_n"),
        F.sum("_t").over(whole).alias("_sum"),
    )
    wanted = per.join(named, "_c").withColumn("q", F.explode("qs")).drop("qs")
    rank = F.greatest(F.ceil(F.col("q") * F.col("_n") - 1e-9) - 1, F.lit(0))
    hits = stage(wanted.where((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_m"))).withColumn("_rank", rank), "parts")
    inside = W.partitionBy("_c", "_part").orderBy("_r")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = hits.select("_c", "_part").distinct().select("*", F.get(ends, F.col("_part") - 1).alias("_low"), F.get(ends, F.col("_part")).alias("_high"))
    parts = stage(parts.select("*", F.col("_c.k").alias("_line_key"), F.col("_c.s").alias("_s")), "parts")
    residual = F.col(y) - F.col("_s") * F.col(x)
    # an end that is missing bounds nothing; residuals that are missing are in the first part
    inside_part = F.when(F.col("_part") > 0, residual >= F.col("_low")).otherwise(True) & (F.col("_high").isNull() | (residual < F.col("_high")))
    held = F.coalesce(inside_part, F.col("_part") == 0)
    near = rows.join(parts, (group_key(keys) == F.col("_line_key")) & held).select("_c", "_part", residual.alias("_r"), "_w")
    near = near.groupBy("_c", "_part", "_r").agg(F.sum("_w").alias("_k"))
    near = near.withColumns({"_end": F.sum("_k").over(upto), "_upto": F.sum(F.col("_k") * F.col("_r")).over(upto)})
    at = near.join(hits, ["_c", "_part"]).where(F.col("_start") + F.col("_end") > F.col("_rank"))
    first = F.min(F.struct("_r", "_k", "_end", "_upto")).alias("_a")
    found = at.groupBy("_c", "q").agg(first, *[F.first(c).alias(c) for c in ("_start", "_below", "_n", "_sum")])
    value = F.col("_a._r")
    n_below = F.col("_start") + F.col("_a._end") - F.col("_a._k")
    s_below = F.col("_below") + F.col("_a._upto") - F.col("_a._k") * value
    above = F.col("_sum") - s_below - (F.col("_n") - n_below) * value
    loss = (F.col("q") * above + (1.0 - F.col("q")) * (n_below * value - s_below)) / F.col("_n")
    return found.select("_c.k.*", "q", F.col("_c.s").alias("slope"), value.alias("intercept"), (loss + alpha * F.abs("_c.s")).alias("loss"))


def quantile_lines(
    rows: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    quantiles: Sequence[float] = (0.15, 0.5, 0.85),
    alpha: float = 0.05,
    first: Sequence[float] = (-0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5),
    refinements: int = 3,
) -> DataFrame:
    """Quantile regression lines per group: slope, intercept and loss for every quantile.

    For a given slope the best intercept is the q-quantile of y - slope x, and the
    loss is convex in the slope. The coarse slopes serve all quantiles at once and
    bracket the best one; every refinement then tries four slopes inside each
    quantile's bracket, which makes it three times narrower. The rows are staged once,
    those alike in group, x and y as one with their number; tables of a few rows per
    group are staged between the rounds.
    """
    keys = list(keys)
    rows = stage(rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w")), "lines", spread_rows=True)
    pick = F.min_by(F.struct("slope", "intercept", "loss"), F.struct(F.round("loss", 10), "slope"))

    def best_of(scored):
        chosen = scored.groupBy(group_key(keys).alias("_key"), "q").agg(pick.alias("b"))
        return stage(chosen.select("_key.*", "q", "b.slope", "b.intercept", "b.loss"), "best")

    every = F.array(*[F.lit(float(q)) for q in quantiles]).alias("qs")
    coarse = F.explode(F.array(*[F.lit(float(s)) for s in first])).alias("slope")
    lines = _lines(rows.select(*keys).distinct().select(*keys, coarse, every), keys)
    levels = part_levels(rows.count())
    # slopes tried later lie between the coarse ones, and parts are counted anew: the splitters serve all rounds
    cuts = splitters(_tried(rows, lines, keys, x, y), "_r", 2**levels) if levels else None
    best = best_of(_scored(rows, lines, cuts, levels, keys, x, y, alpha))
    step = first[1] - first[0]
    for _ in range(refinements):
        step = step / 3.0
        around = F.explode(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)])).alias("_i")
        near = best.select(*keys, "q", "slope", around)
        near = near.withColumn("slope", F.round(F.col("slope") + F.col("_i") * step, 9))
        tried = near.groupBy(group_key(keys).alias("_key"), "slope").agg(F.collect_set("q").alias("qs")).select("_key.*", "slope", "qs")
        best = best_of(_scored(rows, _lines(tried, keys), cuts, levels, keys, x, y, alpha).select(*best.columns).unionByName(best))
    return best


def score_lines(rows: DataFrame, lines: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """R2 of the line in log space and RMSE in natural units, per group."""
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    error = F.col(y) - fitted
    natural = F.exp(y) - F.exp(fitted)
    n = F.count(F.lit(1))
    return (
        rows.join(lines.select(*keys, "slope", "intercept"), list(keys))
        .groupBy(*keys)
        .agg(
            n.alias("n_samples"),
            (1.0 - F.try_divide(F.sum(error * error), n * F.var_pop(y))).alias("r2"),
            F.sqrt(F.avg(natural * natural)).alias("rmse"),
        )
    )


def power_laws(
    rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 10, min_r2: float = 0.1, min_slope: float = 0.0, **options
) -> DataFrame:
    """One row per group: median, lower and upper line, fit quality; weak fits are dropped."""
    lines = stage(quantile_lines(rows, keys, x, y, **options), "lines")
    names = {0.15: "low_bound", 0.5: "median", 0.85: "upper_bound"}
    wide = lines.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("q") == q, F.col(c))).alias(f"{name}_{c}")
            for q, name in names.items()
            for c in ("slope", "intercept")
        ]
    )
    scores = score_lines(rows, lines.where("q = 0.5D"), keys, x, y)
    kept = (F.col("n_samples") >= least) & (F.col("r2") >= min_r2) & (F.col("median_slope") >= min_slope)
    return wide.join(scores, list(keys)).where(kept)
