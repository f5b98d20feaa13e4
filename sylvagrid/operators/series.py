"""Windows over short series: years of a total, bins of a curve, trials of a run.

Every function first expects its input reduced to the series itself; the rows of
one series are bounded by the number of years, bins or trials.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _series(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def annual_flux(totals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Year-on-year change (0 in the first year), its running sum, percent change, mid-year."""
    by_year = _series(keys).orderBy("yr")
    before = F.lag(value).over(by_year)
    flux = totals.withColumns(
        {
            "annual_flux": F.coalesce(F.col(value) - before, F.lit(0.0)),
            "pct_change": F.try_divide(F.col(value) - before, before) * 100.0,
            "year_mid": F.col("yr") + 0.5,
        }
    )
    return flux.withColumn(
        "cumulative_flux", F.sum("annual_flux").over(by_year.rowsBetween(W.unboundedPreceding, W.currentRow))
    )


def baseline_index(totals: DataFrame, keys: Sequence[str], value: str, base_year: int) -> DataFrame:
    """Value relative to the base year (= 100); series without a positive base are dropped."""
    base = F.max(F.when(F.col("yr") == base_year, F.col(value))).over(_series(keys))
    return (
        totals.withColumn("_base", base)
        .where(F.col("_base") > 0)
        .withColumn("relative_value", F.col(value) / F.col("_base") * 100.0)
        .drop("_base")
    )


def share_of_total(totals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    whole = F.sum(value).over(W.partitionBy(*keys))
    return totals.withColumn("percentage", F.try_divide(F.col(value), whole) * 100.0)


def knee(curve: DataFrame, keys: Sequence[str], x: str, y: str, increasing: bool) -> DataFrame:
    """Knee of a monotone curve: largest distance above (below) the chord of the unit box."""
    whole = _series(keys)

    def unit(col):
        low, high = F.min(col).over(whole), F.max(col).over(whole)
        return F.coalesce(F.try_divide(F.col(col) - low, high - low), F.lit(0.0))

    gap = unit(y) - unit(x) if increasing else F.lit(1.0) - unit(x) - unit(y)
    scored = curve.withColumn("_gap", gap)
    best = F.max_by(F.struct(x, y, "_gap"), F.struct(F.round("_gap", 9), -F.col(x)))
    return (
        scored.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, F.col(f"b.{x}").alias("knee_x"), F.col(f"b.{y}").alias("knee_y"), F.col("b._gap").alias("knee_gap"))
    )


def diminishing_returns(curve: DataFrame, keys: Sequence[str], n: str, diff: str, limit: float = 0.05) -> DataFrame:
    """First n whose successor improves by less than `limit`; else the largest n."""
    by_n = _series(keys).orderBy(n)
    gain = F.try_divide(F.col(diff) - F.lead(diff).over(by_n), F.col(diff))
    stop = F.lead(n).over(by_n).isNotNull() & (gain < limit)
    return (
        curve.withColumn("_stop", F.when(stop, F.col(n)))
        .groupBy(*keys)
        .agg(F.coalesce(F.min("_stop"), F.max(n)).alias("optimal_n"))
    )


def early_stop(trials: DataFrame, keys: Sequence[str], trial: str, value: str, patience: int, min_trials: int) -> DataFrame:
    """Trial at which a search stops: `patience` checks in a row without a new best.

    `trial` numbers a run's trials 0, 1, 2, ...; checking begins when
    `min_trials` trials exist, and the first check always counts as an improvement.
    """
    by_trial = _series(keys).orderBy(trial)
    so_far = by_trial.rowsBetween(W.unboundedPreceding, W.currentRow)
    first_check = min_trials - 1
    seen = trials.withColumn("_best", F.max(value).over(so_far)).where(F.col(trial) >= first_check)
    better = (F.col(trial) == first_check) | (F.col("_best") > F.lag("_best").over(by_trial))
    marked = seen.withColumn("_last", F.max(F.when(better, F.col(trial))).over(so_far))
    hit = F.col(trial) - F.col("_last") >= patience
    return marked.groupBy(*keys).agg(
        F.min(F.when(hit, F.col(trial))).alias("stop_trial"),
        F.max_by("_last", trial).alias("last_best_trial"),
        F.max("_best").alias("best_value"),
    )
