"""Cell-level quality rules and masks. Projections, but for the rules about whole groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nodata_to_null(value: Column, nodata: float, cap: float | None = None) -> Column:
    """Sentinel to null and, with a cap, implausibly high values to null."""
    kept = F.nullif(value, F.lit(nodata))
    return kept if cap is None else F.when(kept <= cap, kept)


def within_limits(value: Column, low: float, high: float) -> Column:
    """Above `high` becomes null, below `low` becomes `low`, null stays null."""
    return F.when(value > high, F.lit(None).cast("double")).when(value < low, F.lit(low)).otherwise(value)


def is_close(value: Column, target: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(value - F.lit(target)) <= F.lit(rtol * abs(target) + atol)


def is_outlier(value: Column, nodata: float, low: float = 0.0, high: float = 60.0) -> Column:
    """Outside [low, high] and not the nodata sentinel."""
    return ((value > high) | (value < low)) & ~is_close(value, nodata)


def drop_classes(value: Column, klass: Column, classes: Iterable[int]) -> Column:
    """Null where the class is listed; an unknown class keeps the value."""
    return F.when(~F.coalesce(klass.isin(list(classes)), F.lit(False)), value)


def keep_classes(value: Column, klass: Column, classes: Iterable[int]) -> Column:
    return F.when(klass.isin(list(classes)), value)


def guarded_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole))


def all_bands_valid(bands: Sequence[str], nodata: float = 0.0) -> Column:
    return ~F.exists(F.array(*bands), lambda x: x == nodata)


def symmetric_change(before: Column, after: Column) -> Column:
    """200 (b - a) / (a + b) in percent, 0 where the sum is not positive."""
    whole = before + after
    return F.when(whole > 0, F.lit(200.0) * (after - before) / whole).otherwise(F.lit(0.0))


def drop_groups_with_null(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of the groups in which no member lacks `value`; null keys are a group like any other.

    One read and one shuffle: a count over the group, whose rows are buffered and spill where it is large.
    """
    gaps = F.count_if(F.col(value).isNull()).over(W.partitionBy(*keys))
    return df.withColumn("_gaps", gaps).where("_gaps = 0").drop("_gaps")


def sigma_clip(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Rows within k sample standard deviations of the mean."""
    centre = df.agg(F.avg(value)).scalar()
    spread = df.agg(F.stddev_samp(value)).scalar()
    return df.where(F.abs(F.col(value) - centre) <= k * spread)
