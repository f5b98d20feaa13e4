"""Zonal sums. Cells are reduced to (year, zone) partial sums before any shuffle
and only the small result meets the descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zonal_sum(cells: DataFrame, keys: Sequence[str], value: str, area_ha: float = 1.0, name: str = "total") -> DataFrame:
    """Tonnes per zone: density times cell area; a zone of nulls sums to 0."""
    return cells.groupBy(*keys).agg((F.coalesce(F.sum(value), F.lit(0.0)) * area_ha).alias(name))


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open bin; the last bin has no upper edge."""
    out = F.when(value < edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value < upper, F.lit(label))
    return out.when(value >= edges[-1], F.lit(labels[-1]))


def group_of_class(klass: Column, groups: dict[str, Sequence[int]]) -> Column:
    """Name of the group that lists the class, null for unlisted classes."""
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(klass.isin(list(members)), F.lit(name)).otherwise(out)
    return out


def hierarchy(codes: DataFrame, tiers: DataFrame, default_name: str, recode: dict[str, str]) -> DataFrame:
    """code -> name, genus, clade.

    `codes(code, name)` meets `tiers(name, genus, clade)`; code 0 is added when
    absent, a missing genus takes the name, a missing clade becomes Unknown, and
    of several rows for a code the smallest name is used.
    """
    joined = codes.join(tiers.select("name", "genus", "clade"), "name", "left")
    default = codes.sparkSession.createDataFrame(
        [(0, default_name, default_name, default_name)], "code int, name string, genus string, clade string"
    ).join(codes.where("code = 0"), "code", "left_anti")
    full = joined.select("code", "name", "genus", "clade").unionByName(default)
    clade = F.col("clade")
    for old, new in recode.items():
        clade = F.when(F.col("clade") == old, F.lit(new)).otherwise(clade)
    first = F.min_by(F.struct("name", "genus", "clade"), F.col("name"))
    return (
        full.groupBy("code")
        .agg(first.alias("s"))
        .select("code", "s.name", "s.genus", "s.clade")
        .select(
            "code",
            "name",
            F.coalesce("genus", "name").alias("genus"),
            F.coalesce(clade, F.lit("Unknown")).alias("clade"),
        )
    )


def rollup_levels(stocks: DataFrame, value: str) -> DataFrame:
    """Type stocks summed to genus (within clade) and to clade, in one pass."""
    return (
        stocks.groupingSets([["yr", "clade", "genus"], ["yr", "clade"]], "yr", "clade", "genus")
        .agg(F.sum(value).alias(value), F.grouping("genus").alias("_g"))
        .select("yr", F.when(F.col("_g") == 0, "genus").otherwise("clade").alias("level"), "clade", "genus", value)
    )
