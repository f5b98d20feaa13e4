"""File and scene catalogs: search, names, work lists, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relaxed_search(items: DataFrame, keys: Sequence[str], cloud: str, start: int, step: int, least: int, cap: int) -> DataFrame:
    """Items below the first cloud limit that yields enough of them, per key.

    Limits are start, start + step, ...; the search stops at `least` items or at
    the first limit >= cap. An item of unknown cloud cover is below no limit. Every item is counted once, at the first limit that
    admits it; running counts over the few limits then give every search result.
    """
    last = max(0, -(-(cap - start) // step))
    first_limit = F.greatest(F.floor((F.col(cloud) - start) / step) + 1, F.lit(0))
    tagged = items.where(F.col(cloud).isNotNull()).withColumn("_k", first_limit).where(F.col("_k") <= last)
    steps = W.partitionBy(*keys).orderBy("_k")
    admitted = (
        tagged.groupBy(*keys, "_k")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_run", F.sum("_n").over(steps.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    chosen = admitted.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_run") >= least, F.col("_k"))), F.lit(last)).alias("_stop")
    )
    return (
        tagged.join(chosen, list(keys))
        .where(F.col("_k") <= F.col("_stop"))
        .withColumn("cloud_limit", (F.col("_stop") * step + start).cast("int"))
        .drop("_k", "_stop")
    )


def signed_degrees(direction: Column, degrees: Column) -> Column:
    value = degrees.cast("double")
    return F.when(direction.isin("S", "W"), -value).otherwise(value)


def parse_height_path(path: str) -> dict[str, Column]:
    """Year, latitude, longitude and type code from a height-tile path."""
    # fixed value: the file-name pattern
    pattern = r"canopy_height_(\d{4})_([NS])(\d+\.\d)_([EW])(\d+\.\d)(?:_code(\d+))?\.tif$"

    def part(i):
        return F.regexp_extract(path, pattern, i)

    return {
        "year": part(1).cast("int"),
        "lat": signed_degrees(part(2), part(3)),
        "lon": signed_degrees(part(4), part(5)),
        "code": F.nullif(part(6), F.lit("")).cast("int"),
    }


# File-name patterns of the products, the first group is the year.
PRODUCT_PATTERNS = {
    "mask": r"^canopy_height_(\d{4})_100m_.*_code\d+\.tif$",
    "height": r"canopy_height_(\d{4})_100m",
    "biomass": r"^TBD_S2_mean_(\d{4})_100m_merged\.tif",
    "mosaic": r"(?i)^S2_summer_mosaic_(\d{4})_.*_downsampled\.tif$",
    "other": r"_(\d{4})_",
}


def parse_product_path(path: str) -> dict[str, Column]:
    """Product, year, type code and base name (without extension and code) of a file; the first pattern that fits counts."""
    name = F.element_at(F.split(path, "/"), -1)
    product, year = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for kind, pattern in PRODUCT_PATTERNS.items():
        product = product.when(name.rlike(pattern), kind)
        year = year.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return {
        "product": product,
        "year": year.cast("int"),
        "code": F.nullif(F.regexp_extract(name, r"_code(\d+)\.tif$", 1), F.lit("")).cast("int"),
        "base_name": F.regexp_replace(stem, r"_code\d+$", ""),
    }


def parse_sample_key(key: str) -> dict[str, Column]:
    """TYPE_YEAR to its parts; a bare year belongs to total biomass."""
    bare = F.col(key).rlike(r"^\d+$")
    return {
        "biomass_type": F.when(bare, "TBD").otherwise(F.regexp_replace(key, r"_\d+$", "")),
        "year": F.element_at(F.split(key, "_"), -1).cast("int"),
    }


def with_all_years(places: DataFrame, observed: DataFrame, year: str = "yr") -> DataFrame:
    """Every place once per year that occurs in `observed` (years are a scalar array)."""
    years = observed.agg(F.array_sort(F.collect_set(year))).scalar()
    return places.withColumn("_years", years).withColumn(year, F.explode("_years")).drop("_years")


def missing_years(files: DataFrame, place: str, year: str = "yr") -> DataFrame:
    """Per place the years seen anywhere but not there (empty array when complete)."""
    years = files.agg(F.array_sort(F.collect_set(year))).scalar()
    have = files.groupBy(place).agg(F.collect_set(year).alias("_have")).withColumn("_all", years)
    return have.select(
        place,
        F.size("_all").alias("n_years"),
        F.size("_have").alias("n_present"),
        F.array_sort(F.array_except("_all", "_have")).alias("missing"),
    )


def completeness(missing: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    expected = F.sum("n_years")
    return missing.agg(
        n.alias("total_locations"),
        F.max("n_years").cast("bigint").alias("total_years"),
        expected.alias("total_expected"),
        F.sum("n_present").alias("total_existing"),
        F.sum(F.size("missing")).alias("total_missing"),
        (F.try_divide(F.sum("n_present"), expected) * 100.0).alias("completeness_rate"),
    )


def latest(files: DataFrame, kind: str, version: Sequence[str], path: str) -> DataFrame:
    return files.groupBy(kind).agg(F.max_by(path, F.struct(*version)).alias(path))
