"""Bioclimatic variables of monthly cells, their anomalies, and the modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.operators.ranking import sample_exact
from sylvagrid.session import stage

# columns whose moments one aggregate takes: Spark compiles up to a hundred buffers, five a column
AT_ONCE = 16
# Seasons of the September-August year, and the variables kept for modelling.
SEASONS = [(9, 10, 11), (12, 1, 2), (3, 4, 5), (6, 7, 8)]
MODEL_VARIABLES = [
    "bio1", "bio4", "bio5", "bio6", "bio7", "bio10", "bio11",
    "bio12", "bio13", "bio14", "bio15", "bio16", "bio17",
]


def effective_year(year: str = "yr", month: str = "mo") -> Column:
    """September to August year, named by its September."""
    return F.col(year) - F.when(F.col(month) >= 9, 0).otherwise(1)


def hydro_years(monthly: DataFrame, least: int = 12) -> DataFrame:
    """Months present per cell and effective year, and whether the year is complete."""
    per = monthly.groupBy("cell", effective_year().alias("eff_year")).agg(F.count(F.lit(1)).alias("n_months"))
    return per.withColumn("complete", F.col("n_months") >= least)


def monthly_climatology(monthly: DataFrame, start: int, end: int) -> DataFrame:
    """Mean of each calendar month over effective years start .. end - 1."""
    period = monthly.where(effective_year().between(start, end - 1))
    return period.groupBy("cell", "mo").agg(F.avg("temp").alias("temp"), F.avg("precip").alias("precip"))


def bioclim(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 17 variables per key from its 12 monthly values, in one aggregation.

    Season variables compare the four fixed seasons; ties go to the earliest.
    Keys with fewer than 12 months are dropped.
    """
    season = {i: F.col("mo").isin(list(s)) for i, s in enumerate(SEASONS)}
    temps = F.array(*[F.avg(F.when(c, F.col("temp"))) for c in season.values()])
    rains = F.array(*[F.sum(F.when(c, F.col("precip"))) for c in season.values()])
    base = (
        months.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("temp").alias("bio1"),
            (F.stddev_pop("temp") * 100.0).alias("bio4"),
            F.max("temp").alias("bio5"),
            F.min("temp").alias("bio6"),
            F.sum("precip").alias("bio12"),
            F.max("precip").alias("bio13"),
            F.min("precip").alias("bio14"),
            F.avg("precip").alias("_pm"),
            F.stddev_pop("precip").alias("_ps"),
            temps.alias("_t"),
            rains.alias("_p"),
        )
        .where("_n >= 12")
    )

    def pick(values, by, extreme):
        at = F.array_position(by, extreme(by)).cast("int") - 1
        return F.get(F.col(values), at)

    t, p = F.col("_t"), F.col("_p")
    hot, cold, wet, dry = (t, F.array_max), (t, F.array_min), (p, F.array_max), (p, F.array_min)
    out = {
        "bio7": F.col("bio5") - F.col("bio6"),
        "bio8": pick("_t", *wet),
        "bio9": pick("_t", *dry),
        "bio10": pick("_t", *hot),
        "bio11": pick("_t", *cold),
        "bio15": F.when(F.col("_pm") > 0, F.try_divide(F.col("_ps"), F.col("_pm")) * 100.0).otherwise(F.lit(0.0)),
        "bio16": pick("_p", *wet),
        "bio17": pick("_p", *dry),
        "bio18": pick("_p", *hot),
        "bio19": pick("_p", *cold),
    }
    names = ["bio1", *[f"bio{i}" for i in range(4, 20)]]
    return base.withColumns(out).select(*keys, *names)


def yearly_bioclim(monthly: DataFrame) -> DataFrame:
    return bioclim(monthly.withColumn("eff_year", effective_year()), ["cell", "eff_year"])


def anomalies(yearly: DataFrame, reference: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Year value minus reference value per cell and variable."""
    ref = reference.select("cell", *[F.col(b).alias(f"_{b}") for b in variables])
    return yearly.join(ref, "cell").select(
        "cell", "eff_year", *[(F.col(b) - F.col(f"_{b}")).alias(b) for b in variables]
    )


def rolling_anomalies(yearly: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Trailing 2- and 3-year means, both only where three consecutive years exist."""
    by_year = W.partitionBy("cell").orderBy("eff_year")
    three = by_year.rangeBetween(-2, 0)
    two = by_year.rangeBetween(-1, 0)
    full = F.count(F.lit(1)).over(three) == 3
    cols = {"_full": full}
    for b in variables:
        cols[f"{b}_2yr"] = F.avg(b).over(two)
        cols[f"{b}_3yr"] = F.avg(b).over(three)
    return yearly.withColumns(cols).where("_full").drop("_full")


def modelling_table(
    change: DataFrame, lagged: DataFrame, features: Sequence[str], cap: int | None = None, seed: int = 42
) -> DataFrame:
    """Change of every cell and period beside the anomalies of its climate cell.

    With `cap`, at most so many rows per period, chosen by hash (a bound for fits);
    rows with any null are dropped.
    """
    change = change.where(F.col("biomass_rel_change").isNotNull())
    joined = change.join(
        lagged.select(F.col("cell").alias("climate_cell"), F.col("eff_year").alias("year_start"), *features),
        ["climate_cell", "year_start"],
    )
    if cap is not None:
        joined = sample_exact(joined, ["year_start"], ["cell"], cap, seed)
    return joined.na.drop()


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores by the sample standard deviation; constant columns are only centred.

    An aggregate takes `AT_ONCE` columns and is staged, so that Spark compiles each instead of merging them into one too
    large for that; a scan reads the columns it needs.
    """
    groups = [columns[i : i + AT_ONCE] for i in range(0, len(columns), AT_ONCE)]
    place = {c: f"_z{k}" for k, some in enumerate(groups) for c in some}
    stats = [F.struct(*[F.avg(c).alias(f"m_{c}") for c in some], *[F.stddev_samp(c).alias(f"s_{c}") for c in some]) for some in groups]
    if len(groups) > 1:
        found = {f"_z{k}": stage(df.agg(s.alias("_z")), "moments").scalar() for k, s in enumerate(stats)}
    else:
        found = {f"_z{k}": df.agg(s).scalar() for k, s in enumerate(stats)}

    def z(c):
        centred = F.col(c) - F.col(f"{place[c]}.m_{c}")
        return F.when(F.col(f"{place[c]}.s_{c}") > 0, centred / F.col(f"{place[c]}.s_{c}")).otherwise(centred)

    return df.withColumns(found).withColumns({c: z(c) for c in columns}).drop(*found)


def predictors(columns: Sequence[str], target: str, excluded: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """Column names that are neither the target, nor excluded, nor of an excluded variable."""
    return [
        c
        for c in columns
        if c != target and c not in excluded and not any(c == p or c.startswith(p + "_") for p in prefixes)
    ]
