"""Change of a cell layer between consecutive available years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.operators.masks import symmetric_change
from sylvagrid.operators.ranking import exact_percentiles_of
from sylvagrid.session import stage


def transition_pairs(cells: DataFrame, key: str = "cell", value: str = "tbd") -> DataFrame:
    """(key, year1, year2, b1, b2): cells valid in both of two consecutive years.

    Consecutive means neighbours in the list of years that occur at all, so a
    gap in one cell never pairs years that are not neighbours. The year list is a
    scalar; the cells are shuffled once by key, and a key has one row per year.
    """
    years = cells.agg(F.array_sort(F.collect_set("yr"))).scalar()
    following = F.get(years, F.array_position(years, F.col("yr")).cast("int"))
    by_time = W.partitionBy(key).orderBy("yr")
    return (
        cells.where(F.col(value).isNotNull())
        .select(
            key,
            F.col("yr").alias("year1"),
            following.alias("year2"),
            F.col(value).alias("b1"),
            F.lead("yr").over(by_time).alias("_yr"),
            F.lead(value).over(by_time).alias("b2"),
        )
        .where(F.col("_yr") == F.col("year2"))
        .drop("_yr")
    )


def change_columns(pairs: DataFrame) -> DataFrame:
    """Raw and symmetric relative change, negative stocks counted as 0."""
    a, b = F.greatest("b1", F.lit(0.0)), F.greatest("b2", F.lit(0.0))
    return pairs.withColumns({"raw_diff": b - a, "rel_diff": symmetric_change(a, b)})


def transition_statistics(pairs: DataFrame, carbon: float = 0.5, area_ha: float = 1.0) -> DataFrame:
    """The per-period statistics of change: moments, quartiles, carbon, classes.

    Moments and counts are one map-side combined aggregate; the order statistics
    come from the value-partitioned percentiles, since a period holds every cell.
    """
    raw = F.col("b2") - F.col("b1")
    d = pairs.select(
        "year1", "year2", "b1", "b2", raw.alias("raw"), symmetric_change(F.col("b1"), F.col("b2")).alias("rel")
    )
    d = stage(d, "pairs").withColumn("carbon", F.col("raw") * carbon * area_ha / 1e6)
    n = F.count(F.lit(1))
    lost = F.col("carbon") < 0

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("carbon"))), F.lit(0.0))

    def share(cond):
        return 100.0 * F.count_if(cond) / n

    def loss_share(cond):
        return F.coalesce(100.0 * F.try_divide(total(cond & lost), total(lost)), F.lit(0.0))

    gain, loss, stable = F.col("raw") > 1, F.col("raw") < -1, F.abs("raw") < 1
    to_zero = (F.col("b1") > 10) & (F.col("b2") < 10)
    from_zero = (F.col("b1") < 10) & (F.col("b2") > 10)
    aggs = {"n_valid_pixels": n}
    for col, name in (("raw", "raw_diff"), ("rel", "rel_diff")):
        aggs |= {
            f"mean_{name}": F.avg(col),
            f"std_{name}": F.stddev_pop(col),
            f"min_{name}": F.min(col),
            f"max_{name}": F.max(col),
        }
    aggs |= {
        "total_carbon_change_Mt": F.sum("carbon"),
        "total_gains_Mt": total(F.col("carbon") > 0),
        "total_losses_Mt": total(lost),
        "n_gain_pixels": F.count_if(gain),
        "n_loss_pixels": F.count_if(loss),
        "n_stable_pixels": F.count_if(stable),
        "pct_gain": share(gain),
        "pct_loss": share(loss),
        "pct_stable": share(stable),
        "mean_biomass_y1": F.avg("b1"),
        "mean_biomass_y2": F.avg("b2"),
        "std_biomass_y1": F.stddev_pop("b1"),
        "std_biomass_y2": F.stddev_pop("b2"),
        "transitions_to_zero": F.count_if(to_zero),
        "transitions_from_zero": F.count_if(from_zero),
        "high_loss_transitions": F.count_if(F.col("raw") < -50),
        "high_gain_transitions": F.count_if(F.col("raw") > 50),
        "pct_losses_to_zero": loss_share(to_zero),
        "pct_high_losses": loss_share(F.col("raw") < -50),
    }
    keys = ["year1", "year2"]
    moments = d.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])
    order = exact_percentiles_of(d, keys, ["raw", "rel", "b1", "b2"], {"q25": 0.25, "median": 0.5, "q75": 0.75}, staged=True)
    return moments.join(order, keys).select(
        *keys,
        F.concat_ws("-", *keys).alias("period"),
        *aggs,
        *[F.col(f"{q}_{c}").alias(f"{q}_{c}_diff") for c in ("raw", "rel") for q in ("median", "q25", "q75")],
        F.col("median_b1").alias("median_biomass_y1"),
        F.col("median_b2").alias("median_biomass_y2"),
    )


def start_end_change(stocks: DataFrame, keys: list[str], value: str, start: int, end: int) -> DataFrame:
    """Absolute and percent change between two years, one row per key present in both."""
    at = {
        y: F.max(F.when(F.col("yr") == y, F.col(value))).alias(name)
        for y, name in ((start, "start_value"), (end, "end_value"))
    }
    return (
        stocks.where(F.col("yr").isin(start, end))
        .groupBy(*keys)
        .agg(*at.values())
        .where("start_value IS NOT NULL AND end_value IS NOT NULL")
        .withColumn("change", F.col("end_value") - F.col("start_value"))
        .withColumn("pct_change", F.try_divide(F.col("change"), F.col("start_value")) * 100.0)
    )
