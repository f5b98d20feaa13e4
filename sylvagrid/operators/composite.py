"""Scene stacks: masks, best scenes, composites, mosaics, gap filling, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.noise import uniform


def scene_validity(pixels: DataFrame, scene: Sequence[str], valid: Column) -> DataFrame:
    """Percent of a scene's pixels that are valid."""
    return pixels.groupBy(*scene).agg((100.0 * F.count_if(valid) / F.count(F.lit(1))).alias("validity"))


def best_scenes(validity: DataFrame, keys: Sequence[str], time: str, n: int) -> DataFrame:
    """The n most valid scenes per key, earlier first on ties, with the days they span.

    Ranks scenes, not pixels: a key holds at most the scenes of its period.
    """
    order = W.partitionBy(*keys).orderBy(F.desc("validity"), F.asc(time))
    chosen = validity.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    whole = W.partitionBy(*keys)
    return chosen.withColumn("span_days", F.datediff(F.max(time).over(whole), F.min(time).over(whole)))


def median_composite(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Median over time per pixel and band, nulls skipped.

    Feed it scenes already limited by `best_scenes`: a pixel then holds at most n
    values and the built-in median keeps a bounded state.
    """
    return pixels.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def robustness(
    pixels: DataFrame, place: Sequence[str], scene: str, pixel: str, value: str, sizes: Sequence[int], repeats: int, seed: int
) -> DataFrame:
    """Difference between medians of random scene subsets and the median of all scenes.

    Scenes are ranked once per repeat by a hash, and the subset of size n is the
    first n ranks, so larger subsets contain smaller ones. A pixel holds at most
    one value per scene of its place and period.
    """
    scenes = pixels.select(*place, scene).distinct()
    ranked = scenes.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "_u", uniform(seed, "repeat", *place, scene)
    )
    rank = F.row_number().over(W.partitionBy(*place, "repeat").orderBy("_u", scene))
    ranked = ranked.withColumn("_rank", rank).where(F.col("_rank") <= max(sizes))
    member = ranked.withColumn("n_scenes", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("_rank <= n_scenes")
    whole = pixels.groupBy(*place, pixel).agg(F.median(value).alias("_all"))
    targets = whole.groupBy(*place).agg(F.count(F.lit(1)).alias("_pixels"))
    subset = (
        pixels.join(member.select(*place, scene, "repeat", "n_scenes"), [*place, scene])
        .groupBy(*place, "n_scenes", "repeat", pixel)
        .agg(F.median(value).alias("_part"))
    )
    per_repeat = (
        subset.join(whole, [*place, pixel])
        .groupBy(*place, "n_scenes", "repeat")
        .agg(F.avg(F.abs(F.col("_part") - F.col("_all"))).alias("_diff"), F.count("_part").alias("_valid"))
        .join(targets, list(place))
        .withColumn("_share", F.col("_valid") / F.col("_pixels"))
    )
    return per_repeat.groupBy(*place, "n_scenes").agg(
        F.avg("_diff").alias("mean_difference"),
        F.stddev_pop("_diff").alias("std_difference"),
        F.avg("_share").alias("mean_valid_pixels"),
        F.stddev_pop("_share").alias("std_valid_pixels"),
    )


def block_average(cells: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Average of k x k cell blocks, nulls skipped."""
    block = [F.floor(F.col(i) / k).cast("int").alias(i) for i in ("r", "c")]
    return cells.groupBy(*keys, *block).agg(F.avg(value).alias(value), F.count(value).alias("n_valid"))


def merge_first(layers: DataFrame, keys: Sequence[str], value: str, priority: Sequence[str]) -> DataFrame:
    """First valid value per cell in priority order, by a map-side combined min_by."""
    valid = layers.where(F.col(value).isNotNull())
    return valid.groupBy(*keys).agg(F.min_by(value, F.struct(*priority)).alias(value))


def merge_mean(layers: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Overlapping values averaged."""
    return layers.groupBy(*keys).agg((F.sum(value) / F.count(value)).alias(value), F.count(value).alias("n_layers"))


def gap_fill(cells: DataFrame, key: str, value: str, is_nodata: str) -> DataFrame:
    """Fill removed values from the neighbouring years of the same cell.

    First year takes the next, last the previous, others the mean of both, and
    only originally valid neighbours count. Cells with nodata in any year stay as
    they are. A year without a row for the cell is a gap. `source` is 0 original,
    1 nodata, 2 filled, 3 still missing. One shuffle by cell; a cell is an array
    with one slot per year.
    """
    years = cells.agg(F.array_sort(F.collect_set("yr"))).scalar()
    slot = F.struct(F.col(value).alias("v"), F.col(is_nodata).alias("nd"))
    stacked = (
        cells.groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("yr", slot))).alias("_m"), F.max(is_nodata).alias("_any_nd"))
        .withColumn("_years", years)
        .withColumn("_n", F.size("_years"))
        .select(key, "_m", "_any_nd", "_years", "_n", F.posexplode("_years").alias("_i", "yr"))
    )

    def at(offset):
        return F.try_element_at("_m", F.get("_years", F.col("_i") + offset))

    before, here, after = at(-1)["v"], at(0), at(1)["v"]
    filled = (
        F.when(F.col("_any_nd"), F.lit(None).cast("double"))
        .when(F.col("_n") == 1, F.lit(None).cast("double"))
        .when(F.col("_i") == 0, after)
        .when(F.col("_i") == F.col("_n") - 1, before)
        .otherwise((before + after) / 2.0)
    )
    nodata = F.coalesce(here["nd"], F.lit(False))
    source = (
        F.when(nodata, 1).when(here["v"].isNotNull(), 0).when(filled.isNotNull(), 2).otherwise(3)
    )
    return stacked.select(key, "yr", F.coalesce(here["v"], F.when(~nodata, filled)).alias(value), source.alias("source"))


def coverage(cells: DataFrame, targets: DataFrame, valid: Column, k: int) -> DataFrame:
    """Target cells (k x k blocks of `targets`) with whether any layer covers them."""
    block = [F.floor(F.col(i) / k).cast("int").alias(f"t{i}") for i in ("r", "c")]
    hits = cells.groupBy(*block).agg(F.bool_or(valid).alias("covered"))
    wanted = targets.select(*block).distinct()
    return wanted.join(hits, ["tr", "tc"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def combined_bounds(layers: DataFrame, half: float, resolution: float) -> DataFrame:
    """Bounds of all layers together and the grid size at the target resolution."""
    b = layers.agg(
        (F.min("x") - half).alias("x_left"),
        (F.min("y") - half).alias("y_bottom"),
        (F.max("x") + half).alias("x_right"),
        (F.max("y") + half).alias("y_top"),
    )
    return b.withColumns(
        {
            "width": F.ceil((F.col("x_right") - F.col("x_left")) / resolution),
            "height": F.ceil((F.col("y_top") - F.col("y_bottom")) / resolution),
        }
    )
