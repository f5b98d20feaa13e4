"""Tables about fitted models: selection frequency, summaries, filters, splits, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.noise import uniform
from sylvagrid.operators.ranking import exact_percentiles, running_totals
from sylvagrid.session import stage


def feature_frequency(features: DataFrame, models: DataFrame) -> DataFrame:
    """How often every feature was selected, as count and share of the models.

    `features(run_id, feature)` has one row per selection.
    """
    total = models.agg(F.count(F.lit(1))).scalar()
    counts = features.groupBy("feature").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("frequency", F.try_divide(F.col("count"), total))


def top_features(frequency: DataFrame, n: int) -> DataFrame:
    return frequency.orderBy(F.desc("frequency"), "feature").limit(n)


def model_score() -> Column:
    """Test R2 where it exists, else validation R2."""
    return F.coalesce("test_r2", "val_r2")


def filter_models(models: DataFrame, least: float) -> DataFrame:
    return models.withColumn("r2", model_score()).where(F.col("r2") >= least)


def models_with(models: DataFrame, features: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Models that selected every wanted feature."""
    having = (
        features.where(F.col("feature").isin(list(wanted)))
        .groupBy("run_id")
        .agg(F.count_distinct("feature").alias("_n"))
        .where(F.col("_n") == len(wanted))
    )
    return models.join(having, "run_id", "left_semi")


def top_share(models: DataFrame, score: str, percent: float, least: int = 10) -> DataFrame:
    """The models at or above the score percentile, where there are more than `least`."""
    models = stage(models, "models")
    cut = exact_percentiles(models, [], score, {"q": 1.0 - percent / 100.0}).scalar()
    n = models.agg(F.count(F.lit(1))).scalar()
    return models.where((n <= least) | (F.col(score) >= cut))


def run_summary(models: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for c in ("val_r2", "test_r2"):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    share = F.count_if(model_score() >= threshold) / F.count(F.lit(1))
    return models.groupBy(*keys).agg(*aggs, share.alias("share_above"))


def shuffled_split(groups: DataFrame, group: str, seed: int, test: int, validation: int) -> DataFrame:
    """Assign whole groups to test, validation or train in hash order (groups are few)."""
    order = W.partitionBy(F.lit(0)).orderBy(uniform(seed, group), group)
    rank = F.row_number().over(order)
    part = F.when(rank <= test, "test").when(rank <= test + validation, "validation").otherwise("train")
    return groups.select(group).distinct().withColumn("part", part)


def fraction_split(items: DataFrame, ids: Sequence[str], seed: int, fractions: Sequence[tuple[str, float]]) -> DataFrame:
    """Assign items to parts in hash order by exact cumulative shares.

    The rank of an item is its part-wise running count, so items may be many.
    """
    tagged = items.select(*ids).distinct().withColumns({"_u": uniform(seed, *ids), "_one": F.lit(1)})
    ranked = running_totals(tagged, [], ["_u", *ids], ["_one"])
    place = (F.col("_one_run") - 1) / F.col("_one_all")
    part = F.lit(fractions[-1][0])
    upper = 1.0
    for name, share in reversed(fractions[:-1]):
        upper = round(sum(f for _, f in fractions[: [n for n, _ in fractions].index(name) + 1]), 12)
        part = F.when(place < upper, F.lit(name)).otherwise(part)
    return ranked.select(*ids, part.alias("part"))


def _local_fit(curve: DataFrame, keys: Sequence[str], x: str, y: str, frac: float, reach: int) -> DataFrame:
    """Add `_fit`: the locally weighted line at each point; `_n` points per curve, `_rw` their robust weights."""
    k = F.greatest(F.floor(F.lit(frac) * F.col("_n") + 1e-10), F.lit(2)).cast("int")
    frame = W.partitionBy(*keys).orderBy(x).rowsBetween(-reach, reach)
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("_rw").alias("w"))
    near = curve.withColumn("_near", F.collect_list(point).over(frame))
    gaps = F.array_sort(F.transform("_near", lambda p: F.abs(p["x"] - F.col(x))))
    near = near.withColumn("_h", F.get(gaps, k - 1))

    def weight(p):
        u = F.try_divide(F.abs(p["x"] - F.col(x)), F.col("_h"))
        core = 1.0 - u * u * u
        return F.when(u < 1.0, core * core * core * p["w"]).otherwise(F.lit(0.0))

    def total(value):
        return F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + weight(p) * value(p))

    near = near.withColumns(
        {
            "_w": total(lambda p: F.lit(1.0)),
            "_wx": total(lambda p: p["x"] - F.col(x)),
            "_wy": total(lambda p: p["y"]),
            "_wxx": total(lambda p: (p["x"] - F.col(x)) * (p["x"] - F.col(x))),
            "_wxy": total(lambda p: (p["x"] - F.col(x)) * p["y"]),
        }
    )
    # the fit is centred on the point itself, so its value there is the intercept
    det = F.col("_w") * F.col("_wxx") - F.col("_wx") * F.col("_wx")
    fitted = F.coalesce(
        F.try_divide(F.col("_wxx") * F.col("_wy") - F.col("_wx") * F.col("_wxy"), det),
        F.try_divide(F.col("_wy"), F.col("_w")),
    )
    return near.withColumn("_fit", fitted).drop("_near", "_h", "_w", "_wx", "_wy", "_wxx", "_wxy")


def lowess(curve: DataFrame, keys: Sequence[str], x: str, y: str, frac: float, passes: int = 3) -> DataFrame:
    """Locally weighted linear fit at every point of a curve, with robust reweighting passes.

    The k = frac * n nearest points of a sorted curve lie within k rows on either
    side, so a row frame replaces any pairing; its reach follows the longest curve,
    which is counted first. Tricube weights reach 0 at the k-th nearest distance.
    After each pass a point's weight falls with its residual over six median
    absolute residuals of the curve (bisquare).
    """
    curve = stage(curve.select(*keys, x, y), "curves")
    longest = curve.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    whole = W.partitionBy(*keys)
    out = curve.withColumns({"_n": F.count(F.lit(1)).over(whole), "_rw": F.lit(1.0)})
    for i in range(passes + 1):
        out = _local_fit(out, keys, x, y, frac, int(frac * longest) + 1)
        if i < passes:
            out = out.withColumn("_off", F.abs(F.col(y) - F.col("_fit")))
            u = F.try_divide(F.col("_off"), 6.0 * F.median("_off").over(whole))
            bisquare = F.when(u < 1.0, (1.0 - u * u) * (1.0 - u * u)).otherwise(F.lit(0.0))
            out = stage(out.withColumn("_rw", F.when(u.isNull(), F.lit(1.0)).otherwise(bisquare)).drop("_off", "_fit"), "curves")
    return out.select(*keys, x, y, F.col("_fit").alias("smooth"))
