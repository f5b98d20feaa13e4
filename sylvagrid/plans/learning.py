"""Clusters, model search and interpretation on the climate modelling table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import attribution, boosting, climate, clusters, models, variogram
from sylvagrid.plans.climate import LAGGED, ML_SQL, modelling_rows, rounded_sql
from sylvagrid.plans.registry import query
from sylvagrid.plans.space import curve_of
from sylvagrid.session import stage

TARGET = "biomass_rel_change"
# all predictors and the sizes of the original method
FEATURES = LAGGED
SEEDS = [42, 123, 456, 789, 999, 111, 222, 333, 444, 555]
LEAST_R2, BLOCKS = 0.2, 15
PAIR = ("bio12", "bio12_3yr")


def table_of(v):
    """Standardised modelling rows, all of them, with a row id."""
    rows = modelling_rows(v, FEATURES)
    ident = F.concat_ws("_", "cell", "year_start")
    rows = stage(rows.select(ident.alias("row_id"), "x", "y", TARGET, *FEATURES), "ml", spread_rows=True)
    return climate.standardize(rows, [TARGET, *FEATURES])


# staged results of a search, by application and tables: five queries start from the same one
_SEARCHED: dict[tuple[str, str], tuple] = {}


def searched(v):
    """Rows, results and node table of the search; searched once per session and set of tables."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _SEARCHED:
        rows = stage(clusters.k_means(table_of(v), BLOCKS), "ml")
        _SEARCHED[key] = (rows, *boosting.search(rows, FEATURES, "cluster_id", TARGET, SEEDS))
    return _SEARCHED[key]


def filtered(results, least=LEAST_R2):
    """The models at or above an accuracy; where none is, the best one."""
    scored = results.withColumn("r2", models.model_score())
    best = scored.agg(F.max("r2")).scalar()
    return scored.where((F.col("r2") >= least) | ((best < least) & (F.col("r2") == best)))


def explained(v):
    """Rows, results and models that interpretation uses."""
    rows, results, nodes = searched(v)
    passed = filtered(results)
    return rows, passed, attribution.forests(passed, nodes)


@query("spatial_clusters")
def spatial_clusters(v):
    """Clusters of the grid at the knee of the cost, and whether they lie further apart than the autocorrelation range."""
    points = stage(v.grid.select("cell", "x", "y"), "points", spread_rows=True)
    k = clusters.cluster_count(points, 2, BLOCKS)
    extent = stage(variogram.cluster_extent(clusters.k_means(points, k), "cluster_id"), "clusters")
    reach = variogram.autocorrelation_range(curve_of(v), ["yr"]).agg(F.max("range")).scalar()
    out = extent.join(variogram.cluster_separation(extent, "cluster_id"), "cluster_id")
    return out.withColumns({"range": reach, "well_separated": F.min("nearest").over(W.partitionBy(F.lit(0))) > reach})


@query(
    "nearest_centre",
    """WITH pc AS (SELECT poly_id, (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy FROM fx_polygons),
    nd AS (SELECT cell, poly_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d FROM fx_grid, pc),
    ne AS (SELECT cell, poly_id, d, row_number() OVER (PARTITION BY cell ORDER BY d, poly_id) AS o FROM nd)
    SELECT poly_id, count(*) AS n, round(avg(sqrt(d)), 6) AS mean_distance, round(max(sqrt(d)), 6) AS max_distance FROM ne WHERE o = 1 GROUP BY poly_id""",
)
def nearest_centre(v):
    """Every cell with the polygon whose centre is nearest: the assignment step of the clusters."""
    centre = [((F.col(f"{c}_min") + F.col(f"{c}_max")) / 2).alias(c) for c in "xy"]
    found = clusters.assign_nearest(v.grid.select("cell", "x", "y"), v.polygons.select("poly_id", *centre), "poly_id")
    far = [F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance")]
    out = found.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), *far)
    return out.withColumns({c: rnd(c, 6) for c in ("mean_distance", "max_distance")})


SPLIT_SQL = f"""{ML_SQL}, cs AS (SELECT cell, climate_cell, biomass_rel_change AS y, {rounded_sql(LAGGED)} FROM ml),
    ve AS (SELECT climate_cell % {BLOCKS} AS block, {", ".join(LAGGED)}, count(*) AS n, sum(y) AS sum_y FROM cs GROUP BY ALL),
    lo AS (SELECT n, sum_y, unnest([{", ".join(f"'{f}'" for f in LAGGED)}]) AS feature, unnest([{", ".join(LAGGED)}]) AS x FROM ve),
    cu AS (SELECT feature, quantile_cont(x, [{", ".join(f"{k}e0 / {boosting.BINS}" for k in range(1, boosting.BINS))}]) AS cuts FROM lo GROUP BY feature),
    bi AS (SELECT feature, n, sum_y, cuts, (SELECT count(*) FROM (SELECT unnest(cuts) AS c) q WHERE c < x) AS bin FROM lo JOIN cu USING (feature)),
    hi AS (SELECT feature, CAST(bin AS INT) AS bin, cuts[bin + 1] AS threshold, sum(n) AS n, sum(sum_y) AS sum_y FROM bi GROUP BY ALL),
    ac AS (SELECT feature, bin, threshold, sum(n) OVER u AS n_left, sum(n) OVER f AS n_all,
      sum(sum_y) OVER u - sum(n) OVER u * sum(sum_y) OVER f / sum(n) OVER f AS g
      FROM hi WINDOW f AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY bin))"""


@query(
    "split_gains",
    f"""WITH {SPLIT_SQL} SELECT feature, bin, CAST(n_left AS BIGINT) AS n_left, CAST(n_all - n_left AS BIGINT) AS n_right,
    round(power(greatest(abs(g) - 1e-1, 0), 2) / (n_left + 5e-1) + power(greatest(abs(g) - 1e-1, 0), 2) / (n_all - n_left + 5e-1), 4) AS gain
    FROM ac WHERE threshold IS NOT NULL AND n_left >= 10 AND n_all - n_left >= 10""",
)
def split_gains(v):
    """Gains of all splits of the first node of a tree, over all rows and predictors."""
    rows = modelling_rows(v, FEATURES, digits=7).withColumn("block", F.col("climate_cell") % BLOCKS)
    vectors = boosting.feature_vectors(rows, FEATURES, "block", TARGET)
    histogram = boosting.level_histogram(vectors, FEATURES, boosting.cut_points(vectors, FEATURES))
    out = boosting.split_gains(histogram, alpha=0.1, lam=0.5, least=10)
    return out.select("feature", "bin", "n_left", "n_right", rnd("gain", 4))


@query("model_search")
def model_search(v):
    return searched(v)[1]


@query("permutation_importance")
def permutation_importance(v):
    rows, _, found = explained(v)
    return attribution.permutation_importance(found, rows, TARGET, "row_id", repeats=10)


@query("shapley_importance")
def shapley_importance(v):
    rows, _, found = explained(v)
    return attribution.shapley_importance(found, rows, "row_id", size=1000, background=100)


@query("partial_dependence")
def partial_dependence(v):
    """Attribution curves of the predictors most often chosen, smoothed over the points of all models."""
    rows, passed, found = explained(v)
    chosen = passed.select("run_id", F.explode("features").alias("feature"))
    top = [r["feature"] for r in models.top_features(models.feature_frequency(chosen, passed), 6).collect()]
    points = stage(attribution.attribution_curves(found, rows, top, "row_id", points=100, size=3000, background=1000), "curves")
    smooth = models.lowess(points, ["feature"], "x", "effect", 0.3)
    return smooth.groupBy("feature", "x").agg(F.avg("effect").alias("effect"), F.avg("smooth").alias("smooth"))


@query("feature_interaction")
def feature_interaction(v):
    """Interaction of two predictors per sampled row and model: the configured pair, or the pair chosen together most often."""
    rows, _, found = explained(v)
    pair = attribution.top_pair(found, PAIR)
    if pair is None:
        raise ValueError("no model uses two predictors")
    values = attribution.interaction_values(found, rows, *pair, "row_id", size=1000, background=200)
    return values.select(F.lit(pair[0]).alias("feature_1"), F.lit(pair[1]).alias("feature_2"), "*")
