"""Prediction accuracy, error tables and patch selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import metrics
from sylvagrid.plans.registry import query, uniform_sql

# Height ranges of the error table.
RANGES = [(0, 2), (2, 6), (6, 10), (10, 20), (20, 50)]

CLEAN_SQL = """k0 AS (SELECT *, p - target AS residual FROM (SELECT *, CASE WHEN pred < 0 THEN 0 ELSE pred END AS p FROM fx_pred) q
      WHERE p <= 60 AND target <= 60),
    kq AS (SELECT quantile_cont(residual, 0.99) AS q FROM k0),
    kc AS (SELECT l_orderkey, l_linenumber, l_partkey, target, p AS pred, residual FROM k0, kq WHERE residual <= q)"""


@query(
    "regression_metrics",
    f"""WITH {CLEAN_SQL} SELECT round(avg(abs(residual)), 8) AS mae, round(avg(residual), 8) AS bias, round(sqrt(avg(residual * residual)), 8) AS rmse,
    round(corr(target, pred), 8) AS r_pearson, round(1 - sum(residual * residual) / (count(*) * var_pop(target)), 8) AS r2, count(*) AS n_samples,
    round(sqrt(avg(residual * residual)) / avg(target) * 1e2, 8) AS rel_rmse FROM kc""",
)
def regression_metrics(v):
    out = metrics.regression_metrics(metrics.cleaned(v.pred))
    return out.withColumns({c: rnd(c, 8) for c in out.columns if c != "n_samples"})


REPLICATES = 1000
P = metrics.PRIME
WEIGHT_CASE = "CASE " + " ".join(f"WHEN z < {s!r}e0 THEN {k}" for k, s in enumerate(metrics.POISSON_STEPS)) + f" ELSE {len(metrics.POISSON_STEPS)} END"
ROW_KEY = "CAST(42 AS BIGINT)"
for i in ("l_orderkey", "l_linenumber", "l_partkey"):
    ROW_KEY = f"(({ROW_KEY} * 1000003 + {i} % {P}) % {P})"
MIXED = f"((k * 48271 + b * 69621) % {P})"


@query(
    "bootstrap_ci",
    f"""WITH {CLEAN_SQL}, h AS (SELECT residual, target, {ROW_KEY} AS k FROM kc),
    x0 AS (SELECT residual, target, k, b, {MIXED} AS x FROM h, (SELECT CAST(unnest(range({REPLICATES})) AS BIGINT) AS b) q),
    x1 AS (SELECT residual, target, k, b, (x * x + k + b * 7919) % {P} AS x FROM x0),
    x2 AS (SELECT residual, target, b, ((x * x + k * 2 + b * 7919) % {P} + 5e-1) / {P}e0 AS z FROM x1),
    w AS (SELECT residual, target, b, {WEIGHT_CASE} AS w FROM x2),
    s AS (SELECT b, sum(w) AS n, sum(w * abs(residual)) AS a, sum(w * residual * residual) AS s, sum(w * target) AS t, sum(w * target * target) AS tt FROM w GROUP BY b),
    l AS (SELECT 'mae' AS metric, a / n AS value FROM s UNION ALL SELECT 'rmse', sqrt(s / n) FROM s UNION ALL SELECT 'r2', 1 - s / (tt - t * t / n) FROM s)
    SELECT metric, round(quantile_cont(value, 0.025), 7) AS lower, round(quantile_cont(value, 0.975), 7) AS upper FROM l GROUP BY metric""",
)
def bootstrap_ci(v):
    rows = metrics.cleaned(v.pred)
    out = metrics.bootstrap_intervals(rows, ["l_orderkey", "l_linenumber", "l_partkey"], REPLICATES)
    return out.withColumns({c: rnd(c, 7) for c in ("lower", "upper")})


@query(
    "metrics_by_range",
    """WITH t AS (SELECT * FROM (VALUES (0, 'h_0_2', 0, 2), (1, 'h_2_6', 2, 6), (2, 'h_6_10', 6, 10), (3, 'h_10_20', 10, 20), (4, 'h_20_50', 20, 50)) x(range, range_name, lo, hi)),
    p AS (SELECT target + 6e0 AS target, pred + 6e0 AS pred FROM fx_pred)
    SELECT range, range_name, round(COALESCE(avg(abs(pred - target)), 0), 8) AS mae, round(COALESCE(stddev_samp(abs(pred - target)), 0), 8) AS std,
    round(COALESCE(avg(pred - target), 0), 8) AS signed_mean, round(COALESCE(stddev_samp(pred - target), 0), 8) AS signed_std, count(target) AS n
    FROM t LEFT JOIN p ON target >= lo AND target < hi GROUP BY range, range_name""",
)
def metrics_by_range(v):
    # raised by 6 m, so that the two lowest ranges are empty
    rows = v.pred.select((F.col("target") + 6.0).alias("target"), (F.col("pred") + 6.0).alias("pred"))
    out = metrics.by_range(rows, RANGES)
    return out.withColumns({c: rnd(c, 8) for c in ("mae", "std", "signed_mean", "signed_std")})


@query(
    "histogram_2d",
    """SELECT CAST(floor(target / 25e-1) AS INT) AS target_bin, CAST(floor(pred / 25e-1) AS INT) AS pred_bin, count(*) AS n FROM fx_pred GROUP BY 1, 2""",
)
def histogram_2d(v):
    return metrics.histogram_2d(v.pred, "target", "pred", 2.5)


@query(
    "histogram_pct",
    """SELECT bin, n, round(pct, 8) AS pct FROM (SELECT bin, n, 1e2 * n / sum(n) OVER () AS pct FROM (SELECT CAST(CASE WHEN b = 380 THEN 37 ELSE floor(b / 1e1) END AS INT) AS bin,
    count(*) AS n FROM (SELECT target * 6e0 AS b FROM fx_pred) q GROUP BY 1) p) o WHERE bin BETWEEN 0 AND 37""",
)
def histogram_pct(v):
    rows = v.pred.select((F.col("target") * 6.0).alias("tbd"))
    return metrics.histogram_pct(rows, "tbd", 10.0, 380.0).withColumn("pct", rnd("pct", 8))


@query(
    "residual_by_bin",
    """SELECT bin, (bin + 5e-1) * 40 AS midpoint, count(*) AS n, round(quantile_cont(res, 0.25), 7) AS q25, round(median(res), 7) AS median, round(quantile_cont(res, 0.75), 7) AS q75
    FROM (SELECT CAST(floor(target * 6e0 / 4e1) AS INT) AS bin, (pred - target) * 6e0 AS res FROM fx_pred) q WHERE bin BETWEEN 0 AND 8 GROUP BY bin HAVING count(*) >= 3""",
)
def residual_by_bin(v):
    rows = v.pred.select(
        (F.col("target") * 6.0).alias("tbd"), ((F.col("pred") - F.col("target")) * 6.0).alias("residual")
    )
    out = metrics.residual_boxes(rows, "tbd", "residual", 40.0, 9)
    return out.withColumns({c: rnd(c, 7) for c in ("q25", "median", "q75")})


@query(
    "frequency_weighted_l1",
    """WITH f AS (SELECT CASE WHEN target < 60 THEN CAST(floor(target) AS INT) ELSE 60 END AS b, count(*) AS n, sum(abs(ln(1 + greatest(pred, 0)) - ln(1 + target))) AS e FROM fx_pred GROUP BY 1)
    SELECT round(sum(e / (pow(n / CAST((SELECT sum(n) FROM f) AS DOUBLE), 5e-1) + 1e-6)) / sum(n), 7) AS weighted_l1, round(sum(e) / sum(n), 8) AS l1,
    CAST(sum(n) AS BIGINT) AS n FROM f""",
)
def frequency_weighted_l1(v):
    """One-metre ranges up to 60 m and one above; errors in log1p space."""
    ranges = [(float(i), float(i + 1)) for i in range(60)] + [(60.0, None)]
    error = F.log1p(F.greatest("pred", F.lit(0.0))) - F.log1p("target")
    rows = v.pred.select("target", error.alias("error"))
    out = metrics.frequency_weighted_l1(rows, "target", "error", ranges)
    return out.withColumns({"weighted_l1": rnd("weighted_l1", 7), "l1": rnd("l1", 8)})


@query(
    "linear_trend",
    """SELECT l_linenumber, round(regr_slope(pred - target, target), 9) AS slope, round(regr_intercept(pred - target, target), 8) AS intercept, count(*) AS n
    FROM fx_pred GROUP BY l_linenumber""",
)
def linear_trend(v):
    rows = v.pred.withColumn("residual", F.col("pred") - F.col("target"))
    out = metrics.linear_trend(rows, ["l_linenumber"], "target", "residual")
    return out.withColumns({"slope": rnd("slope", 9), "intercept": rnd("intercept", 8)})


@query(
    "binned_mean_grid",
    """WITH g AS (SELECT l_quantity - 255e-1 AS f1, l_extendedprice / 2e3 - 25 AS f2, l_discount * 1e2 AS val FROM lineitem),
    h AS (SELECT greatest(quantile_cont(abs(f1), 0.98), quantile_cont(abs(f2), 0.98)) AS h FROM g),
    b AS (SELECT CAST(floor((f1 + h) / (2e0 * h / 60)) AS INT) AS x_bin, CAST(floor((f2 + h) / (2e0 * h / 60)) AS INT) AS y_bin, val, h FROM g, h)
    SELECT x_bin, y_bin, count(*) AS n, round(avg(val), 7) AS mean, round(max(h), 7) AS half_width FROM b
    WHERE x_bin BETWEEN 0 AND 59 AND y_bin BETWEEN 0 AND 59 GROUP BY x_bin, y_bin HAVING count(*) > 5""",
)
def binned_mean_grid(v):
    rows = v.t("lineitem").select(
        (F.col("l_quantity") - 25.5).alias("f1"),
        (F.col("l_extendedprice") / 2e3 - 25.0).alias("f2"),
        (F.col("l_discount") * 1e2).alias("val"),
    )
    out = metrics.mean_grid(rows, "f1", "f2", "val")
    return out.withColumns({"mean": rnd("mean", 7), "half_width": rnd("half_width", 7)})


# --- patches -----------------------------------------------------------------

EDGES = [0, 1, 2, 4, 8, 12, 16, 20, 25]
SHARES_SQL = ", ".join(
    f"1e2 * count(CASE WHEN height >= {lo} {f'AND height < {hi}' if hi else ''} THEN 1 END) / count(*) AS pct_{lo}_{hi or 'up'}"
    for lo, hi in zip(EDGES, [*EDGES[1:], None])
)
SHARE_NAMES = [f"pct_{lo}_{hi or 'up'}" for lo, hi in zip(EDGES, [*EDGES[1:], None])]
PATCH_SQL = f"""ps AS (SELECT yr, CAST(floor(r / 8e0) AS INT) AS pr, CAST(floor(c / 8e0) AS INT) AS pc, count(*) AS n_valid, min(height) AS min_height, max(height) AS max_height,
      avg(height) AS mean_height, median(height) AS median_height, stddev_samp(height) AS std_height,
      cbrt(stddev_samp(height) * (max(height) - min(height)) * (quantile_cont(height, 0.75) - quantile_cont(height, 0.25) + 1e-6)) AS diversity,
      count(*) / 64e0 AS valid_ratio, count(CASE WHEN height BETWEEN 0 AND 15e-1 THEN 1 END) / CAST(count(*) AS DOUBLE) AS low_ratio, {SHARES_SQL}
      FROM (SELECT r, c, yr, greatest(height - 24, 0) AS height FROM fx_cells) q GROUP BY yr, 2, 3)"""
PATCH_DOUBLES = ["min_height", "max_height", "mean_height", "median_height", "std_height", "diversity", "valid_ratio", "low_ratio", *SHARE_NAMES]


def patches_of(v):
    cells = v.cells.select("r", "c", "yr", F.greatest(F.col("height") - 24.0, F.lit(0.0)).alias("height"))
    return metrics.patch_statistics(cells, ["yr"], "height", 8)


@query(
    "patch_diversity",
    f"WITH {PATCH_SQL} SELECT yr, pr, pc, n_valid, {', '.join(f'round({c}, 6) AS {c}' for c in PATCH_DOUBLES)} FROM ps",
)
def patch_diversity(v):
    return patches_of(v).withColumns({c: rnd(c, 6) for c in PATCH_DOUBLES})


BATCH, ATTEMPTS = 12, 200


@query(
    "diverse_patches",
    f"""WITH RECURSIVE {PATCH_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY {uniform_sql(5, "yr, pr, pc")}, pr, pc) - 1 AS place FROM ps),
    g AS (SELECT yr, pr, pc, diversity, valid_ratio, low_ratio, place // {ATTEMPTS} AS batch, place % {ATTEMPTS} AS attempt FROM t),
    h AS (SELECT *, attempt / CAST(count(*) OVER (PARTITION BY yr, batch) AS DOUBLE) AS p FROM g),
    f AS (SELECT *, p > 0.9 OR (valid_ratio >= 1 - 3e-1 * CASE WHEN p > 0.75 THEN 3e0 WHEN p > 0.5 THEN 15e-1 ELSE 1e0 END
      AND low_ratio <= 7e-1 * CASE WHEN p > 0.75 THEN 3e0 WHEN p > 0.5 THEN 15e-1 ELSE 1e0 END) AS fits FROM h),
    st AS (SELECT yr, batch, CAST(-1 AS BIGINT) AS attempt, 0 AS chosen, false AS passed FROM f GROUP BY yr, batch
      UNION ALL SELECT yr, batch, attempt, chosen + CAST(passed AS INT), passed FROM (SELECT st.yr, st.batch, f.attempt, st.chosen,
        st.chosen < {BATCH} AND coalesce(f.fits AND f.diversity >= CASE WHEN p > 0.9 THEN 3e0 WHEN p > 0.75 AND st.chosen <= {BATCH} * 0.75 THEN 3e0
          WHEN p > 0.5 AND st.chosen <= {BATCH} * 0.5 THEN 65e-1 WHEN p > 0.25 AND st.chosen <= {BATCH} * 0.25 THEN 825e-2 ELSE 1e1 END, false) AS passed
        FROM st JOIN f ON f.yr = st.yr AND f.batch = st.batch AND f.attempt = st.attempt + 1) q),
    j AS (SELECT f.yr, f.batch, f.attempt, pr, pc, diversity, passed, chosen - CAST(passed AS INT) < {BATCH} AS tried
      FROM f JOIN st ON st.yr = f.yr AND st.batch = f.batch AND st.attempt = f.attempt)
    SELECT yr, CAST(batch AS INT) AS batch, CAST(attempt AS INT) AS attempt, pr, pc, passed, round(diversity, 6) AS diversity, CAST(pick AS INT) AS pick FROM
    (SELECT *, row_number() OVER (PARTITION BY yr, batch ORDER BY passed DESC, tried DESC, attempt) AS pick FROM j) q WHERE pick <= {BATCH}""",
)
def diverse_patches(v):
    return metrics.diverse_patches(patches_of(v), ["yr"], BATCH, ATTEMPTS, seed=5).withColumn("diversity", rnd("diversity", 6))
