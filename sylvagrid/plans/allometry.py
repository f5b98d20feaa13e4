"""Fitting: outlier trimming, quantile regression, fit quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import allometry, inventory
from sylvagrid.plans.inventory import PARAM_SQL, tier_parameters, tiered_rows
from sylvagrid.plans.registry import query
from sylvagrid.session import stage

# log height and a log biomass that grows with it, of every cell and year, with its type
LOG_SQL = """lo AS (SELECT k.cell, yr, type_code, ln(height) AS lh, 12e-1 * ln(height) + ln(3e-1 + tbd / 1e3) AS lb FROM fx_cells k JOIN fx_grid g ON g.cell = k.cell)"""


def log_rows(v):
    cells = v.cells.join(v.grid.select("cell", "type_code"), "cell")
    lb = F.lit(1.2) * F.ln("height") + F.ln(F.lit(0.3) + F.col("tbd") / 1e3)
    return cells.select("cell", "yr", "type_code", F.ln("height").alias("lh"), lb.alias("lb"))


def distance_sql(name, used):
    return f"""{name} AS (SELECT lo.*, COALESCE((vy * (lh - mx) * (lh - mx) - 2e0 * vxy * (lh - mx) * (lb - my) + vx * (lb - my) * (lb - my)) / NULLIF(vx * vy - vxy * vxy, 0), 0) AS d2
    FROM lo JOIN (SELECT type_code, avg(lh) AS mx, avg(lb) AS my, var_pop(lh) AS vx, var_pop(lb) AS vy, covar_pop(lh, lb) AS vxy FROM {used} GROUP BY type_code) f USING (type_code))"""


def near_sql(name, source, p, factor="1e0"):
    return f"""{name} AS (SELECT s.* FROM {source} s JOIN (SELECT type_code, quantile_cont(d2, {p}) AS q FROM {source} GROUP BY type_code) c USING (type_code) WHERE d2 <= q * {factor})"""


TRIM_SQL = ", ".join(
    [
        LOG_SQL,
        distance_sql("d0", "lo"),
        *[part for i in range(3) for part in (near_sql(f"n{i}", f"d{i}", 0.5), distance_sql(f"d{i + 1}", f"n{i}"))],
        near_sql("n3", "d3", 0.5, repr(allometry.CHI2_975 / allometry.CHI2_HALF)),
        distance_sql("d4", "n3"),
        near_sql("kept", "d4", 0.88),
    ]
)


@query(
    "mahalanobis_trim",
    f"""WITH {TRIM_SQL} SELECT type_code, count(*) AS n_kept, CAST(sum(cell) AS BIGINT) AS cell_sum, round(avg(lh), 8) AS mean_lh, round(avg(lb), 8) AS mean_lb,
    round(covar_pop(lh, lb), 8) AS cov FROM kept GROUP BY type_code""",
)
def mahalanobis_trim(v):
    kept = allometry.trim_outliers(log_rows(v), ["type_code"], "lh", "lb")
    return kept.groupBy("type_code").agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.sum("cell").alias("cell_sum"),
        rnd(F.avg("lh"), 8, "mean_lh"),
        rnd(F.avg("lb"), 8, "mean_lb"),
        rnd(F.covar_pop("lh", "lb"), 8, "cov"),
    )


def tier_rows(v):
    types = v.types.select(F.col("code").alias("type_code"), "clade", "family", "genus", F.col("name").alias("forest_type"))
    rows = log_rows(v).join(types, "type_code")
    return inventory.stack_tiers(rows, ["clade", "family", "genus", "forest_type"]).select("tier", "tier_name", "lh", "lb")


def pass_sql(i, candidates):
    """One search level: residual quantiles, losses and the best slope of every group and quantile."""
    return f"""r{i} AS (SELECT tier, tier_name, q, slope, lb - slope * lh AS r FROM al JOIN {candidates} c USING (tier, tier_name)),
    i{i} AS (SELECT tier, tier_name, q, slope, CASE q WHEN 15e-2 THEN quantile_disc(r, 0.15) WHEN 5e-1 THEN quantile_disc(r, 0.5) ELSE quantile_disc(r, 0.85) END AS a FROM r{i} GROUP BY tier, tier_name, q, slope),
    l{i} AS (SELECT tier, tier_name, q, slope, a, avg(greatest(q * (r - a), (q - 1) * (r - a))) + 5e-2 * abs(slope) AS loss FROM r{i} JOIN i{i} USING (tier, tier_name, q, slope) GROUP BY tier, tier_name, q, slope, a),
    b{i} AS (SELECT tier, tier_name, q, slope, a, loss FROM (SELECT *, row_number() OVER (PARTITION BY tier, tier_name, q ORDER BY round(loss, 10), slope) AS k
      FROM (SELECT * FROM l{i} {f"UNION ALL SELECT * FROM b{i - 1}" if i else ""}) y) z WHERE k = 1)"""


def near_slopes_sql(i):
    return f"c{i} AS (SELECT tier, tier_name, q, round(slope + i * {0.5 / 3**i!r}e0, 9) AS slope FROM b{i - 1}, (SELECT unnest([-2, -1, 1, 2]) AS i) z), {pass_sql(i, f'c{i}')}"


LINES_SQL = f"""{LOG_SQL}, al AS (SELECT u.tier, u.tier_name, lh, lb FROM lo JOIN fx_types t ON code = type_code, LATERAL (SELECT 0 AS tier, 'General' AS tier_name
      UNION ALL SELECT 1, clade UNION ALL SELECT 2, family UNION ALL SELECT 3, genus UNION ALL SELECT 4, name) u),
    gr AS (SELECT DISTINCT tier, tier_name FROM al),
    c0 AS (SELECT tier, tier_name, q, slope FROM gr, (SELECT CAST(unnest([0.15, 0.5, 0.85]) AS DOUBLE) AS q) a, (SELECT CAST(unnest([-0.5, 0, 0.5, 1, 1.5, 2, 2.5]) AS DOUBLE) AS slope) b),
    {pass_sql(0, "c0")},
    {near_slopes_sql(1)}, {near_slopes_sql(2)}, {near_slopes_sql(3)}"""


@query(
    "quantile_allometry",
    f"""WITH {LINES_SQL}, wd AS (SELECT tier, tier_name, {", ".join(f"max(CASE WHEN q = {q} THEN slope END) AS {n}_slope, max(CASE WHEN q = {q} THEN a END) AS {n}_intercept"
        for q, n in (("15e-2", "low_bound"), ("5e-1", "median"), ("85e-2", "upper_bound")))} FROM b3 GROUP BY tier, tier_name),
    sc AS (SELECT al.tier, al.tier_name, count(*) AS n_samples, 1 - sum((lb - a - slope * lh) * (lb - a - slope * lh)) / (count(*) * var_pop(lb)) AS r2,
      sqrt(avg((exp(lb) - exp(a + slope * lh)) * (exp(lb) - exp(a + slope * lh)))) AS rmse FROM al JOIN b3 ON b3.tier = al.tier AND b3.tier_name = al.tier_name AND q = 5e-1 GROUP BY al.tier, al.tier_name)
    SELECT tier, tier_name, n_samples, round(low_bound_slope, 6) AS low_bound_slope, round(low_bound_intercept, 8) AS low_bound_intercept, round(median_slope, 6) AS median_slope,
    round(median_intercept, 8) AS median_intercept, round(upper_bound_slope, 6) AS upper_bound_slope, round(upper_bound_intercept, 8) AS upper_bound_intercept, round(r2, 8) AS r2, round(rmse, 6) AS rmse
    FROM wd JOIN sc USING (tier, tier_name) WHERE n_samples >= 10 AND r2 >= 0.1 AND median_slope >= 0""",
)
def quantile_allometry(v):
    fits = allometry.power_laws(stage(tier_rows(v), "tiers"), ["tier", "tier_name"], "lh", "lb")
    digits = {f"{n}_{c}": d for n in ("low_bound", "median", "upper_bound") for c, d in (("slope", 6), ("intercept", 8))}
    return fits.withColumns({c: rnd(c, d) for c, d in (digits | {"r2": 8, "rmse": 6}).items()})


@query(
    "allometry_fit_score",
    f"""WITH {PARAM_SQL}, lo AS (SELECT tier, tier_name, ln(height) AS lh, ln(agb) AS lb FROM ts)
    SELECT tier, tier_name, count(*) AS n_samples, round(1 - sum((lb - intercept - slope * lh) * (lb - intercept - slope * lh)) / (count(*) * var_pop(lb)), 8) AS r2,
    round(sqrt(avg((exp(lb) - exp(intercept + slope * lh)) * (exp(lb) - exp(intercept + slope * lh)))), 6) AS rmse
    FROM lo JOIN fit USING (tier, tier_name) GROUP BY tier, tier_name""",
)
def allometry_fit_score(v):
    rows = tiered_rows(v).select("tier", "tier_name", F.ln("height").alias("lh"), F.ln("agb").alias("lb"))
    scores = allometry.score_lines(rows, tier_parameters(v)[0], ["tier", "tier_name"], "lh", "lb")
    return scores.withColumns({"r2": rnd("r2", 8), "rmse": rnd("rmse", 6)})
