"""Monte Carlo biomass, country totals and flux."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import montecarlo
from sylvagrid.plans.registry import normal_sql, query, uniform_sql
from sylvagrid.session import stage

DENSITY_SQL = """pa AS (SELECT code, 5e-1 + code % 5 * 1e-1 AS a, 11e-1 + code % 3 * 1e-1 AS b, 2e-1 + code % 4 * 2e-2 AS m FROM fx_types),
    hh AS (SELECT k.cell, yr, type_code, CASE WHEN height > 3 THEN CASE WHEN height - 3 < 2 THEN 0 ELSE height - 3 END END AS h
      FROM fx_cells k JOIN fx_grid g ON g.cell = k.cell),
    de AS (SELECT cell, yr, a * pow(h, b) AS p50, 8e-1 * a * pow(h, b) AS p15, 125e-2 * a * pow(h, b) AS p85, m FROM hh JOIN pa ON code = type_code),
    sd AS (SELECT cell, yr, p50, ((p50 - p15) / 1.0364333894937898e0 + (p85 - p50) / 1.0364333894937898e0) / 2 AS agb_sd, m AS ratio_mean,
      ((m - m * 6e-1) / 1.6448536269514722e0 + (m * 15e-1 - m) / 1.6448536269514722e0) / 2 AS ratio_sd FROM de)"""


def density_of(v):
    """Cells with the power-law parameters of their type, reduced to median and spreads."""
    code = F.col("code")
    a = F.lit(0.5) + code % 5 * F.lit(0.1)
    b = F.lit(1.1) + code % 3 * F.lit(0.1)
    m = F.lit(0.2) + code % 4 * F.lit(0.02)
    parameters = v.types.select(
        code.alias("type_code"),
        a.alias("a50"),
        b.alias("b50"),
        (a * 0.8).alias("a15"),
        b.alias("b15"),
        (a * 1.25).alias("a85"),
        b.alias("b85"),
        m.alias("ratio_mean"),
        (m * 0.6).alias("ratio_p5"),
        (m * 1.5).alias("ratio_p95"),
    )
    cells = v.cells.select("cell", "yr", (F.col("height") - 3.0).alias("height")).join(
        v.grid.select("cell", "type_code"), "cell"
    )
    return montecarlo.allometric_density(cells.join(parameters, "type_code"), threshold=2.0)


@query(
    "allometry_density",
    f"""WITH {DENSITY_SQL} SELECT cell, yr, round(p50, 7) AS p50, round(agb_sd, 7) AS agb_sd, round(ratio_sd, 9) AS ratio_sd FROM sd""",
)
def allometry_density(v):
    return density_of(v).select("cell", "yr", rnd("p50", 7), rnd("agb_sd", 7), rnd("ratio_sd", 9))


@query(
    "mc_cell_biomass",
    f"""WITH {DENSITY_SQL}, st AS (SELECT *, {uniform_sql(42, "cell, yr", 0)} AS u, {uniform_sql(42, "cell, yr", 1)} AS v FROM sd WHERE p50 IS NOT NULL),
    dr AS (SELECT cell, yr, p50, agb_sd, ratio_mean, ratio_sd, u + k * 0.7548776662466927e0 AS uu, v + k * 0.5698402909980532e0 AS vv
      FROM st, (SELECT unnest(range(1, 251)) AS k) q),
    z AS (SELECT *, sqrt(-2e0 * ln(greatest(uu - floor(uu), 1e-12))) AS rad, 2e0 * pi() * greatest(vv - floor(vv), 1e-12) AS ang FROM dr),
    g AS (SELECT cell, yr, p50 + rad * cos(ang) * agb_sd AS agb, ratio_mean + rad * sin(ang) * ratio_sd AS coef FROM z)
    SELECT cell, yr, round(avg(agb), 6) AS agbd_mean, round(stddev_pop(agb) * 196e-2, 6) AS agbd_uncertainty,
    round(avg(agb * coef), 6) AS bgbd_mean, round(stddev_pop(agb * coef) * 196e-2, 6) AS bgbd_uncertainty,
    round(avg(agb + agb * coef), 6) AS tbd_mean, round(stddev_pop(agb + agb * coef) * 196e-2, 6) AS tbd_uncertainty
    FROM g GROUP BY cell, yr""",
)
def mc_cell_biomass(v):
    result = montecarlo.cell_monte_carlo(density_of(v), ["cell", "yr"], draws=250, seed=42)
    return result.withColumns({c: rnd(c, 6) for c in result.columns[2:]})


@query(
    "spatial_blocks",
    """SELECT CAST(floor(r / 1e1) * 5 + floor(c / 1e1) AS INT) AS block, count(*) AS n_cells, min(r) AS r_min, max(c) AS c_max
    FROM fx_grid GROUP BY 1""",
)
def spatial_blocks(v):
    return (
        montecarlo.spatial_blocks(v.grid, size=10, width=50)
        .groupBy("block")
        .agg(F.count(F.lit(1)).alias("n_cells"), F.min("r").alias("r_min"), F.max("c").alias("c_max"))
    )


DRAWS = 1000
SAMPLES_SQL = f"""bz AS (SELECT br, bc, sample, {normal_sql(42, "br, bc, sample")} AS z
      FROM (SELECT DISTINCT CAST(floor(r / 1e1) AS INT) AS br, CAST(floor(c / 1e1) AS INT) AS bc FROM fx_cells) q, (SELECT unnest(range({DRAWS})) AS sample) s),
    smp AS (SELECT yr, CAST(sample AS INT) AS sample, sum(greatest(tbd + z * tbd_unc * 2e1 / 196e-2, 0)) / 1e6 AS total
      FROM fx_cells JOIN bz ON br = CAST(floor(r / 1e1) AS INT) AND bc = CAST(floor(c / 1e1) AS INT) GROUP BY yr, sample)"""


def samples_of(v):
    # widened so that the clamp at 0 takes effect
    cells = v.cells.withColumn("tbd_unc", F.col("tbd_unc") * 20.0)
    return montecarlo.country_samples(cells, ["yr"], "tbd", "tbd_unc", size=10, draws=DRAWS, seed=42)


@query(
    "mc_country_total",
    f"""WITH {SAMPLES_SQL} SELECT yr, round(quantile_cont(total, 0.025), 8) AS biomass_low, round(avg(total), 8) AS biomass_mean,
    round(quantile_cont(total, 0.975), 8) AS biomass_high, count(*) AS n_samples FROM smp GROUP BY yr""",
)
def mc_country_total(v):
    result = montecarlo.interval(samples_of(v), ["yr"])
    return result.withColumns({c: rnd(c, 8) for c in ("biomass_low", "biomass_mean", "biomass_high")})


@query(
    "carbon_flux_stats",
    f"""WITH {SAMPLES_SQL}, yy AS (SELECT yr AS year1, lead(yr) OVER (ORDER BY yr) AS year2 FROM (SELECT DISTINCT yr FROM smp) q),
    ix AS (SELECT j, CAST(floor({uniform_sql(42, "j", 0)} * {DRAWS}) AS INT) AS i1, CAST(floor({uniform_sql(42, "j", 1)} * {DRAWS}) AS INT) AS i2
      FROM (SELECT unnest(range({DRAWS})) AS j) q),
    fl AS (SELECT year1, year2, (b.total - a.total) * 5e-1 AS f FROM yy, ix JOIN smp a ON a.sample = i1 JOIN smp b ON b.sample = i2
      WHERE a.yr = year1 AND b.yr = year2)
    SELECT year1, year2, concat(year1, '-', year2) AS year_pair, round(avg(f), 8) AS mean_flux, round(median(f), 8) AS median_flux,
    round(stddev_pop(f), 8) AS std_flux, round(min(f), 8) AS min_flux, round(max(f), 8) AS max_flux, round(quantile_cont(f, 0.025), 8) AS lower_ci,
    round(quantile_cont(f, 0.975), 8) AS upper_ci, round(quantile_cont(f, 0.25), 8) AS q25, round(quantile_cont(f, 0.75), 8) AS q75,
    count(*) AS n_samples FROM fl GROUP BY year1, year2""",
)
def carbon_flux_stats(v):
    flux = montecarlo.interannual_flux(stage(samples_of(v), "samples"), combinations=10000)
    doubles = [f.name for f in flux.schema if f.dataType.typeName() == "double"]
    return flux.withColumns({c: rnd(c, 8) for c in doubles}).withColumn("year_pair", F.concat_ws("-", "year1", "year2"))
