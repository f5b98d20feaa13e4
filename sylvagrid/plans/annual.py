"""From heights to annual biomass: resolve parameters, simulate, mask, sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import masks, montecarlo
from sylvagrid.plans.inventory import RESOLVE_SQL, resolved_parameters
from sylvagrid.plans.registry import query, uniform_sql
from sylvagrid.plans.stocks import MASKED_CLASSES


def biomass_layers(heights: DataFrame, parameters: DataFrame, draws: int = 250, seed: int = 42) -> DataFrame:
    """Mean and uncertainty of AGB, BGB and total per cell and year, masked by land use.

    `heights(cell, yr, type_name, landcover, height)`; `parameters` as in
    `montecarlo.allometric_density`, one row per type name. Masked cells are
    dropped before the simulation, not after it.
    """
    kept = heights.withColumn("height", masks.drop_classes(F.col("height"), F.col("landcover"), MASKED_CLASSES))
    density = montecarlo.allometric_density(kept.where("height IS NOT NULL").join(parameters, "type_name"))
    return montecarlo.cell_monte_carlo(density, ["cell", "yr"], draws, seed)


ANNUAL_SQL = f"""{RESOLVE_SQL},
    de AS (SELECT k.cell, yr, a * pow(height, b) AS p50, ratio_mean AS m FROM fx_cells k JOIN fx_grid g ON g.cell = k.cell JOIN fx_types t ON t.code = g.type_code
      JOIN res ON type_name = t.name WHERE landcover NOT IN (12, 13, 14) AND height > 0),
    sd AS (SELECT cell, yr, p50, m, p50 * ((1 - 8e-1) + (125e-2 - 1)) / 1.0364333894937898e0 / 2 AS s, m * ((1 - 6e-1) + (15e-1 - 1)) / 1.6448536269514722e0 / 2 AS rs,
      {uniform_sql(42, "cell, yr", 0)} AS u, {uniform_sql(42, "cell, yr", 1)} AS v FROM de),
    dr AS (SELECT cell, yr, p50, m, s, rs, u + k * 0.7548776662466927e0 AS uu, v + k * 0.5698402909980532e0 AS vv FROM sd, (SELECT unnest(range(1, 251)) AS k) q),
    zz AS (SELECT cell, yr, p50 + sqrt(-2e0 * ln(greatest(uu - floor(uu), 1e-12))) * cos(2e0 * pi() * greatest(vv - floor(vv), 1e-12)) * s AS agb,
      m + sqrt(-2e0 * ln(greatest(uu - floor(uu), 1e-12))) * sin(2e0 * pi() * greatest(vv - floor(vv), 1e-12)) * rs AS coef FROM dr),
    ce AS (SELECT cell, yr, avg(agb) AS agbd, avg(agb * coef) AS bgbd, stddev_pop(agb + agb * coef) * 196e-2 AS unc FROM zz GROUP BY cell, yr)"""


@query(
    "annual_biomass",
    f"""WITH {ANNUAL_SQL} SELECT yr, count(*) AS n_cells, round(sum(agbd) / 1e3, 5) AS agb, round(sum(bgbd) / 1e3, 5) AS bgb, round(sum(agbd + bgbd) / 1e3, 5) AS tbd,
    round(avg(unc), 5) AS mean_uncertainty FROM ce GROUP BY yr""",
)
def annual_biomass(v):
    """Kilotonnes per year from the fitted parameters of every type."""
    p = resolved_parameters(v)
    parameters = p.select(
        "type_name",
        *[(F.col("a") * k).alias(f"a{q}") for q, k in ((15, 0.8), (50, 1.0), (85, 1.25))],
        *[F.col("b").alias(f"b{q}") for q in (15, 50, 85)],
        "ratio_mean",
        (F.col("ratio_mean") * 0.6).alias("ratio_p5"),
        (F.col("ratio_mean") * 1.5).alias("ratio_p95"),
    )
    names = v.types.select(F.col("code").alias("type_code"), F.col("name").alias("type_name"))
    static = v.grid.select("cell", "type_code", "landcover").join(names, "type_code")
    heights = v.cells.select("cell", "yr", "height").join(static, "cell")
    layers = biomass_layers(heights, parameters, draws=250)
    return layers.groupBy("yr").agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[rnd(F.sum(f"{c}_mean") / 1e3, 5, n) for c, n in (("agbd", "agb"), ("bgbd", "bgb"), ("tbd", "tbd"))],
        rnd(F.avg("tbd_uncertainty"), 5, "mean_uncertainty"),
    )
