"""Climate cells, anomalies and the modelling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import change, climate, masks
from sylvagrid.plans.registry import query
from sylvagrid.plans.stocks import PAIRS_SQL
from sylvagrid.session import stage

START, END = 1995, 1999  # reference period: effective years 1995 to 1998
ALL_VARIABLES = ["bio1", *[f"bio{i}" for i in range(4, 20)]]
LAGGED = [f"{b}{s}" for b in climate.MODEL_VARIABLES for s in ("", "_2yr", "_3yr")]

EFF_SQL = "mc AS (SELECT *, yr - CASE WHEN mo >= 9 THEN 0 ELSE 1 END AS eff_year FROM fx_climate)"
CLIM_SQL = f"""{EFF_SQL}, cl AS (SELECT cell, mo, avg(temp) AS temp, avg(precip) AS precip FROM mc WHERE eff_year BETWEEN {START} AND {END - 1}
    GROUP BY cell, mo)"""


def bioclim_sql(source: str, keys: str) -> str:
    seasons = climate.SEASONS
    t = ", ".join(f"avg(CASE WHEN mo IN {s} THEN temp END)" for s in seasons)
    p = ", ".join(f"sum(CASE WHEN mo IN {s} THEN precip END)" for s in seasons)

    def pick(values, by, fn):
        return f"{values}[list_position({by}, {fn}({by}))]"

    return f"""SELECT {keys}, bio1, bio4, bio5, bio6, bio5 - bio6 AS bio7, {pick("t", "p", "list_max")} AS bio8, {pick("t", "p", "list_min")} AS bio9,
    {pick("t", "t", "list_max")} AS bio10, {pick("t", "t", "list_min")} AS bio11, bio12, bio13, bio14,
    CASE WHEN pm > 0 THEN ps / pm * 1e2 ELSE 0 END AS bio15, {pick("p", "p", "list_max")} AS bio16, {pick("p", "p", "list_min")} AS bio17,
    {pick("p", "t", "list_max")} AS bio18, {pick("p", "t", "list_min")} AS bio19 FROM (SELECT {keys}, avg(temp) AS bio1, stddev_pop(temp) * 1e2 AS bio4,
    max(temp) AS bio5, min(temp) AS bio6, sum(precip) AS bio12, max(precip) AS bio13, min(precip) AS bio14, avg(precip) AS pm, stddev_pop(precip) AS ps,
    [{t}] AS t, [{p}] AS p FROM {source} GROUP BY {keys} HAVING count(*) >= 12) q"""


ANOM_SQL = f"""{CLIM_SQL}, rf AS ({bioclim_sql("cl", "cell")}), yb AS ({bioclim_sql("mc", "cell, eff_year")}),
    an AS (SELECT yb.cell, eff_year, {", ".join(f"yb.{b} - rf.{b} AS {b}" for b in climate.MODEL_VARIABLES)} FROM yb JOIN rf ON yb.cell = rf.cell)"""
ROLL_SQL = f"""{ANOM_SQL}, ro AS (SELECT * FROM (SELECT cell, eff_year, count(*) OVER w3 AS n3, {", ".join(
    f"{b}, avg({b}) OVER w2 AS {b}_2yr, avg({b}) OVER w3 AS {b}_3yr" for b in climate.MODEL_VARIABLES)} FROM an
    WINDOW w2 AS (PARTITION BY cell ORDER BY eff_year RANGE BETWEEN 1 PRECEDING AND CURRENT ROW),
    w3 AS (PARTITION BY cell ORDER BY eff_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)) q WHERE n3 = 3)"""


def rounded(df, columns, digits=7):
    return df.withColumns({c: rnd(c, digits) for c in columns})


def rounded_sql(columns, digits=7):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query(
    "hydro_year",
    f"WITH {EFF_SQL} SELECT cell, eff_year, count(*) AS n_months, count(*) >= 12 AS complete FROM mc GROUP BY cell, eff_year",
)
def hydro_year(v):
    return climate.hydro_years(v.climate)


def reference_of(v):
    return climate.bioclim(climate.monthly_climatology(v.climate, START, END), ["cell"])


def anomalies_of(v):
    yearly = climate.yearly_bioclim(v.climate)
    return climate.anomalies(yearly, reference_of(v), climate.MODEL_VARIABLES)


def lagged_of(v):
    return climate.rolling_anomalies(anomalies_of(v), climate.MODEL_VARIABLES)


@query("monthly_climatology", f"WITH {CLIM_SQL} SELECT cell, mo, {rounded_sql(['temp', 'precip'], 8)} FROM cl")
def monthly_climatology(v):
    return rounded(climate.monthly_climatology(v.climate, START, END), ["temp", "precip"], 8)


@query(
    "bioclim_variables",
    f"WITH {CLIM_SQL}, rf AS ({bioclim_sql('cl', 'cell')}) SELECT cell, {rounded_sql(ALL_VARIABLES)} FROM rf",
)
def bioclim_variables(v):
    return rounded(reference_of(v), ALL_VARIABLES)


@query("bioclim_anomaly", f"WITH {ANOM_SQL} SELECT cell, eff_year, {rounded_sql(climate.MODEL_VARIABLES)} FROM an")
def bioclim_anomaly(v):
    return rounded(anomalies_of(v), climate.MODEL_VARIABLES)


@query("rolling_anomaly", f"WITH {ROLL_SQL} SELECT cell, eff_year, {rounded_sql(LAGGED)} FROM ro")
def rolling_anomaly(v):
    return rounded(lagged_of(v).select("cell", "eff_year", *LAGGED), LAGGED)


# --- modelling table ---------------------------------------------------------

ML_SQL = f"""{ROLL_SQL}, {PAIRS_SQL},
    ch AS (SELECT cell, CAST(floor((cell - 1) / 2e1) AS INT) + 1 AS climate_cell, year1 AS year_start, year2 AS year_end,
      CASE WHEN b1 + b2 > 0 THEN 2e2 * (b2 - b1) / (b1 + b2) ELSE 0 END AS biomass_rel_change FROM pr),
    jo AS (SELECT ch.*, g.x - 5e1 AS x, g.y + 5e1 AS y, {", ".join(LAGGED)} FROM ch JOIN ro ON ro.cell = climate_cell AND eff_year = year_start
      JOIN fx_grid g ON g.cell = ch.cell),
    ml AS (SELECT * FROM jo)"""
KEPT = ["bio1", "bio12", "bio12_2yr", "bio12_3yr", "bio17_3yr"]


def modelling_rows(v, features=LAGGED, digits=None):
    """Relative change of consecutive years with lagged anomalies; x and y are cell corners.

    With `digits` the anomalies are rounded, once for all the cells that share them.
    """
    lagged = lagged_of(v) if digits is None else rounded(lagged_of(v), features, digits)
    pairs = change.change_columns(change.transition_pairs(v.cells))
    target = pairs.select(
        "cell",
        (F.floor((F.col("cell") - 1) / 20.0).cast("int") + 1).alias("climate_cell"),
        F.col("year1").alias("year_start"),
        F.col("year2").alias("year_end"),
        F.col("rel_diff").alias("biomass_rel_change"),
    )
    corner = v.grid.select("cell", (F.col("x") - 50.0).alias("x"), (F.col("y") + 50.0).alias("y"))
    return climate.modelling_table(target.join(corner, "cell"), lagged, features)


@query(
    "climate_ml_dataset",
    f"""WITH {ML_SQL} SELECT cell, x, y, year_start, year_end, {rounded_sql(['biomass_rel_change', *LAGGED])} FROM ml""",
)
def climate_ml_dataset(v):
    rows = modelling_rows(v)
    return rounded(rows.drop("climate_cell"), ["biomass_rel_change", *LAGGED])


@query(
    "sigma_clip",
    f"""WITH {ML_SQL}, s AS (SELECT avg(biomass_rel_change) AS m, stddev_samp(biomass_rel_change) AS d FROM ml)
    SELECT year_start, count(*) AS n_kept, round(min(biomass_rel_change), 7) AS min_change, round(max(biomass_rel_change), 7) AS max_change
    FROM ml, s WHERE abs(biomass_rel_change - m) <= 15e-1 * d GROUP BY year_start""",
)
def sigma_clip(v):
    rows = stage(modelling_rows(v, ["bio1"]).select("year_start", "biomass_rel_change"), "ml")
    return (
        masks.sigma_clip(rows, "biomass_rel_change", 1.5)
        .groupBy("year_start")
        .agg(
            F.count(F.lit(1)).alias("n_kept"),
            rnd(F.min("biomass_rel_change"), 7, "min_change"),
            rnd(F.max("biomass_rel_change"), 7, "max_change"),
        )
    )


@query(
    "standardize_features",
    f"""WITH {ML_SQL} SELECT cell, year_start, {", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 7) AS {c}" for c in ["biomass_rel_change", *KEPT])},
    0e0 AS constant FROM ml""",
)
def standardize_features(v):
    """z-scores of the target and of every predictor that is not excluded by name or prefix."""
    rows = modelling_rows(v, KEPT).withColumn("constant", F.lit(3.0)).withColumn("bio9_2yr", F.lit(1.0))
    rows = stage(rows, "ml")
    excluded = ["cell", "climate_cell", "x", "y", "year_start", "year_end"]
    names = climate.predictors(rows.columns, "biomass_rel_change", excluded, ["bio8", "bio9", "bio18", "bio19"])
    scaled = climate.standardize(rows, ["biomass_rel_change", *names])
    return rounded(scaled.select("cell", "year_start", "biomass_rel_change", *names), ["biomass_rel_change", *names])
