"""Model tables, splits, smoothing and the scalar families."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.labels import format_variable
from sylvagrid.functions.text import rnd
from sylvagrid.operators import models, series
from sylvagrid.plans.registry import query, uniform_sql
from sylvagrid.plans.space import clustered

FREQ_SQL = """fq AS (SELECT feature, count(*) AS count, count(*) / CAST((SELECT count(*) FROM fx_models) AS DOUBLE) AS frequency FROM fx_model_features GROUP BY feature)"""


@query("feature_frequency", f"WITH {FREQ_SQL} SELECT feature, count, round(frequency, 9) AS frequency FROM fq")
def feature_frequency(v):
    return models.feature_frequency(v.model_features, v.models).withColumn("frequency", rnd("frequency", 9))


@query(
    "top_features",
    f"WITH {FREQ_SQL} SELECT feature, count, round(frequency, 9) AS frequency FROM fq ORDER BY fq.frequency DESC, feature LIMIT 6",
)
def top_features(v):
    return models.top_features(models.feature_frequency(v.model_features, v.models), 6).withColumn(
        "frequency", rnd("frequency", 9)
    )


@query(
    "importance_compare",
    f"""WITH {FREQ_SQL}, m AS (SELECT f.feature, f.run_id, val_r2, test_r2 FROM fx_model_features f JOIN fx_models m ON m.run_id = f.run_id),
    a AS (SELECT feature, avg(val_r2) AS v FROM m GROUP BY feature),
    b AS (SELECT feature, avg(test_r2) AS v FROM m WHERE test_r2 IS NOT NULL GROUP BY feature)
    SELECT a.feature, round(a.v, 8) AS first_importance, round(b.v, 8) AS second_importance, round(COALESCE(frequency, 0), 9) AS frequency
    FROM a JOIN b ON a.feature = b.feature LEFT JOIN fq ON fq.feature = a.feature""",
)
def importance_compare(v):
    """Features scored by both measures, with their selection frequency."""
    scored = v.model_features.join(v.models, "run_id")
    first = scored.groupBy("feature").agg(F.avg("val_r2").alias("first_importance"))
    # models without a test score have no second measure
    second = scored.where("test_r2 IS NOT NULL").groupBy("feature").agg(F.avg("test_r2").alias("second_importance"))
    frequency = models.feature_frequency(v.model_features, v.models).select("feature", "frequency")
    both = first.join(second, "feature").join(frequency, "feature", "left").fillna(0.0, ["frequency"])
    return both.withColumns({"first_importance": rnd("first_importance", 8), "second_importance": rnd("second_importance", 8), "frequency": rnd("frequency", 9)})


@query(
    "run_summary",
    """SELECT CAST(study % 10 AS INT) AS batch, count(*) AS n_runs, round(avg(val_r2), 8) AS val_r2_mean, round(stddev_pop(val_r2), 8) AS val_r2_std, min(val_r2) AS val_r2_min,
    max(val_r2) AS val_r2_max, round(avg(test_r2), 8) AS test_r2_mean, round(stddev_pop(test_r2), 8) AS test_r2_std, min(test_r2) AS test_r2_min, max(test_r2) AS test_r2_max,
    round(count(CASE WHEN COALESCE(test_r2, val_r2) >= 2e-1 THEN 1 END) / CAST(count(*) AS DOUBLE), 9) AS share_above FROM fx_models GROUP BY 1""",
)
def run_summary(v):
    out = models.run_summary(v.models.withColumn("batch", (F.col("study") % 10).cast("int")), ["batch"], 0.2)
    digits = {f"{c}_{s}": 8 for c in ("val_r2", "test_r2") for s in ("mean", "std")} | {"share_above": 9}
    return out.withColumns({c: rnd(c, d) for c, d in digits.items()})


@query(
    "filter_models",
    """WITH h AS (SELECT run_id FROM fx_model_features WHERE feature IN ('bio12', 'bio12_3yr', 'bio5') GROUP BY run_id HAVING count(DISTINCT feature) >= 1),
    k AS (SELECT m.run_id, COALESCE(test_r2, val_r2) AS r2 FROM fx_models m JOIN fx_model_features f ON f.run_id = m.run_id AND f.feature = 'bio12' WHERE COALESCE(test_r2, val_r2) >= 2e-1)
    SELECT run_id, r2 FROM k WHERE r2 >= (SELECT quantile_cont(r2, 0.9) FROM k) OR (SELECT count(*) FROM k) <= 10""",
)
def filter_models(v):
    """Models above the R2 limit that use the feature, then the top tenth of them."""
    good = models.filter_models(v.models, 0.2)
    using = models.models_with(good, v.model_features, ["bio12"])
    return models.top_share(using, "r2", 10.0).select("run_id", "r2")


@query(
    "early_stop_trial",
    """WITH t AS (SELECT study, val_r2, row_number() OVER (PARTITION BY study ORDER BY run_id) - 1 AS trial FROM fx_models),
    b AS (SELECT *, max(val_r2) OVER (PARTITION BY study ORDER BY trial) AS best FROM t),
    c AS (SELECT *, CASE WHEN trial = 2 OR best > lag(best) OVER (PARTITION BY study ORDER BY trial) THEN trial END AS hit FROM b WHERE trial >= 2),
    l AS (SELECT *, max(hit) OVER (PARTITION BY study ORDER BY trial) AS last FROM c)
    SELECT study, CAST(min(CASE WHEN trial - last >= 3 THEN trial END) AS INT) AS stop_trial, CAST(arg_max(last, trial) AS INT) AS last_best_trial, max(best) AS best_value FROM l GROUP BY study""",
)
def early_stop_trial(v):
    # a study is one search: its trials in order of their run number
    trial = F.row_number().over(W.partitionBy("study").orderBy("run_id")) - 1
    trials = v.models.select("study", "val_r2", trial.alias("trial"))
    return series.early_stop(trials, ["study"], "trial", "val_r2", patience=3, min_trials=3)


@query(
    "run_summary_json",
    """SELECT study, CAST(to_json({'study': study, 'n_models': count(*), 'n_tested': count(test_r2), 'n_good': count(CASE WHEN val_r2 >= 2e-1 THEN 1 END)}) AS VARCHAR) AS summary
    FROM fx_models GROUP BY study""",
)
def run_summary_json(v):
    per = v.models.groupBy("study").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count("test_r2").alias("n_tested"),
        F.count_if(F.col("val_r2") >= 0.2).alias("n_good"),
    )
    return per.select("study", F.to_json(F.struct("study", "n_models", "n_tested", "n_good")).alias("summary"))


# --- splits ------------------------------------------------------------------


@query(
    "spatial_split",
    f"""WITH k AS (SELECT DISTINCT CAST((floor(r / 1e1) * 5 + floor(c / 1e1)) % 15 AS INT) AS cluster_id FROM fx_grid),
    o AS (SELECT cluster_id, row_number() OVER (ORDER BY {uniform_sql(42, "cluster_id")}, cluster_id) AS k FROM k)
    SELECT cluster_id, CASE WHEN k <= 2 THEN 'test' WHEN k <= 5 THEN 'validation' ELSE 'train' END AS part, n_cells FROM o JOIN
    (SELECT CAST((floor(r / 1e1) * 5 + floor(c / 1e1)) % 15 AS INT) AS cluster_id, count(*) AS n_cells FROM fx_grid GROUP BY 1) q USING (cluster_id)""",
)
def spatial_split(v):
    cells = clustered(v)
    parts = models.shuffled_split(cells, "cluster_id", 42, test=2, validation=3)
    sizes = cells.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return sizes.join(parts, "cluster_id")


@query(
    "grid_split",
    f"""WITH g AS (SELECT DISTINCT CAST(floor(r / 4e0) AS INT) AS gr, CAST(floor(c / 4e0) AS INT) AS gc FROM fx_grid),
    o AS (SELECT gr, gc, (row_number() OVER (ORDER BY {uniform_sql(42, "gr, gc")}, gr, gc) - 1) / CAST(count(*) OVER () AS DOUBLE) AS p FROM g)
    SELECT gr, gc, CASE WHEN p < 8e-1 THEN 'train' WHEN p < 9e-1 THEN 'validation' ELSE 'test' END AS part FROM o""",
)
def grid_split(v):
    cells = v.grid.select(F.floor(F.col("r") / 4).cast("int").alias("gr"), F.floor(F.col("c") / 4).cast("int").alias("gc"))
    return models.fraction_split(cells, ["gr", "gc"], 42, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])


# --- smoothing ---------------------------------------------------------------


def lowess_pass_sql(i):
    """Fit number `i` of the curves from the robust weights of the fit before."""
    return f"""s{i} AS (SELECT w.l_linenumber, x0, y0, sum(w * rw) AS sw, sum(w * rw * dx) AS sx, sum(w * rw * w.y) AS sy, sum(w * rw * dx * dx) AS sxx, sum(w * rw * dx * w.y) AS sxy
      FROM w JOIN p{i} ON p{i}.l_linenumber = w.l_linenumber AND p{i}.x = w.x1 GROUP BY w.l_linenumber, x0, y0),
    f{i} AS (SELECT l_linenumber, x0, y0, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) AS fit FROM s{i}),
    p{i + 1} AS (SELECT l_linenumber, x0 AS x, CASE WHEN u < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0 END AS rw
      FROM (SELECT l_linenumber, x0, abs(y0 - fit) / (6e0 * median(abs(y0 - fit)) OVER (PARTITION BY l_linenumber)) AS u FROM f{i}) q)"""


@query(
    "lowess_smooth",
    f"""WITH cu AS (SELECT l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) + CAST(l_quantity AS INT) % 7 / 1e1 AS x,
      CAST(sum(CAST(round(l_extendedprice * 1e2) AS BIGINT)) AS DOUBLE) / (count(*) * 1e5) AS y FROM lineitem GROUP BY 1, 2, 3),
    n AS (SELECT l_linenumber, count(*) AS n, CAST(greatest(floor(3e-1 * count(*) + 1e-10), 2) AS INT) AS k FROM cu GROUP BY l_linenumber),
    d AS (SELECT a.l_linenumber, a.x AS x0, a.y AS y0, b.x AS x1, b.x - a.x AS dx, b.y AS y, abs(b.x - a.x) AS d, k, row_number() OVER (PARTITION BY a.l_linenumber, a.x ORDER BY abs(b.x - a.x)) AS o
      FROM cu a JOIN cu b ON a.l_linenumber = b.l_linenumber JOIN n ON n.l_linenumber = a.l_linenumber),
    h AS (SELECT l_linenumber, x0, d AS h FROM d WHERE o = k),
    w AS (SELECT d.*, CASE WHEN d / h < 1 THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM d JOIN h ON h.l_linenumber = d.l_linenumber AND h.x0 = d.x0),
    p0 AS (SELECT l_linenumber, x, 1e0 AS rw FROM cu),
    {", ".join(lowess_pass_sql(i) for i in range(4))}
    SELECT l_linenumber, x0 AS x, round(y0, 7) AS y, round(fit, 7) AS smooth FROM f3""",
)
def lowess_smooth(v):
    """Mean price curve over quantity per line number, smoothed."""
    q = F.col("l_quantity").cast("int")
    mean = F.sum(F.round(F.col("l_extendedprice") * 1e2).cast("bigint")).cast("double") / (F.count(F.lit(1)) * 1e5)
    curve = v.t("lineitem").groupBy("l_linenumber", (q + q % 7 / 10.0).alias("x")).agg(mean.alias("y"))
    out = models.lowess(curve, ["l_linenumber"], "x", "y", frac=0.3)
    return out.withColumns({"y": rnd("y", 7), "smooth": rnd("smooth", 7)})


# --- scalar families ---------------------------------------------------------


@query(
    "string_parsing",
    """SELECT o_orderkey, upper(concat('zone_', 'h', CAST(28 + o_orderkey % 4 AS VARCHAR))) AS zone_label, concat('TBD_S2_mean_', CAST(year(o_orderdate) AS VARCHAR), '_100m_code', lpad(CAST(o_custkey % 60 AS VARCHAR), 3, '0'), '.tif') AS file_name,
    CAST(year(o_orderdate) AS INT) AS year_from_name, CAST(o_custkey % 60 AS INT) AS code_from_name, strftime(o_orderdate, '%y') AS year_digits, concat(CAST(year(o_orderdate) AS VARCHAR), '-06-01/', CAST(year(o_orderdate) AS VARCHAR), '-09-01') AS season FROM orders""",
)
def string_parsing(v):
    year = F.year("o_orderdate")
    name = F.format_string("TBD_S2_mean_%d_100m_code%03d.tif", year, F.col("o_custkey") % 60)
    text = F.date_format("o_orderdate", "dd/MM/yy")
    rows = v.t("orders").select("o_orderkey", "o_orderdate", name.alias("file_name"), text.alias("_text"), (F.col("o_orderkey") % 4 + 28).alias("_zone"))
    return rows.select(
        "o_orderkey",
        F.upper(F.concat(F.lit("zone_h"), F.col("_zone").cast("string"))).alias("zone_label"),
        "file_name",
        F.regexp_extract("file_name", r"_(\d{4})_", 1).cast("int").alias("year_from_name"),
        F.regexp_extract("file_name", r"code(\d+)", 1).cast("int").alias("code_from_name"),
        F.substring("_text", 7, 2).alias("year_digits"),
        F.format_string("%1$d-06-01/%1$d-09-01", F.year("o_orderdate")).alias("season"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 9 THEN 0 ELSE 1 END AS INT) AS eff_year, year(o_orderdate) + 5e-1 AS year_mid,
    CAST(CAST(o_orderdate AS DATE) - make_date(year(o_orderdate), 1, 1) AS INT) AS span_days, concat(CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 9 THEN 0 ELSE 1 END AS VARCHAR), 'Sep-',
    CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END AS VARCHAR), 'Aug') AS period, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month_text,
    CAST(month(o_orderdate) AS INT) AS month_back FROM orders""",
)
def date_functions(v):
    d = F.col("o_orderdate")
    eff = F.year(d) - F.when(F.month(d) >= 9, 0).otherwise(1)
    month_text = F.date_format(d, "yyyy-MM")
    return v.t("orders").select(
        "o_orderkey",
        eff.alias("eff_year"),
        (F.year(d) + F.lit(0.5).cast("double")).alias("year_mid"),
        F.datediff(d.cast("date"), F.make_date(F.year(d), F.lit(1), F.lit(1))).alias("span_days"),
        F.format_string("%dSep-%dAug", eff, eff + 1).alias("period"),
        month_text.alias("month_text"),
        F.month(F.to_date(month_text, "yyyy-MM")).alias("month_back"),
    )


@query(
    "math_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(pow(l_quantity, 7e-1), 8) AS power, round(ln(l_extendedprice), 9) AS log, round(exp(l_discount), 9) AS exponent, round(ln(1 + l_tax), 9) AS log1p,
    round(exp(l_tax) - 1, 9) AS expm1, round(sqrt(l_quantity), 9) AS root, round(cbrt(l_quantity), 9) AS cube_root, CAST(floor(l_extendedprice / 1e3) AS BIGINT) AS floored, CAST(ceil(l_extendedprice / 1e3) AS BIGINT) AS ceiled,
    CAST(l_partkey % 7 AS BIGINT) AS remainder, greatest(l_quantity, 25) AS larger, least(l_quantity, 25) AS smaller, round(abs(l_quantity - 255e-1), 6) AS distance FROM lineitem""",
)
def math_functions(v):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return v.t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        rnd(F.pow(q, F.lit(0.7)), 8, "power"),
        rnd(F.ln(price), 9, "log"),
        rnd(F.exp("l_discount"), 9, "exponent"),
        rnd(F.log1p("l_tax"), 9, "log1p"),
        rnd(F.expm1("l_tax"), 9, "expm1"),
        rnd(F.sqrt(q), 9, "root"),
        rnd(F.cbrt(q), 9, "cube_root"),
        F.floor(price / 1e3).alias("floored"),
        F.ceil(price / 1e3).alias("ceiled"),
        (F.col("l_partkey") % 7).alias("remainder"),
        F.greatest(q, F.lit(25.0)).alias("larger"),
        F.least(q, F.lit(25.0)).alias("smaller"),
        rnd(F.abs(q - 25.5), 6, "distance"),
    )


@query(
    "format_labels",
    """SELECT run_id, feature, concat(CASE split_part(feature, '_', 1) WHEN 'bio1' THEN 'Annual mean temperature' WHEN 'bio12' THEN 'Annual precipitation' WHEN 'bio5' THEN 'Max temperature of warmest month'
    ELSE concat('B', substr(split_part(feature, '_', 1), 2)) END, CASE WHEN feature LIKE '%\\_%' ESCAPE '\\' THEN concat(' (', split_part(feature, '_', 2), ')') ELSE '' END) AS label FROM fx_model_features""",
)
def format_labels(v):
    return v.model_features.withColumn("label", format_variable("feature"))
