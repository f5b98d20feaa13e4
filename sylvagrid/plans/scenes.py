"""Scenes, mosaics and height layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import catalog, change, composite, distributions, masks, series
from sylvagrid.plans.registry import query, uniform_sql
from sylvagrid.plans.stocks import PAIRS_SQL
from sylvagrid.session import scratch, stage
from sylvagrid.sources import tables

# Valid scene classes.
VALID_CLASSES = [4, 5, 6, 11]
NODATA = -9999.0


# --- scenes ------------------------------------------------------------------


@query(
    "unpivot_bands",
    """SELECT tile, band, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT tile, 'red' AS band, red AS value
    FROM fx_scenes UNION ALL SELECT tile, 'nir', nir FROM fx_scenes) q GROUP BY tile, band""",
)
def unpivot_bands(v):
    long = v.scenes.unpivot(["tile"], ["red", "nir"], "band", "value")
    return long.groupBy("tile", "band").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 6, "mean_value"))


def masked(v):
    keep = [masks.keep_classes(F.col(b), F.col("scl"), VALID_CLASSES).alias(b) for b in ("red", "nir")]
    return v.scenes.select("tile", "yr", "scene_date", "px", "scl", *keep)


@query(
    "scene_mask",
    """SELECT tile, yr, count(*) AS n_pixels, count(m) AS n_valid, round(avg(m), 6) AS mean_red FROM (SELECT *,
    CASE WHEN scl IN (4, 5, 6, 11) THEN red END AS m FROM fx_scenes) q GROUP BY tile, yr""",
)
def scene_mask(v):
    return (
        masked(v)
        .groupBy("tile", "yr")
        .agg(F.count(F.lit(1)).alias("n_pixels"), F.count("red").alias("n_valid"), rnd(F.avg("red"), 6, "mean_red"))
    )


VALIDITY_SQL = """sv AS (SELECT tile, yr, scene_date, 1e2 * count(CASE WHEN scl IN (4, 5, 6, 11) THEN 1 END) / count(*) AS validity
    FROM fx_scenes GROUP BY tile, yr, scene_date)"""
BEST_SQL = f"""{VALIDITY_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY tile, yr ORDER BY validity DESC, scene_date) AS k FROM sv),
    best AS (SELECT * FROM rk WHERE k <= 60)"""


def validity_of(v):
    return composite.scene_validity(v.scenes, ["tile", "yr", "scene_date"], F.col("scl").isin(VALID_CLASSES))


def best_of(v, n=60):
    return composite.best_scenes(validity_of(v), ["tile", "yr"], "scene_date", n)


def iso(col):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


@query(
    "scene_validity",
    f"WITH {VALIDITY_SQL} SELECT tile, strftime(scene_date, '%Y-%m-%d') AS scene_date, round(validity, 6) AS validity FROM sv",
)
def scene_validity(v):
    return validity_of(v).select("tile", iso("scene_date"), rnd("validity", 6))


@query(
    "best_scenes",
    f"""WITH {BEST_SQL} SELECT tile, yr, strftime(scene_date, '%Y-%m-%d') AS scene_date, CAST(k AS INT) AS rank, round(validity, 6) AS validity,
    CAST(max(scene_date) OVER (PARTITION BY tile, yr) - min(scene_date) OVER (PARTITION BY tile, yr) AS INT) AS span_days FROM best""",
)
def best_scenes(v):
    return best_of(v).select("tile", "yr", iso("scene_date"), "rank", rnd("validity", 6), "span_days")


@query(
    "median_mosaic",
    f"""WITH {BEST_SQL}, px AS (SELECT s.tile, s.yr, px, s.scene_date, CASE WHEN scl IN (4, 5, 6, 11) THEN red + CASE WHEN s.yr > 1998 THEN 1000 ELSE 0 END END AS red,
      CASE WHEN scl IN (4, 5, 6, 11) THEN nir + CASE WHEN s.yr > 1998 THEN 1000 ELSE 0 END END AS nir
      FROM fx_scenes s JOIN best b ON s.tile = b.tile AND s.scene_date = b.scene_date)
    SELECT tile, yr, px, CAST(floor(COALESCE(median(red), 0)) AS INT) AS red, CAST(floor(COALESCE(median(nir), 0)) AS INT) AS nir,
    round(1e2 * count(red) / count(*), 6) AS valid_pct FROM px GROUP BY tile, yr, px""",
)
def median_mosaic(v):
    """Median of the 60 best scenes per tile and year, offset for the newer processing baseline."""
    offset = F.when(F.col("yr") > 1998, 1000).otherwise(0)
    pixels = masked(v).join(best_of(v).select("tile", "scene_date"), ["tile", "scene_date"], "left_semi")
    pixels = pixels.withColumns({b: F.col(b) + offset for b in ("red", "nir")})
    keys = ["tile", "yr", "px"]
    valid = (100.0 * F.count("red") / F.count(F.lit(1))).alias("valid_pct")
    medians = [F.floor(F.coalesce(F.median(b), F.lit(0.0))).cast("int").alias(b) for b in ("red", "nir")]
    return pixels.groupBy(*keys).agg(*medians, valid).withColumn("valid_pct", rnd("valid_pct", 6))


@query(
    "mosaic_attributes",
    f"""WITH {BEST_SQL}, px AS (SELECT s.tile, s.yr, px, median(CASE WHEN scl IN (4, 5, 6, 11) THEN red END) AS red, median(CASE WHEN scl IN (4, 5, 6, 11) THEN nir END) AS nir
      FROM fx_scenes s JOIN best b ON s.tile = b.tile AND s.scene_date = b.scene_date GROUP BY s.tile, s.yr, px),
    sp AS (SELECT tile, yr, count(*) AS n_scenes, CAST(max(scene_date) - min(scene_date) AS INT) AS time_span FROM best GROUP BY tile, yr)
    SELECT tile, yr, n_scenes, time_span, round(1e2 * count(red) / count(*), 6) AS red_valid_pct, round(1e2 * count(nir) / count(*), 6) AS nir_valid_pct
    FROM px JOIN sp USING (tile, yr) GROUP BY tile, yr, n_scenes, time_span""",
)
def mosaic_attributes(v):
    """Per mosaic: its scenes, their time span in days, and the share of its pixels with a value, by band."""
    best = best_of(v)
    pixels = masked(v).join(best.select("tile", "scene_date"), ["tile", "scene_date"], "left_semi")
    per_pixel = pixels.groupBy("tile", "yr", "px").agg(*[F.median(b).alias(b) for b in ("red", "nir")])
    scenes = best.groupBy("tile", "yr").agg(F.count(F.lit(1)).alias("n_scenes"), F.max("span_days").alias("time_span"))
    n = F.count(F.lit(1))
    shares = per_pixel.groupBy("tile", "yr").agg(*[rnd(100.0 * F.count(b) / n, 6, f"{b}_valid_pct") for b in ("red", "nir")])
    return shares.join(scenes, ["tile", "yr"])


ROBUST_SQL = f"""sc AS (SELECT DISTINCT tile, yr, scene_date FROM fx_scenes WHERE scl IN (4, 5, 6)),
    rk AS (SELECT tile, yr, scene_date, rep, row_number() OVER (PARTITION BY tile, yr, rep
      ORDER BY {uniform_sql(7, "rep, tile, yr, strftime(scene_date, '%Y-%m-%d')")}, scene_date) AS k FROM sc, (SELECT unnest(range(1, 11)) AS rep) r),
    pv AS (SELECT tile, yr, scene_date, px, red FROM fx_scenes WHERE scl IN (4, 5, 6)),
    al AS (SELECT tile, yr, px, median(red) AS m FROM pv GROUP BY tile, yr, px),
    su AS (SELECT pv.tile, pv.yr, n, rep, px, median(red) AS m FROM pv JOIN rk USING (tile, yr, scene_date)
      JOIN (SELECT unnest([20, 40, 80, 120]) AS n) z ON k <= n GROUP BY pv.tile, pv.yr, n, rep, px),
    rr AS (SELECT tile, yr, n, rep, avg(abs(su.m - al.m)) AS d, count(*) AS valid FROM su JOIN al USING (tile, yr, px) GROUP BY tile, yr, n, rep),
    ro AS (SELECT tile, yr, CAST(n AS INT) AS n_scenes, avg(d) AS mean_difference, stddev_pop(d) AS std_difference,
      avg(valid / CAST(t AS DOUBLE)) AS mean_valid_pixels, stddev_pop(valid / CAST(t AS DOUBLE)) AS std_valid_pixels
      FROM rr JOIN (SELECT tile, yr, count(*) AS t FROM al GROUP BY tile, yr) q USING (tile, yr) GROUP BY tile, yr, n)"""


def robustness_of(v):
    pixels = masked(v).where("red IS NOT NULL").select("tile", "yr", "scene_date", "px", "red")
    pixels = stage(pixels, "pixels")
    return composite.robustness(pixels, ["tile", "yr"], "scene_date", "px", "red", [20, 40, 80, 120], 10, 7)


@query(
    "mosaic_robustness",
    f"""WITH {ROBUST_SQL} SELECT tile, yr, n_scenes, round(mean_difference, 7) AS mean_difference, round(std_difference, 6) AS std_difference,
    round(mean_valid_pixels, 7) AS mean_valid_pixels, round(std_valid_pixels, 6) AS std_valid_pixels FROM ro""",
)
def mosaic_robustness(v):
    digits = {"mean_difference": 7, "std_difference": 6, "mean_valid_pixels": 7, "std_valid_pixels": 6}
    return robustness_of(v).withColumns({c: rnd(c, d) for c, d in digits.items()})


@query(
    "optimal_scene_count",
    f"""WITH {ROBUST_SQL}, l AS (SELECT *, lead(n_scenes) OVER w AS nx, lead(mean_difference) OVER w AS dx FROM ro
      WINDOW w AS (PARTITION BY tile, yr ORDER BY n_scenes))
    SELECT tile, yr, COALESCE(min(CASE WHEN nx IS NOT NULL AND mean_difference <> 0 AND (mean_difference - dx) / mean_difference < 5e-2
      THEN n_scenes END), max(n_scenes)) AS optimal_n FROM l GROUP BY tile, yr""",
)
def optimal_scene_count(v):
    return series.diminishing_returns(robustness_of(v), ["tile", "yr"], "n_scenes", "mean_difference")


def long_bands(v):
    return v.scenes.unpivot(["yr"], ["red", "nir"], "band", "value")


LONG_SQL = """lb AS (SELECT yr, 'red' AS band, red AS value FROM fx_scenes UNION ALL SELECT yr, 'nir', nir FROM fx_scenes)"""


@query(
    "band_stats",
    f"""WITH {LONG_SQL} SELECT yr, band, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 7) AS median,
    round(quantile_cont(value, 0.25), 7) AS q25, round(quantile_cont(value, 0.75), 7) AS q75, round(min(value), 6) AS min,
    round(max(value), 6) AS max FROM lb GROUP BY yr, band""",
)
def band_stats(v):
    digits = {"mean": 6, "std": 6, "median": 7, "q25": 7, "q75": 7, "min": 6, "max": 6}
    return distributions.summary(long_bands(v), ["yr", "band"], "value").withColumns(
        {c: rnd(c, d) for c, d in digits.items()}
    )


@query(
    "ks_two_sample",
    f"""WITH {LONG_SQL}, yy AS (SELECT yr AS year1, lead(yr) OVER (ORDER BY yr) AS year2 FROM (SELECT DISTINCT yr FROM lb) q),
    u AS (SELECT band, year1, year2, value, sum(CASE WHEN yr = year1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN yr = year2 THEN 1 ELSE 0 END) AS b
      FROM lb JOIN yy ON yr = year1 OR yr = year2 WHERE year2 IS NOT NULL GROUP BY band, year1, year2, value),
    k AS (SELECT band, year1, year2, sum(a) OVER w / CAST(sum(a) OVER g AS DOUBLE) AS f1, sum(b) OVER w / CAST(sum(b) OVER g AS DOUBLE) AS f2,
      sum(a) OVER g AS n1, sum(b) OVER g AS n2 FROM u WINDOW w AS (PARTITION BY band, year1, year2 ORDER BY value), g AS (PARTITION BY band, year1, year2)),
    d AS (SELECT band, year1, year2, max(abs(f1 - f2)) AS ks, CAST(max(n1) AS DOUBLE) AS n1, CAST(max(n2) AS DOUBLE) AS n2 FROM k GROUP BY band, year1, year2)
    SELECT band, year1, year2, round(ks, 9) AS ks_statistic, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
    round(CASE WHEN ks = 0 THEN 1 ELSE greatest(1 - sqrt(2e0 * pi()) / (ks * sqrt(n1 * n2 / (n1 + n2)))
      * list_sum(list_transform(range(1, 4000, 2), lambda i: exp(-1e0 * i * i * pi() * pi() * (n1 + n2) / (8e0 * n1 * n2 * ks * ks)))), 0) END, 7) AS p_value FROM d""",
)
def ks_two_sample(v):
    tested = distributions.ks_consecutive(long_bands(v), ["band"], "yr", "value", staged=True)
    return tested.withColumns({"ks_statistic": rnd("ks_statistic", 9), "p_value": rnd("p_value", 7)})


@query(
    "all_band_valid",
    """SELECT tile, count(*) AS n, count(CASE WHEN px % 10 <> 0 AND px % 7 <> 3 THEN 1 END) AS n_valid FROM fx_scenes GROUP BY tile""",
)
def all_band_valid(v):
    holes = v.scenes.withColumns(
        {
            "red": F.when(F.col("px") % 10 == 0, 0.0).otherwise(F.col("red")),
            "nir": F.when(F.col("px") % 7 == 3, 0.0).otherwise(F.col("nir")),
        }
    )
    valid = masks.all_bands_valid(["red", "nir"])
    return holes.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"))


@query(
    "normalize_samples",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 0 ELSE round(l_extendedprice / 1e4, 9) END AS band,
    round(CASE WHEN t > 60 OR t = -9999 THEN -1 ELSE t END, 9) AS height,
    round(CASE WHEN t > 60 OR t = -9999 THEN -1 ELSE ln(1e0 + t) END, 9) AS height_log,
    round(CASE WHEN t > 60 OR t = -9999 THEN -1 ELSE exp(ln(1e0 + t)) - 1e0 END, 7) AS height_back
    FROM (SELECT *, CASE WHEN l_linenumber = 5 THEN -9999e0 ELSE l_quantity * 13e-1 END AS t FROM lineitem) q""",
)
def normalize_samples(v):
    """Band scaled unless nodata; height outliers and the sentinel to -1; log heights and back."""
    rows = v.t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 3, 0.0).otherwise(F.col("l_extendedprice")).alias("raw"),
        F.when(F.col("l_linenumber") == 5, NODATA).otherwise(F.col("l_quantity") * 1.3).alias("t"),
    )
    gone = (F.col("t") > 60) | masks.is_close(F.col("t"), NODATA)
    height = F.when(gone, -1.0).otherwise(F.col("t"))
    logged = F.when(gone, -1.0).otherwise(F.log1p("t"))
    back = F.when(gone, -1.0).otherwise(F.expm1(F.log1p("t")))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("raw") != 0, F.round(F.col("raw") / 1e4, 9)).otherwise(F.col("raw")).alias("band"),
        rnd(height, 9, "height"),
        rnd(logged, 9, "height_log"),
        rnd(back, 7, "height_back"),
    )


# --- height layers -----------------------------------------------------------

RAW_SQL = """hl AS (SELECT cell, r, c, yr, CASE WHEN cell % 23 = 0 THEN -9999e0 ELSE height * 14e-1 - 5e0 END AS h FROM fx_cells)"""


def raw_heights(v):
    h = F.when(F.col("cell") % 23 == 0, NODATA).otherwise(F.col("height") * 1.4 - 5.0)
    return v.cells.select("cell", "r", "c", "yr", h.alias("h"))


@query(
    "flag_outliers",
    f"""WITH {RAW_SQL} SELECT cell, yr, abs(h + 9999) <= 9999e-5 + 1e-8 AS is_nodata,
    (h > 60 OR h < 0) AND NOT abs(h + 9999) <= 9999e-5 + 1e-8 AS is_outlier FROM hl""",
)
def flag_outliers(v):
    h = F.col("h")
    return raw_heights(v).select(
        "cell", "yr", masks.is_close(h, NODATA).alias("is_nodata"), masks.is_outlier(h, NODATA).alias("is_outlier")
    )


@query(
    "sanitize_report",
    f"""WITH {RAW_SQL}, s AS (SELECT yr, CASE WHEN h > -9000 THEN h END AS a, CASE WHEN h BETWEEN 0 AND 60 THEN h END AS b FROM hl)
    SELECT yr, count(a) AS n_before, round(min(a), 7) AS min_before, round(max(a), 7) AS max_before, round(avg(a), 7) AS mean_before,
    round(stddev_pop(a), 7) AS std_before, count(b) AS n_after, round(min(b), 7) AS min_after, round(max(b), 7) AS max_after,
    round(avg(b), 7) AS mean_after, round(stddev_pop(b), 7) AS std_after, round(1e2 * (count(a) - count(b)) / count(a), 7) AS pct_outlier,
    round(1e2 * count(CASE WHEN a < 0 THEN 1 END) / count(a), 7) AS pct_negative FROM s GROUP BY yr""",
)
def sanitize_report(v):
    h = F.col("h")
    state = raw_heights(v).select(
        "yr",
        F.when(~masks.is_close(h, NODATA), h).alias("before"),
        F.when(~masks.is_close(h, NODATA) & ~masks.is_outlier(h, NODATA), h).alias("after"),
    )
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    cols = [F.count(s).alias(f"n_{s}") for s in ("before", "after")]
    cols += [rnd(fn(s), 7, f"{name}_{s}") for s in ("before", "after") for name, fn in stats.items()]
    n = F.count("before")
    cols.append(rnd(F.try_divide(100.0 * (n - F.count("after")), n), 7, "pct_outlier"))
    cols.append(rnd(F.try_divide(100.0 * F.count_if(F.col("before") < 0), n), 7, "pct_negative"))
    return state.groupBy("yr").agg(*cols)


@query(
    "gap_fill",
    """WITH y AS (SELECT DISTINCT yr FROM fx_cells), k AS (SELECT DISTINCT cell FROM fx_cells),
    b AS (SELECT cell, yr, cell % 97 = 0 AND yr = 1997 AS nd, CASE WHEN (cell * 7 + yr) % 9 = 0 OR (cell % 97 = 0 AND yr = 1997) THEN NULL
      ELSE height END AS h FROM fx_cells),
    d AS (SELECT k.cell, y.yr, COALESCE(b.nd, FALSE) AS nd, b.h FROM k CROSS JOIN y LEFT JOIN b ON b.cell = k.cell AND b.yr = y.yr),
    w AS (SELECT *, lag(h) OVER o AS p, lead(h) OVER o AS n, bool_or(nd) OVER (PARTITION BY cell) AS any_nd, min(yr) OVER (PARTITION BY cell) AS y0,
      max(yr) OVER (PARTITION BY cell) AS y1 FROM d WINDOW o AS (PARTITION BY cell ORDER BY yr)),
    f AS (SELECT *, CASE WHEN any_nd THEN NULL WHEN yr = y0 THEN n WHEN yr = y1 THEN p ELSE (p + n) / 2 END AS fill FROM w)
    SELECT cell, yr, round(COALESCE(h, CASE WHEN NOT nd THEN fill END), 9) AS height,
    CAST(CASE WHEN nd THEN 1 WHEN h IS NOT NULL THEN 0 WHEN fill IS NOT NULL THEN 2 ELSE 3 END AS INT) AS source FROM f""",
)
def gap_fill(v):
    nodata = (F.col("cell") % 97 == 0) & (F.col("yr") == 1997)
    removed = (F.col("cell") * 7 + F.col("yr")) % 9 == 0
    layer = v.cells.select(
        "cell", "yr", nodata.alias("is_nodata"), F.when(~(removed | nodata), F.col("height")).alias("height")
    )
    return composite.gap_fill(layer, "cell", "height", "is_nodata").withColumn("height", rnd("height", 9))


@query(
    "downsample_average",
    """SELECT yr, CAST(floor(r / 5e0) AS INT) AS r, CAST(floor(c / 5e0) AS INT) AS c, round(avg(height), 8) AS height, count(height) AS n_valid
    FROM fx_cells GROUP BY yr, floor(r / 5e0), floor(c / 5e0)""",
)
def downsample_average(v):
    cells = v.cells.select("yr", "r", "c", "height")
    return composite.block_average(cells, ["yr"], "height", 5).withColumn("height", rnd("height", 8))


@query(
    "merge_first",
    """SELECT cell, yr, v AS value FROM (SELECT CAST(l_partkey AS INT) AS cell, CAST(year(l_shipdate) AS INT) AS yr, l_extendedprice AS v,
    row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_linenumber, l_orderkey, l_extendedprice) AS k FROM lineitem
    WHERE l_returnflag <> 'R') q WHERE k = 1""",
)
def merge_first(v):
    layers = v.t("lineitem").select(
        F.col("l_partkey").cast("int").alias("cell"),
        F.year("l_shipdate").alias("yr"),
        "l_linenumber",
        "l_orderkey",
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("value"),
    )
    return composite.merge_first(layers, ["cell", "yr"], "value", ["l_linenumber", "l_orderkey", "value"])


@query(
    "merge_overlap_mean",
    """SELECT CAST(l_partkey AS INT) AS cell, CAST(year(l_shipdate) AS INT) AS yr, round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*), 9) AS value,
    count(*) AS n_layers FROM lineitem GROUP BY l_partkey, year(l_shipdate)""",
)
def merge_overlap_mean(v):
    layers = v.t("lineitem").select(
        F.col("l_partkey").cast("int").alias("cell"), F.year("l_shipdate").alias("yr"), F.col("l_quantity").alias("value")
    )
    return composite.merge_mean(layers, ["cell", "yr"], "value").withColumn("value", rnd("value", 9))


@query(
    "coverage_map",
    """WITH t AS (SELECT DISTINCT floor(r / 4e0) AS tr, floor(c / 4e0) AS tc FROM fx_grid),
    h AS (SELECT floor(r / 4e0) AS tr, floor(c / 4e0) AS tc, bool_or(height > 45) AS covered FROM fx_cells GROUP BY 1, 2)
    SELECT CAST(tr AS INT) AS tr, count(*) AS n_targets, count(CASE WHEN covered THEN 1 END) AS n_covered,
    round(1e2 * count(CASE WHEN covered THEN 1 END) / count(*), 6) AS covered_pct FROM t LEFT JOIN h USING (tr, tc) GROUP BY tr""",
)
def coverage_map(v):
    flags = composite.coverage(v.cells, v.grid, F.col("height") > 45, 4)
    n = F.count(F.lit(1))
    return flags.groupBy("tr").agg(
        n.alias("n_targets"),
        F.count_if("covered").alias("n_covered"),
        rnd(100.0 * F.count_if("covered") / n, 6, "covered_pct"),
    )


@query(
    "combined_bounds",
    """SELECT min(x) - 50 AS x_left, min(y) - 50 AS y_bottom, max(x) + 50 AS x_right, max(y) + 50 AS y_top,
    CAST(ceil((max(x) - min(x) + 100) / 25e1) AS BIGINT) AS width, CAST(ceil((max(y) - min(y) + 100) / 25e1) AS BIGINT) AS height FROM fx_grid""",
)
def combined_bounds(v):
    return composite.combined_bounds(v.grid, 50.0, 250.0)


# --- catalogs ----------------------------------------------------------------


@query(
    "catalog_search_relax",
    """WITH i AS (SELECT * FROM fx_catalog WHERE tile BETWEEN 2 AND 17 AND month(item_date) BETWEEN 5 AND 9),
    caps AS (SELECT unnest([1, 11, 21, 31, 41, 51, 61]) AS cap),
    n AS (SELECT tile, yr, cap, count(CASE WHEN cloud < cap THEN 1 END) AS n FROM i, caps GROUP BY tile, yr, cap),
    s AS (SELECT tile, yr, COALESCE(min(CASE WHEN n >= 12 THEN cap END), 61) AS cap FROM n GROUP BY tile, yr)
    SELECT i.tile, i.yr, CAST(cap AS INT) AS cloud_limit, count(*) AS n_items, CAST(sum(item_id) AS BIGINT) AS id_sum
    FROM i JOIN s ON i.tile = s.tile AND i.yr = s.yr AND cloud < cap GROUP BY i.tile, i.yr, cap""",
)
def catalog_search_relax(v):
    items = v.catalog.where(F.col("tile").between(2, 17) & F.month("item_date").between(5, 9))
    found = catalog.relaxed_search(items, ["tile", "yr"], "cloud", start=1, step=10, least=12, cap=61)
    return found.groupBy("tile", "yr", "cloud_limit").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("item_id").alias("id_sum")
    )


@query(
    "parse_tile_paths",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderkey % 1800 - 900 AS DOUBLE) / 1e1 AS lat,
    CAST(o_orderkey * 7 % 3600 - 1800 AS DOUBLE) / 1e1 AS lon, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 60 AS INT) END AS code FROM orders""",
)
def parse_tile_paths(v):
    lat10, lon10 = F.col("o_orderkey") % 1800 - 900, F.col("o_orderkey") * 7 % 3600 - 1800

    def degrees(tenths, positive, negative):
        side = F.when(tenths >= 0, positive).otherwise(negative)
        return F.concat(side, F.format_string("%d.%d", F.floor(F.abs(tenths) / 10), F.abs(tenths) % 10))

    tail = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("_code"), (F.col("o_custkey") % 60).cast("string")))
    path = F.concat(
        F.lit("/maps/canopy_height_"),
        F.year("o_orderdate").cast("string"),
        F.lit("_"),
        degrees(lat10, "N", "S"),
        F.lit("_"),
        degrees(lon10, "E", "W"),
        F.coalesce(tail, F.lit("")),
        F.lit(".tif"),
    )
    files = v.t("orders").select("o_orderkey", path.alias("path"))
    return files.withColumns(catalog.parse_height_path("path")).drop("path")


@query(
    "parse_product_paths",
    """SELECT CASE o_orderkey % 6 WHEN 0 THEN 'mask' WHEN 1 THEN 'height' WHEN 2 THEN 'biomass' WHEN 3 THEN 'mosaic' WHEN 4 THEN 'other' END AS product,
    CASE WHEN o_orderkey % 6 < 5 THEN CAST(year(o_orderdate) AS INT) END AS year, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 60 AS INT) END AS code,
    count(*) AS n_files, CAST(sum(CASE o_orderkey % 6 WHEN 0 THEN 30 WHEN 1 THEN 23 WHEN 2 THEN 28 WHEN 3 THEN 39 WHEN 4 THEN 14 ELSE 5 END) AS BIGINT) AS name_length
    FROM orders GROUP BY 1, 2, 3""",
)
def parse_product_paths(v):
    """Files of all products, named by their patterns, and some that fit none."""
    year = F.date_format("o_orderdate", "yyyy")
    kind = F.col("o_orderkey") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("canopy_height_"), year, F.lit("_100m_forest_code"), (F.col("o_custkey") % 60).cast("string")))
        .when(kind == 1, F.concat(F.lit("canopy_height_"), year, F.lit("_100m")))
        .when(kind == 2, F.concat(F.lit("TBD_S2_mean_"), year, F.lit("_100m_merged")))
        .when(kind == 3, F.concat(F.lit("s2_SUMMER_mosaic_"), year, F.lit("_north_downsampled")))
        .when(kind == 4, F.concat(F.lit("AGBD_"), year, F.lit("_mean")))
        .otherwise("notes")
    )
    files = v.t("orders").select(F.concat(F.lit("/data/"), name, F.lit(".tif")).alias("path"))
    parsed = files.select(*[c.alias(n) for n, c in catalog.parse_product_path("path").items()])
    return parsed.groupBy("product", "year", "code").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.length("base_name")).alias("name_length")
    )


@query(
    "parse_sample_keys",
    """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'TBD' WHEN 1 THEN 'AGBD_raw' ELSE 'TBD' END AS biomass_type, CAST(year(o_orderdate) AS INT) AS year,
    count(*) AS n_samples, round(CAST(sum(CAST(round(o_totalprice * 1e2) AS BIGINT)) AS DOUBLE) / 1e2, 2) AS total FROM orders GROUP BY 1, 2""",
)
def parse_sample_keys(v):
    year = F.year("o_orderdate").cast("string")
    key = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("TBD_"), year))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("AGBD_raw_"), year))
        .otherwise(year)
    )
    cents = F.round(F.col("o_totalprice") * 1e2).cast("bigint")
    samples = v.t("orders").select(key.alias("key"), cents.alias("cents"))
    return (
        samples.withColumns(catalog.parse_sample_key("key"))
        .groupBy("biomass_type", "year")
        .agg(F.count(F.lit(1)).alias("n_samples"), rnd(F.sum("cents").cast("double") / 1e2, 2, "total"))
    )


@query(
    "latest_artifact",
    """SELECT kind, path FROM (SELECT o_orderpriority AS kind, concat('mc_', strftime(o_orderdate, '%Y%m%d'), '_', CAST(o_orderkey AS VARCHAR), '.npz') AS path,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) q WHERE k = 1""",
)
def latest_artifact(v):
    path = F.concat(
        F.lit("mc_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".npz")
    )
    files = v.t("orders").select(F.col("o_orderpriority").alias("kind"), "o_orderdate", "o_orderkey", path.alias("path"))
    return catalog.latest(files, "kind", ["o_orderdate", "o_orderkey"], "path")


def tile_files(v):
    """One file per customer location and year."""
    return v.t("orders").select("o_custkey", F.year("o_orderdate").alias("yr")).distinct()


FILES_SQL = """tf AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS yr FROM orders),
    ex AS (SELECT o_custkey, yr FROM (SELECT DISTINCT o_custkey FROM tf) a CROSS JOIN (SELECT DISTINCT yr FROM tf) b)"""


@query("work_plan", f"WITH {FILES_SQL} SELECT o_custkey, yr FROM ex")
def work_plan(v):
    files = tile_files(v)
    return catalog.with_all_years(files.select("o_custkey").distinct(), files)


@query("pending_work", f"WITH {FILES_SQL} SELECT o_custkey, yr FROM ex EXCEPT SELECT o_custkey, yr FROM tf")
def pending_work(v):
    files = tile_files(v)
    plan = catalog.with_all_years(files.select("o_custkey").distinct(), files)
    return plan.join(files, ["o_custkey", "yr"], "left_anti")


@query(
    "missing_tiles",
    f"""WITH {FILES_SQL} SELECT o_custkey, count(*) AS n_missing, string_agg(CAST(yr AS VARCHAR), ',' ORDER BY yr) AS missing_years
    FROM (SELECT o_custkey, yr FROM ex EXCEPT SELECT o_custkey, yr FROM tf) q GROUP BY o_custkey""",
)
def missing_tiles(v):
    gaps = catalog.missing_years(tile_files(v), "o_custkey").where(F.size("missing") > 0)
    joined = F.array_join(F.col("missing").cast("array<string>"), ",")
    return gaps.select("o_custkey", F.size("missing").cast("bigint").alias("n_missing"), joined.alias("missing_years"))


@query(
    "completeness_report",
    f"""WITH {FILES_SQL} SELECT count(DISTINCT ex.o_custkey) AS total_locations, count(DISTINCT ex.yr) AS total_years, count(*) AS total_expected,
    count(tf.yr) AS total_existing, count(*) - count(tf.yr) AS total_missing, round(count(tf.yr) / CAST(count(*) AS DOUBLE) * 1e2, 9) AS completeness_rate
    FROM ex LEFT JOIN tf ON tf.o_custkey = ex.o_custkey AND tf.yr = ex.yr""",
)
def completeness_report(v):
    report = catalog.completeness(catalog.missing_years(tile_files(v), "o_custkey"))
    return report.withColumn("completeness_rate", rnd("completeness_rate", 9))


# --- sinks -------------------------------------------------------------------


@query(
    "write_partitioned",
    """SELECT variable, yr, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT yr, 'height' AS variable, height AS value FROM fx_cells
    UNION ALL SELECT yr, 'tbd', tbd FROM fx_cells UNION ALL SELECT yr, 'tbd_unc', tbd_unc FROM fx_cells) q GROUP BY variable, yr""",
)
def write_partitioned(v):
    """Cell layers written below variable and year, then read back through the partitions."""
    long = v.cells.unpivot(["cell", "r", "c", "yr"], ["height", "tbd", "tbd_unc"], "variable", "value")
    path = tables.write_skewed(long, scratch(v.spark, "layers"), ["variable", "yr"], "cell", 4)
    back = v.spark.read.parquet(path)
    return back.groupBy("variable", "yr").agg(F.count("value").alias("n"), rnd(F.sum("value"), 4, "total"))


@query(
    "store_transitions",
    f"""WITH {PAIRS_SQL} SELECT year1, year2, count(*) AS n_valid_pixels, round(sum(b1), 4) AS biomass_y1, round(sum(b2), 4) AS biomass_y2,
    round(sum(b2 - b1), 4) AS raw_diff FROM pr GROUP BY year1, year2""",
)
def store_transitions(v):
    """Every transition of a cell written below its period, read back and summed up."""
    pairs = change.transition_pairs(v.cells).withColumn("raw_diff", F.col("b2") - F.col("b1"))
    path = tables.write_skewed(pairs, scratch(v.spark, "transitions"), ["year1", "year2"], "cell", 4)
    back = v.spark.read.schema(pairs.schema).parquet(path)
    sums = [rnd(F.sum(c), 4, n) for c, n in (("b1", "biomass_y1"), ("b2", "biomass_y2"), ("raw_diff", "raw_diff"))]
    return back.groupBy("year1", "year2").agg(F.count(F.lit(1)).alias("n_valid_pixels"), *sums)


@query(
    "write_result_table",
    """SELECT CAST(yr AS INT) AS yr, count(*) AS n_cells, round(sum(tbd), 4) AS total FROM fx_cells GROUP BY yr""",
)
def write_result_table(v):
    """The table of annual sums written as one CSV file with a header, then read back."""
    sums = v.cells.groupBy("yr").agg(F.count(F.lit(1)).alias("n_cells"), rnd(F.sum("tbd"), 4, "total"))
    path = tables.write_table(sums, scratch(v.spark, "sums"))
    return v.spark.read.schema(sums.schema).option("header", True).csv(path)


@query(
    "export_stratified",
    """SELECT CAST(28 + provincia % 4 AS INT) AS utm, yr, count(*) AS n_plots, CAST(sum(estadillo) AS BIGINT) AS id_sum FROM fx_plots GROUP BY 1, yr""",
)
def export_stratified(v):
    plots = v.plots.withColumn("utm", F.col("provincia") % 4 + 28)
    path = tables.write_skewed(plots, scratch(v.spark, "plots"), ["utm", "yr"], "estadillo", 4)
    back = v.spark.read.schema(plots.schema).parquet(path)
    return back.groupBy("utm", "yr").agg(F.count(F.lit(1)).alias("n_plots"), F.sum("estadillo").alias("id_sum"))
