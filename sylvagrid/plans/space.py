"""Grids, regridding and spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions import projection
from sylvagrid.functions.text import rnd
from sylvagrid.operators import composite, grid, ranking, series, variogram
from sylvagrid.operators.zonal import bin_label
from sylvagrid.plans.registry import query, uniform_sql
from sylvagrid.plans.stocks import HEIGHT_CASE, HEIGHT_EDGES, HEIGHT_LABELS
from sylvagrid.session import stage

X0, Y0, RES = 5e5, 45e5, 100.0


@query(
    "cell_coordinates",
    """SELECT cell, x AS x_centre, y AS y_centre, x - 50 AS x_corner, y + 50 AS y_corner, r AS r_back, c AS c_back FROM fx_grid""",
)
def cell_coordinates(v):
    centre = grid.cell_centre(F.col("r"), F.col("c"), X0, Y0, RES)
    corner = grid.cell_corner(F.col("r"), F.col("c"), X0, Y0, RES)
    placed = v.grid.select(
        "cell", *[p.alias(n) for p, n in zip((*centre, *corner), ("x_centre", "y_centre", "x_corner", "y_corner"))]
    )
    r, c = grid.cell_index(F.col("x_centre"), F.col("y_centre"), X0, Y0, RES)
    return placed.withColumns({"r_back": r, "c_back": c})


def tile_sql(size):
    return f"""bo AS (SELECT min(x) - 50 AS l, max(x) + 50 AS rt, min(y) - 50 AS bt, max(y) + 50 AS tp FROM fx_grid),
    tg AS (SELECT CAST(tr AS INT) AS tr, CAST(tc AS INT) AS tc, l + tc * {size}e0 AS x_min, least(l + (tc + 1) * {size}e0, rt) AS x_max,
      greatest(tp - (tr + 1) * {size}e0, bt) AS y_min, tp - tr * {size}e0 AS y_max FROM
      (SELECT *, unnest(range(CAST(ceil((rt - l) / {size}e0) AS BIGINT))) AS tc FROM (SELECT *, unnest(range(CAST(ceil((tp - bt) / {size}e0) AS BIGINT))) AS tr FROM bo) q) p)"""


def tiles_of(v, size):
    return grid.tile_grid(composite.combined_bounds(v.grid, RES / 2, size).drop("width", "height"), size)


@query("tile_grid", f"WITH {tile_sql(700)} SELECT * FROM tg")
def tile_grid(v):
    return tiles_of(v, 700.0)


@query(
    "sliding_patches",
    """SELECT CAST(pr AS INT) AS pr, CAST(pc AS INT) AS pc, yr, count(*) AS n_cells, round(avg(height), 8) AS mean_height FROM fx_cells,
    (SELECT unnest(range(0, 2000)) AS pr) a, (SELECT unnest(range(0, 10)) AS pc) b
    WHERE r >= pr * 8 AND r < pr * 8 + 16 AND c >= pc * 8 AND c < pc * 8 + 16 GROUP BY pr, pc, yr""",
)
def sliding_patches(v):
    windows = grid.covering_windows(v.cells.select("r", "c", "yr", "height"), size=16, stride=8)
    return windows.groupBy("pr", "pc", "yr").agg(
        F.count(F.lit(1)).alias("n_cells"), rnd(F.avg("height"), 8, "mean_height")
    )


@query(
    "regrid_nearest",
    f"""WITH {tile_sql(250)} SELECT tr, tc, landcover FROM tg JOIN fx_grid g ON g.r = CAST(floor((45e5 - (y_min + y_max) / 2) / 1e2) AS INT)
    AND g.c = CAST(floor(((x_min + x_max) / 2 - 5e5) / 1e2) AS INT)""",
)
def regrid_nearest(v):
    return grid.regrid_nearest(tiles_of(v, 250.0), v.grid, "landcover", X0, Y0, RES)


@query(
    "regrid_bilinear",
    f"""WITH {tile_sql(230)}, p AS (SELECT tr, tc, ((x_min + x_max) / 2 - 5e5) / 1e2 - 5e-1 AS px, (45e5 - (y_min + y_max) / 2) / 1e2 - 5e-1 AS py FROM tg),
    n AS (SELECT tr, tc, floor(py) + dr AS r, floor(px) + dc AS c, (CASE WHEN dr = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END)
      * (CASE WHEN dc = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) AS w FROM p, (SELECT unnest([0, 1]) AS dr) a, (SELECT unnest([0, 1]) AS dc) b)
    SELECT yr, tr, tc, round(sum(w * height) / sum(w), 8) AS height FROM n JOIN fx_cells k ON k.r = n.r AND k.c = n.c WHERE w > 0 GROUP BY yr, tr, tc""",
)
def regrid_bilinear(v):
    out = grid.regrid_bilinear(tiles_of(v, 230.0), v.cells, "height", X0, Y0, RES, keys=["yr"])
    return out.withColumn("height", rnd("height", 8))


@query(
    "grid_check",
    """WITH k AS (SELECT * REPLACE (CASE WHEN yr = 1998 THEN r + 1 ELSE r END AS r) FROM fx_cells)
    SELECT yr, min(k.r) AS r_min, max(k.r) AS r_max, min(k.c) AS c_min, max(k.c) AS c_max, count(*) AS n_cells,
    (SELECT count(*) FROM fx_grid) - count(*) AS n_missing, min(k.r) = (SELECT min(r) FROM fx_grid) AND max(k.r) = (SELECT max(r) FROM fx_grid)
    AND min(k.c) = (SELECT min(c) FROM fx_grid) AND max(k.c) = (SELECT max(c) FROM fx_grid) AS aligned FROM k GROUP BY yr""",
)
def grid_check(v):
    # one layer lies a row too low
    layers = v.cells.withColumn("r", F.when(F.col("yr") == 1998, F.col("r") + 1).otherwise(F.col("r")))
    return grid.grid_check(layers, "yr", v.grid)


@query(
    "wrap_longitude",
    """SELECT cell, yr, round(x - floor((x + 18e1) / 36e1) * 36e1, 9) AS lon FROM (SELECT cell, yr, cell * 37 % 3600 / 1e1 AS x FROM fx_cells) q""",
)
def wrap_longitude(v):
    lon = grid.wrap_longitude(F.col("cell") * 37 % 3600 / 10.0)
    return v.cells.select("cell", "yr", rnd(lon, 9, "lon"))


@query(
    "estimate_resolution",
    """WITH k AS (SELECT yr, c * 12e-4 * (yr - 1994) - 9 AS lon, 43 - r * 9e-4 * (yr - 1994) AS lat FROM fx_cells),
    e AS (SELECT yr, ((max(lon) - min(lon)) / (count(DISTINCT lon) - 1) * 85e3 + (max(lat) - min(lat)) / (count(DISTINCT lat) - 1) * 111e3) / 2 AS e FROM k GROUP BY yr)
    SELECT yr, round(e, 6) AS estimate, round_even(e / CASE WHEN e < 100 THEN 10e0 WHEN e < 1000 THEN 100e0 ELSE 1000e0 END, 0)
    * CASE WHEN e < 100 THEN 10e0 WHEN e < 1000 THEN 100e0 ELSE 1000e0 END AS resolution FROM e""",
)
def estimate_resolution(v):
    scale = F.col("yr") - 1994
    degrees = v.cells.select(
        "yr", (F.col("c") * 12e-4 * scale - 9.0).alias("lon"), (43.0 - F.col("r") * 9e-4 * scale).alias("lat")
    )
    return grid.estimated_resolution(degrees, ["yr"], "lon", "lat").withColumn("estimate", rnd("estimate", 6))


def series_sql(coefficients, outer, inner, x, y):
    return " + ".join(f"{c!r} * {outer}({2.0 * j} * {x}) * {inner}({2.0 * j} * {y})" for j, c in enumerate(coefficients, 1))


@query(
    "reproject_utm",
    f"""WITH g AS (SELECT estadillo, -9e0 + estadillo % 1200 / 1e2 AS lon, 36e0 + estadillo * 7 % 800 / 1e2 AS lat FROM fx_plots),
    z AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone, radians(lat) AS phi FROM g),
    t AS (SELECT *, radians(lon) - radians(zone * 6e0 - 183) AS dl, sinh(atanh(sin(phi)) - {projection.ECC!r} * atanh({projection.ECC!r} * sin(phi))) AS t FROM z),
    u AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT estadillo, zone, round(500000 + {projection.SCALE * projection.RADIUS!r} * (eta + {series_sql(projection.ALPHA, "cos", "sinh", "xi", "eta")}), 3) AS easting,
    round({projection.SCALE * projection.RADIUS!r} * (xi + {series_sql(projection.ALPHA, "sin", "cosh", "xi", "eta")}), 3) AS northing,
    round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM u""",
)
def reproject_utm(v):
    """Degrees to UTM of their zone and back again."""
    degrees = v.plots.select(
        "estadillo",
        (F.lit(-9.0) + F.col("estadillo") % 1200 / 1e2).alias("lon"),
        (F.lit(36.0) + F.col("estadillo") * 7 % 800 / 1e2).alias("lat"),
    ).withColumn("zone", projection.utm_zone(F.col("lon")))
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    there = degrees.select("estadillo", "zone", east.alias("easting"), north.alias("northing"))
    lon, lat = projection.from_utm(F.col("easting"), F.col("northing"), F.col("zone"))
    return there.select(
        "estadillo", "zone", rnd("easting", 3), rnd("northing", 3), rnd(lon, 7, "lon_back"), rnd(lat, 7, "lat_back")
    )


# --- sampling ----------------------------------------------------------------


@query(
    "sample_fixed",
    f"""SELECT cell, yr FROM fx_cells ORDER BY {uniform_sql(11, "cell, yr")}, cell, yr LIMIT 1000""",
)
def sample_fixed(v):
    return ranking.sample_exact(v.cells.select("cell", "yr"), [], ["cell", "yr"], 1000, 11)


@query(
    "sample_per_bin",
    f"""SELECT height_bin, cell, yr FROM (SELECT *, row_number() OVER (PARTITION BY height_bin ORDER BY {uniform_sql(13, "height_bin, cell, yr")}, cell, yr) AS k
    FROM (SELECT cell, yr, {HEIGHT_CASE} AS height_bin FROM fx_cells) q) p WHERE k <= 300""",
)
def sample_per_bin(v):
    binned = v.cells.select("cell", "yr", bin_label(F.col("height"), HEIGHT_EDGES, HEIGHT_LABELS).alias("height_bin"))
    return ranking.sample_exact(binned, ["height_bin"], ["cell", "yr"], 300, 13).select("height_bin", "cell", "yr")


# --- variograms --------------------------------------------------------------

# reference points per year as the method has it (all cells, if fewer), and the reach of their pairs: 200 cells of 100 m
REFERENCES, REACH, SIZE, BINS = 100_000, 200, 100.0, 8
LAG_SQL = f"""va AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY {uniform_sql(17, "yr, r, c")}, r, c) AS o FROM fx_cells),
    lg AS (SELECT yr, sqrt(lag * {SIZE!r} * {SIZE!r}) AS distance, count(*) AS n_pairs, sum(gamma) AS gamma_sum FROM
      (SELECT a.yr, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS lag, 5e-1 * (a.tbd - b.tbd) * (a.tbd - b.tbd) AS gamma
      FROM va a JOIN va b ON a.yr = b.yr AND a.o <= {REFERENCES} AND (a.r <> b.r OR a.c <> b.c)) q WHERE lag <= {REACH} * {REACH} GROUP BY yr, lag)"""
CURVE_SQL = f"""{LAG_SQL}, ww AS (SELECT yr, max(distance) / {BINS} AS w FROM lg GROUP BY yr),
    cu AS (SELECT lg.yr, CAST(least(floor(distance / w), {BINS - 1}) AS INT) AS bin, sum(gamma_sum) / sum(n_pairs) AS semivariance,
      CAST(sum(n_pairs) AS BIGINT) AS n_pairs, (CAST(least(floor(distance / w), {BINS - 1}) AS INT) + 5e-1) * max(w) AS distance
      FROM lg JOIN ww ON ww.yr = lg.yr GROUP BY lg.yr, 2)"""


def lags_of(v):
    sums = variogram.lag_sums(v.cells.select("yr", "r", "c", "tbd"), ["yr"], "tbd", REACH, REFERENCES)
    return sums.select("yr", F.sqrt(F.col("lag") * SIZE * SIZE).alias("distance"), "n_pairs", "gamma_sum")


def curve_of(v):
    return variogram.binned(stage(lags_of(v), "lags"), ["yr"], BINS)


@query(
    "semivariogram_pairs",
    f"""WITH {LAG_SQL} SELECT yr, round(distance, 6) AS distance, n_pairs, round(gamma_sum / n_pairs, 4) AS semivariance FROM lg""",
)
def semivariogram_pairs(v):
    mean = F.col("gamma_sum") / F.col("n_pairs")
    return lags_of(v).select("yr", rnd("distance", 6), "n_pairs", rnd(mean, 4, "semivariance"))


@query(
    "semivariogram_bins",
    f"""WITH {CURVE_SQL} SELECT yr, bin, round(distance, 6) AS distance, round(semivariance, 6) AS semivariance, n_pairs FROM cu""",
)
def semivariogram_bins(v):
    return curve_of(v).select("yr", "bin", rnd("distance", 6), rnd("semivariance", 6), "n_pairs")


@query(
    "autocorrelation_range",
    f"""WITH {CURVE_SQL}, s AS (SELECT yr, max(semivariance) AS sill FROM cu GROUP BY yr)
    SELECT cu.yr, round(max(sill), 6) AS sill, round(max(CASE WHEN bin = 0 THEN semivariance ELSE 0 END), 6) AS nugget,
    round(min(CASE WHEN semivariance >= 95e-2 * sill THEN distance END), 6) AS range, round(max(distance), 6) AS max_distance,
    CAST(sum(n_pairs) AS BIGINT) AS n_pairs FROM cu JOIN s ON s.yr = cu.yr GROUP BY cu.yr""",
)
def autocorrelation_range(v):
    out = variogram.autocorrelation_range(curve_of(v), ["yr"])
    return out.withColumns({c: rnd(c, 6) for c in ("sill", "nugget", "range", "max_distance")})


RANGES = [float(r) for r in range(100, 20001, 400)]


@query(
    "variogram_fit",
    f"""WITH {CURVE_SQL}, tr AS (SELECT cu.*, rg, 1 - exp(-distance / rg) AS u FROM cu, (SELECT CAST(unnest({RANGES}) AS DOUBLE) AS rg) q),
    f0 AS (SELECT yr, rg, regr_intercept(semivariance, u) AS n0, regr_slope(semivariance, u) AS k0, sum(semivariance * u) / sum(u * u) AS k1 FROM tr GROUP BY yr, rg),
    f1 AS (SELECT yr, rg, greatest(n0, 0) AS n, greatest(CASE WHEN n0 < 0 THEN k1 ELSE k0 END, 0) AS k FROM f0),
    sc AS (SELECT tr.yr, tr.rg, n, k, sum((semivariance - n - k * u) * (semivariance - n - k * u)) AS sse FROM tr JOIN f1 ON f1.yr = tr.yr AND f1.rg = tr.rg GROUP BY tr.yr, tr.rg, n, k)
    SELECT yr, round(n, 4) AS nugget, round(n + k, 4) AS sill, rg AS range, round(sse, 2) AS sse FROM
    (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY round(sse, 6), rg) AS o FROM sc) q WHERE o = 1""",
)
def variogram_fit(v):
    fit = variogram.fit_exponential(stage(curve_of(v), "curve"), ["yr"], RANGES)
    return fit.select("yr", rnd("nugget", 4), rnd("sill", 4), "range", rnd("sse", 2))


@query(
    "knee_point",
    f"""WITH {CURVE_SQL}, n AS (SELECT *, (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) AS ux,
      (semivariance - min(semivariance) OVER w) / (max(semivariance) OVER w - min(semivariance) OVER w) AS uy FROM cu WINDOW w AS (PARTITION BY yr))
    SELECT yr, round(distance, 6) AS knee_x, round(semivariance, 6) AS knee_y, round(uy - ux, 8) AS knee_gap
    FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY round(uy - ux, 9) DESC, distance) AS o FROM n) q WHERE o = 1""",
)
def knee_point(v):
    found = series.knee(curve_of(v), ["yr"], "distance", "semivariance", increasing=True)
    return found.select("yr", rnd("knee_x", 6), rnd("knee_y", 6), rnd("knee_gap", 8))


CLUSTERS = 15
CLUSTER_SQL = f"""cg AS (SELECT *, CAST((floor(r / 1e1) * 5 + floor(c / 1e1)) % {CLUSTERS} AS INT) AS cluster_id FROM fx_grid),
    ce AS (SELECT cluster_id, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM cg GROUP BY cluster_id)"""


def clustered(v):
    block = F.floor(F.col("r") / 10) * 5 + F.floor(F.col("c") / 10)
    return v.grid.withColumn("cluster_id", (block % CLUSTERS).cast("int"))


@query(
    "cluster_quality",
    f"""WITH {CLUSTER_SQL}, rd AS (SELECT cg.cluster_id, quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 0.9) AS radius
      FROM cg JOIN ce ON ce.cluster_id = cg.cluster_id GROUP BY cg.cluster_id),
    sp AS (SELECT a.cluster_id, min(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS nearest,
      avg(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS sep FROM ce a JOIN ce b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)
    SELECT ce.cluster_id, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(radius, 6) AS radius, round(nearest, 6) AS nearest, round(sep, 6) AS mean_separation,
    (SELECT min(nearest) FROM sp) > 500 AS well_separated FROM ce JOIN rd ON rd.cluster_id = ce.cluster_id JOIN sp ON sp.cluster_id = ce.cluster_id""",
)
def cluster_quality(v):
    extent = stage(variogram.cluster_extent(clustered(v), "cluster_id"), "clusters")
    apart = variogram.cluster_separation(extent, "cluster_id")
    whole = F.min("nearest").over(W.partitionBy(F.lit(0))) > 500
    out = extent.join(apart, "cluster_id").withColumn("well_separated", whole)
    digits = {"cx": 5, "cy": 5, "radius": 6, "nearest": 6, "mean_separation": 6}
    return out.withColumns({c: rnd(c, d) for c, d in digits.items()})
