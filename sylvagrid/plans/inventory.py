"""Forest inventory: reading, plot assembly, spatial attributes, training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import inventory, masks, spatial
from sylvagrid.operators.ranking import exact_percentiles
from sylvagrid.plans.registry import query
from sylvagrid.session import scratch, stage
from sylvagrid.sources import tables

X0, Y0, RES = 5e5, 45e5, 100.0
BUCKET = 1000.0


# --- reading -----------------------------------------------------------------


@query(
    "scan_csv_codes",
    """SELECT CAST(p_partkey AS INT) AS code, p_name AS name FROM part
    WHERE p_partkey % 9 <> 0 AND p_name IS NOT NULL AND p_name <> ''""",
)
def scan_csv_codes(v):
    path = scratch(v.spark, "codes")
    name = F.when(F.col("p_partkey") % 9 != 0, F.col("p_name"))
    v.t("part").select(F.col("p_partkey").alias("code"), name.alias("name")).write.option("header", True).option(
        "sep", ";"
    ).csv(path)
    return tables.read_codes(v.spark, path, "code", "code string, name string")


def species_of(v):
    binomial = F.concat(F.col("genus"), F.lit(" s"), F.col("code").cast("string"))
    return v.types.select("code", binomial.alias("binomial"))


def densities_of(v):
    b = F.substring("p_brand", 7, 10).cast("int")
    binomial = F.concat(F.lit("G"), (b % 8).cast("string"), F.lit(" s"), b.cast("string"))
    density = F.when(F.col("p_partkey") % 17 != 0, (F.col("p_partkey") % 60 + 30).cast("double") / 1e2)
    # species that the lookup does not know
    other = F.when((b % 5 == 0) | (b % 8 == 7), F.lit("Other spp")).otherwise(binomial)
    return v.t("part").select(other.alias("binomial"), density.alias("density"))


DENSITY_SQL = """wd AS (SELECT CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 <> 0 AND CAST(substr(p_brand, 7) AS INT) % 8 <> 7 THEN CAST(substr(p_brand, 7) AS INT) END AS b,
      CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey % 60 + 30 AS DOUBLE) / 1e2 END AS density FROM part),
    ds AS (SELECT b, avg(density) AS d FROM wd WHERE b IS NOT NULL GROUP BY b),
    dg AS (SELECT b % 8 AS g, avg(density) AS d FROM wd WHERE b IS NOT NULL GROUP BY b % 8),
    dens AS (SELECT t.code, CASE WHEN ds.b IS NOT NULL THEN 'species' WHEN dg.g IS NOT NULL THEN 'genus' ELSE 'all' END AS level,
      CASE WHEN ds.b IS NOT NULL THEN ds.d WHEN dg.g IS NOT NULL THEN dg.d ELSE (SELECT avg(density) FROM wd) END AS density
      FROM fx_types t LEFT JOIN ds ON t.code = ds.b LEFT JOIN dg ON t.code % 8 = dg.g)"""


@query(
    "wood_density_fallback",
    f"""WITH {DENSITY_SQL} SELECT code AS especie, level, round(density, 9) AS density, count(*) AS n_rows,
    round(sum((vcc + vle) * density), 5) AS agb FROM fx_trees JOIN dens ON especie = code GROUP BY code, level, density""",
)
def wood_density_fallback(v):
    density = inventory.wood_density(species_of(v), densities_of(v))
    volume = v.trees.groupBy("especie").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("vcc") + F.col("vle")).alias("v"))
    return volume.join(density, F.col("especie") == F.col("code")).select(
        "especie", "level", rnd("density", 9), "n_rows", rnd(F.col("v") * F.col("density"), 5, "agb")
    )


EXTRACT_SQL = f"""{DENSITY_SQL},
    rows_ AS (SELECT t.estadillo, provincia, ba AS agb, br AS bgb FROM fx_trees t JOIN fx_plots p ON t.estadillo = p.estadillo
      WHERE provincia < 12 UNION ALL SELECT t.estadillo, provincia, (vcc + vle) * density, NULL
      FROM fx_trees t JOIN fx_plots p ON t.estadillo = p.estadillo LEFT JOIN dens ON especie = code WHERE provincia >= 12),
    tot AS (SELECT estadillo, provincia, COALESCE(sum(agb), 0) AS agb, COALESCE(sum(bgb), 0) AS bgb FROM rows_ a
      WHERE NOT EXISTS (SELECT 1 FROM rows_ b WHERE b.agb IS NULL AND b.estadillo = a.estadillo AND b.provincia = a.provincia)
      GROUP BY estadillo, provincia)"""


def extracted_rows(v):
    """Tree rows of all regions: provinces below 12 report biomass, the others volumes."""
    rows = v.trees.join(v.plots.select("estadillo", "provincia"), "estadillo")
    direct = rows.where("provincia < 12").select("estadillo", "provincia", "ba", "br")
    volumes = rows.where("provincia >= 12").select("estadillo", "provincia", "especie", "vcc", "vle")
    density = inventory.wood_density(species_of(v), densities_of(v))
    return tables.read_two_schemas(direct, volumes, density)


def extracted_totals(v):
    return inventory.plot_totals(extracted_rows(v), ["estadillo", "provincia"], complete=True)


@query(
    "inventory_extract",
    f"WITH {EXTRACT_SQL} SELECT estadillo, provincia, round(agb, 7) AS agb, round(bgb, 7) AS bgb FROM tot",
)
def inventory_extract(v):
    return extracted_totals(v).select("estadillo", "provincia", rnd("agb", 7), rnd("bgb", 7))


@query(
    "scan_polygons",
    """SELECT poly_id, label, round((x_max - x_min) * (y_max - y_min), 6) AS area FROM fx_polygons WHERE poly_id % 6 <> 0 AND poly_id % 7 <> 3
    UNION ALL SELECT p_partkey + 1000, 'unlabelled', 1e4 FROM part WHERE p_partkey % 4 <> 0""",
)
def scan_polygons(v):
    """A labelled layer with broken and crossing rings and a cell-footprint layer without labels."""
    crossing = F.array(*[F.get("ring", F.lit(i)) for i in (0, 2, 1, 3, 4)])
    ring = F.when(F.col("poly_id") % 6 == 0, F.slice("ring", 1, 4)).when(F.col("poly_id") % 7 == 3, crossing).otherwise(F.col("ring"))
    labelled = v.rings.withColumn("ring", ring)
    half = RES / 2

    def corner(dx, dy):
        return F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))

    square = F.array(corner(-half, -half), corner(half, -half), corner(half, half), corner(-half, half), corner(-half, -half))
    # every fourth footprint repeats a point and is rejected
    stuck = F.array(corner(-half, -half), corner(-half, -half), corner(half, half), corner(-half, half), corner(-half, -half))
    unlabelled = v.grid.select(
        (F.col("cell") + 1000).alias("poly_id"), F.when(F.col("cell") % 4 != 0, square).otherwise(stuck).alias("ring")
    )
    united = tables.unite_layers([labelled, unlabelled], "label", "unlabelled", "poly_id", BUCKET)
    return united.select(F.col("poly_id").cast("bigint").alias("poly_id"), "label", rnd(spatial.ring_area(), 6, "area"))


# --- plots -------------------------------------------------------------------


@query(
    "drop_groups_with_null",
    """SELECT estadillo, count(*) AS n_rows, round(sum(br), 7) AS br FROM fx_trees a
    WHERE estadillo NOT IN (SELECT estadillo FROM fx_trees WHERE ba IS NULL) GROUP BY estadillo""",
)
def drop_groups_with_null(v):
    kept = masks.drop_groups_with_null(v.trees, ["estadillo"], "ba")
    return kept.groupBy("estadillo").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("br"), 7, "br"))


TOTALS_SQL = """pt AS (SELECT t.estadillo, provincia, COALESCE(sum(ba), 0) AS agb, COALESCE(sum(br), 0) AS bgb
    FROM fx_trees t JOIN fx_plots p ON t.estadillo = p.estadillo GROUP BY t.estadillo, provincia)"""


def totals_of(v):
    rows = v.trees.withColumnsRenamed({"ba": "agb", "br": "bgb"}).join(v.plots.select("estadillo", "provincia"), "estadillo")
    return inventory.plot_totals(rows, ["estadillo", "provincia"])


@query(
    "plot_totals",
    f"WITH {TOTALS_SQL} SELECT estadillo, provincia, round(agb, 7) AS agb, round(bgb, 7) AS bgb FROM pt",
)
def plot_totals(v):
    return totals_of(v).select("estadillo", "provincia", rnd("agb", 7), rnd("bgb", 7))


@query(
    "bgb_ratio",
    f"WITH {TOTALS_SQL} SELECT estadillo, provincia, round(CASE WHEN agb > 0 THEN bgb / agb END, 9) AS bgb_ratio FROM pt",
)
def bgb_ratio(v):
    ratio = masks.guarded_ratio(F.col("bgb"), F.col("agb"))
    return totals_of(v).select("estadillo", "provincia", rnd(ratio, 9, "bgb_ratio"))


@query(
    "plot_assembly",
    f"""WITH {TOTALS_SQL} SELECT pt.estadillo, pt.provincia, round(agb, 7) AS agb, c.x AS coor_x, c.y AS coor_y,
    CAST(28 + c.provincia % 4 AS INT) AS huso, concat('20', strftime(o_orderdate, '%y')) AS year_text
    FROM pt JOIN fx_plots c ON pt.estadillo = c.estadillo AND pt.provincia = c.provincia
    JOIN orders ON o_orderkey = pt.estadillo""",
)
def plot_assembly(v):
    key = ["estadillo", "provincia"]
    coordinates = v.plots.select(
        *key, F.col("x").alias("coor_x"), F.col("y").alias("coor_y"), (F.col("provincia") % 4 + 28).alias("huso")
    )
    started = v.t("orders").select(
        F.col("o_orderkey").alias("estadillo"), F.date_format("o_orderdate", "dd/MM/yy").alias("fecha_ini")
    )
    dates = v.plots.select(*key).join(started, "estadillo")
    year_text = F.concat(F.lit("20"), F.substring("fecha_ini", 7, 2))
    return (
        totals_of(v)
        .join(coordinates, key)
        .join(dates, key)
        .select(*key, rnd("agb", 7), "coor_x", "coor_y", "huso", year_text.alias("year_text"))
    )


# --- space -------------------------------------------------------------------


@query(
    "bbox_prefilter",
    """WITH p AS (SELECT min(x) - 3e2 AS x1, max(x) + 3e2 AS x2, min(y) - 3e2 AS y1, max(y) + 3e2 AS y2
      FROM fx_plots)
    SELECT poly_id, label FROM fx_polygons, p WHERE x_max >= x1 AND x_min <= x2 AND y_max >= y1 AND y_min <= y2""",
)
def bbox_prefilter(v):
    return spatial.within_bounds_of(v.polygons, v.plots, 300.0).select("poly_id", "label")


PIP_SQL = """pip AS (SELECT estadillo, COALESCE(label, 'Unknown') AS forest_type FROM fx_plots p LEFT JOIN fx_polygons g
    ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max)"""


def plots_with_type(v):
    joined = spatial.points_with_polygons(v.plots, v.rings, ["label"], BUCKET)
    return joined.withColumn("forest_type", F.coalesce("label", F.lit("Unknown")))


@query("point_in_polygon", f"WITH {PIP_SQL} SELECT estadillo, forest_type FROM pip")
def point_in_polygon(v):
    return plots_with_type(v).select("estadillo", "forest_type")


def box_ring(x_min, x_max, y_min, y_max):
    corners = ((x_min, y_min), (x_max, y_min), (x_max, y_max), (x_min, y_max), (x_min, y_min))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def parts_and_holes(v):
    """Every polygon with a hole in its middle and a second part to its right."""
    x_min, x_max, y_min, y_max = (F.col(c) for c in ("x_min", "x_max", "y_min", "y_max"))
    hole = box_ring(x_min + 300, x_max - 300, y_min + 200, y_max - 200)
    part = box_ring(x_max + 20, x_max + 80, y_min + 100, y_max - 100)
    return v.polygons.select("poly_id", "label", F.array(box_ring(x_min, x_max, y_min, y_max), hole, part).alias("rings"))


@query(
    "point_in_parts",
    """SELECT estadillo, poly_id FROM fx_plots p JOIN fx_polygons g ON (x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max
      AND NOT (x > x_min + 300 AND x < x_max - 300 AND y > y_min + 200 AND y < y_max - 200))
      OR (x BETWEEN x_max + 20 AND x_max + 80 AND y BETWEEN y_min + 100 AND y_max - 100)""",
)
def point_in_parts(v):
    """Plots with the polygons of several parts with holes that they lie in."""
    joined = spatial.points_with_polygons(v.plots, parts_and_holes(v), ["poly_id"], BUCKET, "inner")
    return joined.select("estadillo", "poly_id")


@query("valid_polygons", "SELECT poly_id, label FROM fx_polygons WHERE poly_id % 3 <> 0 AND poly_id % 5 <> 0")
def valid_polygons(v):
    """Polygons whose outline does not cross itself: every third is folded, every fifth has a hole across its border."""
    whole, hole = F.get("rings", F.lit(0)), F.get("rings", F.lit(1))
    folded = F.array(*[F.get(whole, F.lit(i)) for i in (0, 2, 1, 3, 4)])
    across = F.transform(hole, lambda p: F.struct((p["x"] - 500).alias("x"), p["y"].alias("y")))
    rings = F.when(F.col("poly_id") % 3 == 0, F.array(folded, hole)).when(F.col("poly_id") % 5 == 0, F.array(whole, across)).otherwise(F.array(whole, hole))
    return spatial.valid_polygons(parts_and_holes(v).withColumn("rings", rings), "poly_id", BUCKET).select("poly_id", "label")


@query(
    "top_types",
    f"""WITH {PIP_SQL} SELECT forest_type, count(*) AS n_plots FROM pip GROUP BY forest_type
    ORDER BY n_plots DESC, forest_type LIMIT 5""",
)
def top_types(v):
    counts = plots_with_type(v).groupBy("forest_type").agg(F.count(F.lit(1)).alias("n_plots"))
    return counts.orderBy(F.desc("n_plots"), "forest_type").limit(5)


@query(
    "clip_to_polygon",
    """SELECT cell, r, c FROM fx_grid WHERE EXISTS (SELECT 1 FROM fx_polygons WHERE x BETWEEN x_min AND x_max
    AND y BETWEEN y_min AND y_max)""",
)
def clip_to_polygon(v):
    clipped = spatial.points_with_polygons(v.grid, v.rings, [], BUCKET, "left_semi")
    return clipped.select("cell", "r", "c")


@query(
    "net_change_map",
    """WITH m AS (SELECT cell FROM fx_grid WHERE EXISTS (SELECT 1 FROM fx_polygons WHERE x BETWEEN x_min AND x_max
      AND y BETWEEN y_min AND y_max))
    SELECT m.cell, round((COALESCE(b.tbd, 0) - COALESCE(a.tbd, 0)) * 5e-1, 9) AS carbon_change FROM m
    LEFT JOIN fx_cells a ON a.cell = m.cell AND a.yr = 1995 LEFT JOIN fx_cells b ON b.cell = m.cell AND b.yr = 2000""",
)
def net_change_map(v):
    """End minus start inside the boundary; a cell without a value counts as 0 there."""
    mask = spatial.points_with_polygons(v.grid, v.rings, [], BUCKET, "left_semi").select("cell")
    ends = (
        v.cells.where(F.col("yr").isin(1995, 2000))
        .groupBy("cell")
        .agg(*[F.max(F.when(F.col("yr") == y, F.col("tbd"))).alias(f"b{y}") for y in (1995, 2000)])
    )
    delta = (F.coalesce("b2000", F.lit(0.0)) - F.coalesce("b1995", F.lit(0.0))) * 0.5
    return mask.join(ends, "cell", "left").select("cell", rnd(delta, 9, "carbon_change"))


FOOT_SQL = """pa AS (SELECT CAST(floor(r / 8e0) AS INT) AS pr, CAST(floor(c / 8e0) AS INT) AS pc, min(x) - 5e1 AS x_min,
      max(x) + 5e1 AS x_max, min(y) - 5e1 AS y_min, max(y) + 5e1 AS y_max FROM fx_grid GROUP BY 1, 2)"""


@query(
    "footprint_join",
    f"""WITH {FOOT_SQL} SELECT pr, pc, poly_id, CAST(1995 + poly_id % 3 AS INT) AS yr FROM pa JOIN fx_polygons g
    ON pa.x_min <= g.x_max AND g.x_min <= pa.x_max AND pa.y_min <= g.y_max AND g.y_min <= pa.y_max
    WHERE poly_id % 3 = (pr + pc) % 3""",
)
def footprint_join(v):
    """Patches of 8 x 8 cells with the survey footprints of the patch's year."""
    half = RES / 2
    patches = (
        v.grid.groupBy(F.floor(F.col("r") / 8).cast("int").alias("pr"), F.floor(F.col("c") / 8).cast("int").alias("pc"))
        .agg(
            (F.min("x") - half).alias("x_min"),
            (F.max("x") + half).alias("x_max"),
            (F.min("y") - half).alias("y_min"),
            (F.max("y") + half).alias("y_max"),
        )
        .withColumn("patch_year", (F.col("pr") + F.col("pc")) % 3 + 1995)
    )
    footprints = v.polygons.withColumn("yr", F.col("poly_id") % 3 + 1995)
    pairs = spatial.boxes_overlapping(patches, footprints, ["pr", "pc", "patch_year"], ["poly_id", "yr"], BUCKET)
    return pairs.where("patch_year = yr").select("pr", "pc", "poly_id", "yr")


@query(
    "dedup_first",
    """SELECT file_id, min(zone) AS zone FROM (SELECT concat('F', CAST(o_custkey AS VARCHAR)) AS file_id,
    CAST(28 + o_orderkey % 4 AS INT) AS zone FROM orders WHERE o_orderkey % 7 <> 0) q GROUP BY file_id""",
)
def dedup_first(v):
    """Files of several zones share ids; the lowest zone wins, paths without an id are dropped."""
    kind = F.when(F.col("o_orderkey") % 7 == 0, "TERRAIN").otherwise("VEGETACION")
    path = F.concat(F.lit("/mnt/NDSM-"), kind, F.lit("-H50-F"), F.col("o_custkey").cast("string"), F.lit("-COB2.tif"))
    files = v.t("orders").select((F.col("o_orderkey") % 4 + 28).cast("int").alias("zone"), path.alias("path"))
    # fixed value: the file-name pattern
    file_id = F.regexp_extract("path", r"NDSM-VEGETACION-(?:...)-(.*)-COB2\.tif", 1)
    tagged = files.withColumn("file_id", file_id).where("file_id <> ''")
    return inventory.first_per_id(tagged, ["file_id"], "zone", ["path"]).select("file_id", "zone")


@query(
    "sample_raster_at_points",
    """SELECT estadillo, p.yr, round(height, 9) AS height FROM fx_plots p LEFT JOIN fx_cells k ON k.yr = p.yr
    AND k.r = CAST(floor((45e5 - y) / 1e2) AS INT) AND k.c = CAST(floor((x - 5e5) / 1e2) AS INT)""",
)
def sample_raster_at_points(v):
    heights = v.cells.select("yr", "r", "c", "height")
    sampled = spatial.sample_at_points(v.plots, heights, ["yr"], X0, Y0, RES)
    return sampled.select("estadillo", "yr", rnd("height", 9))


# --- training rows -----------------------------------------------------------

TRAINING_SQL = f"""{TOTALS_SQL},
    tr0 AS (SELECT pt.estadillo, g.type_code, height, agb, CASE WHEN agb > 0 THEN bgb / agb END AS ratio
      FROM pt JOIN fx_plots p ON p.estadillo = pt.estadillo
      JOIN fx_cells k ON k.yr = p.yr AND k.r = CAST(floor((45e5 - y) / 1e2) AS INT) AND k.c = CAST(floor((x - 5e5) / 1e2) AS INT)
      JOIN fx_grid g ON g.cell = k.cell WHERE height > 0 AND height <= 60 AND agb > 0),
    tr AS (SELECT * FROM tr0 WHERE type_code IN (SELECT type_code FROM tr0 GROUP BY type_code HAVING count(*) >= 10))"""


def training_rows(v):
    """Plots with a valid sampled height and biomass, of types with at least 10 such plots."""
    heights = v.cells.where("height > 0 AND height <= 60").join(v.grid.select("cell", "type_code"), "cell")
    placed = spatial.sample_at_points(v.plots, heights.select("yr", "r", "c", "height", "type_code"), ["yr"], X0, Y0, RES)
    valid = placed.where("height IS NOT NULL").select("estadillo", "provincia", "type_code", "height")
    rows = valid.join(totals_of(v).where("agb > 0"), ["estadillo", "provincia"])
    rows = stage(rows.withColumn("ratio", masks.guarded_ratio(F.col("bgb"), F.col("agb"))), "training", spread_rows=True)
    return inventory.groups_of_at_least(rows, ["type_code"], 10)


def tiered_rows(v):
    types = v.types.select(F.col("code").alias("type_code"), "clade", "family", "genus", F.col("name").alias("forest_type"))
    return inventory.stack_tiers(training_rows(v).join(types, "type_code"), ["clade", "family", "genus", "forest_type"])


TIER_SQL = f"""{TRAINING_SQL}, ts AS (SELECT tr.*, u.tier, u.tier_name FROM tr JOIN fx_types t ON code = type_code,
    LATERAL (SELECT 0 AS tier, 'General' AS tier_name UNION ALL SELECT 1, clade UNION ALL SELECT 2, family
             UNION ALL SELECT 3, genus UNION ALL SELECT 4, name) u)"""


@query(
    "training_filter",
    f"WITH {TRAINING_SQL} SELECT estadillo, type_code, round(height, 9) AS height, round(agb, 7) AS agb FROM tr",
)
def training_filter(v):
    return training_rows(v).select("estadillo", "type_code", rnd("height", 9), rnd("agb", 7))


@query(
    "tier_stack",
    f"""WITH {TIER_SQL} SELECT tier, tier_name, count(*) AS n_samples, round(avg(ln(height)), 9) AS mean_ln_height,
    round(avg(ln(agb)), 9) AS mean_ln_agb FROM ts GROUP BY tier, tier_name""",
)
def tier_stack(v):
    return (
        tiered_rows(v)
        .groupBy("tier", "tier_name")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            rnd(F.avg(F.ln("height")), 9, "mean_ln_height"),
            rnd(F.avg(F.ln("agb")), 9, "mean_ln_agb"),
        )
    )


@query(
    "iqr_filter",
    f"""WITH {TRAINING_SQL}, q AS (SELECT type_code, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3
      FROM tr GROUP BY type_code)
    SELECT type_code, round(q1 - 15e-1 * (q3 - q1), 9) AS fence_low, round(q3 + 15e-1 * (q3 - q1), 9) AS fence_high,
    count(*) AS n_kept, round(avg(ratio), 9) AS mean_ratio FROM tr JOIN q USING (type_code)
    WHERE ratio BETWEEN q1 - 15e-1 * (q3 - q1) AND q3 + 15e-1 * (q3 - q1) GROUP BY type_code, q1, q3""",
)
def iqr_filter(v):
    return (
        inventory.iqr_filter(training_rows(v).where("ratio > 0"), ["type_code"], "ratio")
        .groupBy("type_code", "fence_low", "fence_high")
        .agg(F.count(F.lit(1)).alias("n_kept"), rnd(F.avg("ratio"), 9, "mean_ratio"))
        .withColumns({c: rnd(c, 9) for c in ("fence_low", "fence_high")})
    )


RATIO_SQL = f"""{TIER_SQL}, q AS (SELECT tier, tier_name, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3
      FROM ts GROUP BY tier, tier_name),
    rt AS (SELECT tier, tier_name, count(*) AS n_samples, avg(ratio) AS mean, quantile_cont(ratio, 0.05) AS q05,
      quantile_cont(ratio, 0.95) AS q95 FROM ts JOIN q USING (tier, tier_name)
      WHERE ratio BETWEEN q1 - 15e-1 * (q3 - q1) AND q3 + 15e-1 * (q3 - q1) GROUP BY tier, tier_name HAVING count(*) >= 25)"""


def ratios_by_tier(v, least: int = 25):
    """Mean, 5th and 95th percentile of the below-ground ratio per tier after the IQR fence."""
    keys = ["tier", "tier_name"]
    rows = stage(tiered_rows(v).where("ratio > 0").select(*keys, "ratio"), "ratios")
    clean = stage(inventory.iqr_filter(rows, keys, "ratio"), "ratios")
    order = exact_percentiles(clean, keys, "ratio", {"q05": 0.05, "q95": 0.95}, staged=True)
    means = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("ratio").alias("mean"))
    return means.where(F.col("n_samples") >= least).join(order, keys)


@query(
    "ratio_by_tier",
    f"""WITH {RATIO_SQL} SELECT tier, tier_name, n_samples, round(mean, 9) AS mean, round(q05, 9) AS q05,
    round(q95, 9) AS q95 FROM rt""",
)
def ratio_by_tier(v):
    return ratios_by_tier(v).withColumns({c: rnd(c, 9) for c in ("mean", "q05", "q95")})


PARAM_SQL = f"""{TIER_SQL},
    fit AS (SELECT tier, tier_name, regr_slope(ln(agb), ln(height)) AS slope, regr_intercept(ln(agb), ln(height)) AS intercept
      FROM ts GROUP BY tier, tier_name HAVING count(*) >= 100),
    bg AS (SELECT tier, tier_name, avg(ratio) AS mean FROM ts GROUP BY tier, tier_name HAVING count(*) >= 1000)"""


def tier_parameters(v):
    """Least-squares log-log parameters where a tier has enough plots, and mean ratios likewise."""
    keys = ["tier", "tier_name"]
    stats = tiered_rows(v).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.ln("agb"), F.ln("height")).alias("slope"),
        F.regr_intercept(F.ln("agb"), F.ln("height")).alias("intercept"),
        F.avg("ratio").alias("mean"),
    )
    stats = stage(stats, "tiers")
    fits = stats.where("n >= 100").select(*keys, "intercept", "slope")
    ratios = stats.where("n >= 1000").select(*keys, "mean")
    return fits, ratios


RESOLVE_SQL = f"""{PARAM_SQL},
    par AS (SELECT name, genus, CASE WHEN code % 6 <> 5 THEN family END AS family, clade FROM (SELECT * REPLACE (CASE WHEN code % 7 = 0 THEN concat('Other ', name) ELSE name END AS name) FROM fx_types) o),
    ty AS (SELECT name AS type_name FROM fx_types UNION ALL SELECT 'No arbolado' UNION ALL SELECT 'Elsewhere'),
    ch AS (SELECT type_name, 4 AS tier, type_name AS tier_name FROM ty WHERE type_name <> 'No arbolado'
      UNION ALL SELECT type_name, 3, genus FROM ty JOIN par ON type_name = name
      UNION ALL SELECT type_name, 2, family FROM ty JOIN par ON type_name = name WHERE family IS NOT NULL
      UNION ALL SELECT type_name, 1, clade FROM ty JOIN par ON type_name = name WHERE family IS NOT NULL
      UNION ALL SELECT type_name, 0, 'General' FROM ty),
    ra AS (SELECT type_name, tier, intercept, slope, row_number() OVER (PARTITION BY type_name ORDER BY tier DESC) AS k
      FROM ch JOIN fit USING (tier, tier_name)),
    rb AS (SELECT type_name, tier, mean, row_number() OVER (PARTITION BY type_name ORDER BY tier DESC) AS k
      FROM ch JOIN bg USING (tier, tier_name)),
    res AS (SELECT type_name, ra.tier AS agb_tier, rb.tier AS bgb_tier, CASE WHEN ra.tier IS NULL THEN 0 ELSE exp(intercept) END AS a,
      COALESCE(slope, 0) AS b, COALESCE(mean, 0) AS ratio_mean
      FROM ty LEFT JOIN (SELECT * FROM ra WHERE k = 1) ra USING (type_name) LEFT JOIN (SELECT * FROM rb WHERE k = 1) rb USING (type_name))"""


def resolved_parameters(v):
    """Allometry (a, b) and ratio of every type, each from its own most specific tier."""
    family = F.when(F.col("code") % 6 != 5, F.col("family"))
    # one type in seven is listed under another name, so its own has no parents
    name = F.when(F.col("code") % 7 == 0, F.concat(F.lit("Other "), F.col("name"))).otherwise(F.col("name"))
    parents = v.types.select(name.alias("name"), "genus", family.alias("family"), "clade")
    extra = v.spark.createDataFrame([("No arbolado",), ("Elsewhere",)], "type_name string")
    chain = inventory.tier_chain(v.types.select(F.col("name").alias("type_name")).unionByName(extra), parents)
    fits, ratios = tier_parameters(v)
    agb = inventory.resolve_parameters(chain, fits, ["intercept", "slope"], "agb")
    bgb = inventory.resolve_parameters(chain, ratios, ["mean"], "bgb")
    scale = F.when(F.col("agb_tier").isNull(), F.lit(0.0)).otherwise(F.exp("agb_intercept"))
    return agb.join(bgb, "type_name").select(
        "type_name",
        "agb_tier",
        "bgb_tier",
        scale.alias("a"),
        F.col("agb_slope").alias("b"),
        F.col("bgb_mean").alias("ratio_mean"),
    )


@query(
    "allometry_resolve",
    f"""WITH {RESOLVE_SQL} SELECT type_name, agb_tier, bgb_tier, round(a, 7) AS a, round(b, 9) AS b,
    round(ratio_mean, 9) AS ratio_mean FROM res""",
)
def allometry_resolve(v):
    return resolved_parameters(v).withColumns({"a": rnd("a", 7), "b": rnd("b", 9), "ratio_mean": rnd("ratio_mean", 9)})


@query(
    "available_types",
    f"""WITH {PARAM_SQL} SELECT tier_name AS type_name FROM fit UNION SELECT clade FROM fx_types
    UNION SELECT family FROM fx_types UNION SELECT genus FROM fx_types UNION SELECT name FROM fx_types""",
)
def available_types(v):
    levels = [v.types.select(F.col(c).alias("type_name")) for c in ("clade", "family", "genus", "name")]
    out = tier_parameters(v)[0].select(F.col("tier_name").alias("type_name"))
    for level in levels:
        out = out.unionByName(level)
    return out.where("type_name IS NOT NULL").distinct().orderBy("type_name")


@query(
    "table_validation",
    " UNION ALL ".join(
        f"""SELECT 'trees' AS table_name, count(*) AS n_rows, '{c}' AS column_name, TRUE AS present,
        count(*) - count({c}) AS n_null, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value
        FROM fx_trees"""
        for c in ("estadillo", "vcc", "ba", "br")
    )
    + " UNION ALL SELECT 'trees', count(*), 'agb', FALSE, NULL, NULL, NULL FROM fx_trees",
)
def table_validation(v):
    return inventory.validate_columns(v.trees, "trees", ["estadillo", "vcc", "ba", "br", "agb"])


# Regions surveyed in the older datum, and EPSG code bases by datum.
OLD_DATUM = [
    "Navarra", "ACoruna", "Lugo", "Orense", "Pontevedra", "Asturias", "Cantabria",
    "Murcia", "Baleares", "Euskadi", "LaRioja", "Madrid", "Cataluna",
]
OLD_EPSG, NEW_EPSG = 23000, 25800


@query(
    "region_crs",
    """SELECT region, huso, CASE WHEN region IN ('Madrid', 'Navarra') THEN concat('EPSG:', CAST(23000 + huso AS VARCHAR))
      WHEN region = 'Canarias' THEN 'EPSG:4326' ELSE concat('EPSG:', CAST(25800 + huso AS VARCHAR)) END AS source_crs,
    CASE WHEN region = 'Canarias' THEN 'EPSG:25828' ELSE concat('EPSG:', CAST(25800 + huso AS VARCHAR)) END AS target_crs,
    count(*) AS n_plots FROM (SELECT CASE provincia % 4 WHEN 0 THEN 'Madrid' WHEN 1 THEN 'Canarias' WHEN 2 THEN 'Navarra'
      ELSE 'Andalucia' END AS region, CAST(28 + estadillo % 4 AS INT) AS huso FROM fx_plots) q GROUP BY region, huso""",
)
def region_crs(v):
    region = (
        F.when(F.col("provincia") % 4 == 0, "Madrid")
        .when(F.col("provincia") % 4 == 1, "Canarias")
        .when(F.col("provincia") % 4 == 2, "Navarra")
        .otherwise("Andalucia")
    )
    plots = v.plots.select(region.alias("region"), (F.col("estadillo") % 4 + 28).cast("int").alias("huso"))

    def epsg(base):
        return F.concat(F.lit("EPSG:"), (F.col("huso") + base).cast("string"))

    island = F.col("region") == "Canarias"
    source = F.when(F.col("region").isin(OLD_DATUM), epsg(OLD_EPSG)).when(island, "EPSG:4326").otherwise(epsg(NEW_EPSG))
    return (
        plots.groupBy("region", "huso")
        .agg(F.count(F.lit(1)).alias("n_plots"))
        .withColumns({"source_crs": source, "target_crs": F.when(island, "EPSG:25828").otherwise(epsg(NEW_EPSG))})
    )
