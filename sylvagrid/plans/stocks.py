"""Stocks: quality control, zonal sums, hierarchy roll-ups and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvagrid.functions.text import rnd
from sylvagrid.operators import change, masks, series, zonal
from sylvagrid.plans.registry import query

# Height bins, land-cover groups and the masked classes.
HEIGHT_EDGES = [0, 2, 6, 10, 20]
HEIGHT_LABELS = ["0_2m", "2_6m", "6_10m", "10_20m", "20m_plus"]
LANDCOVER_GROUPS = {"urban": range(1, 12), "agricultural": range(15, 23), "natural": range(23, 40)}
MASKED_CLASSES = [12, 13, 14]
DEFAULT_TYPE = "Low-density woodlands and agroforestry"

HEIGHT_CASE = """CASE WHEN height < 0 THEN NULL WHEN height < 2 THEN '0_2m' WHEN height < 6 THEN '2_6m'
    WHEN height < 10 THEN '6_10m' WHEN height < 20 THEN '10_20m' WHEN height >= 20 THEN '20m_plus' END"""


def hierarchy_of(v):
    codes = v.types.select("code", "name")
    # one type in seven is listed under another name and misses its lookup
    name = F.when(F.col("code") % 7 == 0, F.concat(F.lit("Other "), F.col("name"))).otherwise(F.col("name"))
    tiers = v.types.withColumn("name", name)
    return zonal.hierarchy(codes, tiers, DEFAULT_TYPE, {"C1": "Broadleaved"})


HIERARCHY_SQL = f"""SELECT k.code, k.name, COALESCE(t.genus, k.name) AS genus,
    CASE WHEN t.clade = 'C1' THEN 'Broadleaved' ELSE COALESCE(t.clade, 'Unknown') END AS clade
    FROM fx_types k LEFT JOIN (SELECT * REPLACE (CASE WHEN code % 7 = 0 THEN concat('Other ', name) ELSE name END AS name) FROM fx_types) t ON k.name = t.name
    UNION ALL SELECT 0, '{DEFAULT_TYPE}', '{DEFAULT_TYPE}', '{DEFAULT_TYPE}'"""


def type_stocks(v):
    """Tonnes per year and forest type, with the type's name, genus and clade."""
    cells = v.cells.join(v.grid.select("cell", "type_code"), "cell")
    sums = zonal.zonal_sum(cells, ["yr", "type_code"], "tbd")
    return sums.join(hierarchy_of(v), F.col("type_code") == F.col("code"))


TYPE_SQL = f"""h AS ({HIERARCHY_SQL}),
    s AS (SELECT yr, type_code, sum(tbd) AS total FROM fx_cells JOIN fx_grid USING (cell) GROUP BY yr, type_code),
    st AS (SELECT yr, code, name, genus, clade, total FROM s JOIN h ON type_code = code),
    gen AS (SELECT yr, genus, clade, sum(total) * 5e-1 / 1e3 AS carbon FROM st GROUP BY yr, genus, clade)"""


@query("hierarchy_lookup", HIERARCHY_SQL)
def hierarchy_lookup(v):
    return hierarchy_of(v)


@query("zonal_sum_type", f"WITH {TYPE_SQL} SELECT yr, code, name, genus, clade, round(total, 7) AS total FROM st")
def zonal_sum_type(v):
    return type_stocks(v).select("yr", "code", "name", "genus", "clade", rnd("total", 7))


@query(
    "rollup_hierarchy",
    f"""WITH {TYPE_SQL}
    SELECT yr, 'genus' AS level, clade, genus, round(sum(total), 6) AS total FROM st GROUP BY yr, clade, genus
    UNION ALL SELECT yr, 'clade', clade, NULL, round(sum(total), 6) FROM st GROUP BY yr, clade""",
)
def rollup_hierarchy(v):
    rolled = zonal.rollup_levels(type_stocks(v), "total")
    return rolled.withColumn("total", rnd("total", 6)).orderBy("yr", "level", "clade", "genus")


@query(
    "scan_cells",
    """SELECT cell, yr, round(CASE WHEN raw = -9999 OR raw > 900 THEN NULL ELSE raw END, 9) AS value
    FROM (SELECT cell, yr, CASE WHEN cell % 10 = 0 THEN -9999e0 ELSE tbd END AS raw FROM fx_cells) q""",
)
def scan_cells(v):
    raw = F.when(F.col("cell") % 10 == 0, F.lit(-9999.0)).otherwise(F.col("tbd"))
    value = masks.nodata_to_null(F.col("raw"), -9999.0, cap=900.0)
    return v.cells.withColumn("raw", raw).select("cell", "yr", rnd(value, 9, "value"))


@query(
    "quality_control",
    """SELECT yr, count(*) AS n_cells, count(CASE WHEN raw > 1500 THEN 1 END) AS n_above,
    count(CASE WHEN raw < 0 THEN 1 END) AS n_below, count(raw) AS n_input,
    round(sum(CASE WHEN raw > 1500 THEN NULL WHEN raw < 0 THEN 0 ELSE raw END), 4) AS kept_sum
    FROM (SELECT yr, CASE WHEN cell % 11 = 0 THEN NULL ELSE tbd * 3e0 - 12e1 END AS raw FROM fx_cells) q GROUP BY yr""",
)
def quality_control(v):
    raw = F.when(F.col("cell") % 11 != 0, F.col("tbd") * 3.0 - 120.0)
    kept = masks.within_limits(F.col("raw"), 0.0, 1500.0)
    return (
        v.cells.select("yr", raw.alias("raw"))
        .withColumn("kept", kept)
        .groupBy("yr")
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.count_if(F.col("raw") > 1500).alias("n_above"),
            F.count_if(F.col("raw") < 0).alias("n_below"),
            F.count("raw").alias("n_input"),
            rnd(F.sum("kept"), 4, "kept_sum"),
        )
    )


@query(
    "land_use_mask",
    """SELECT yr, count(*) AS n_cells, count(kept) AS n_kept,
    round(1e2 * (count(*) - count(kept)) / count(*), 6) AS pct_masked, round(sum(kept), 6) AS kept_total
    FROM (SELECT yr, CASE WHEN landcover IN (12, 13, 14) THEN NULL ELSE tbd END AS kept
          FROM fx_cells JOIN fx_grid USING (cell)) q GROUP BY yr""",
)
def land_use_mask(v):
    kept = masks.drop_classes(F.col("tbd"), F.col("landcover"), MASKED_CLASSES)
    n = F.count(F.lit(1))
    return (
        v.cells.join(v.grid.select("cell", "landcover"), "cell")
        .select("yr", kept.alias("kept"))
        .groupBy("yr")
        .agg(
            n.alias("n_cells"),
            F.count("kept").alias("n_kept"),
            rnd((100.0 * (n - F.count("kept")) / n), 6, "pct_masked"),
            rnd(F.sum("kept"), 6, "kept_total"),
        )
    )


@query(
    "zonal_sum_landcover",
    """SELECT CASE WHEN landcover BETWEEN 1 AND 11 THEN 'urban' WHEN landcover BETWEEN 15 AND 22 THEN 'agricultural'
    WHEN landcover BETWEEN 23 AND 39 THEN 'natural' END AS landcover_group, yr, round(sum(tbd), 6) AS biomass
    FROM fx_cells JOIN fx_grid USING (cell)
    WHERE landcover BETWEEN 1 AND 11 OR landcover BETWEEN 15 AND 39 GROUP BY 1, yr""",
)
def zonal_sum_landcover(v):
    cells = v.cells.join(v.grid.select("cell", "landcover"), "cell")
    grouped = cells.withColumn("landcover_group", zonal.group_of_class(F.col("landcover"), LANDCOVER_GROUPS))
    sums = zonal.zonal_sum(grouped.where("landcover_group IS NOT NULL"), ["landcover_group", "yr"], "tbd", name="biomass")
    return sums.withColumn("biomass", rnd("biomass", 6))


def with_height_bin(v):
    return v.cells.withColumn("height_bin", zonal.bin_label(F.col("height"), HEIGHT_EDGES, HEIGHT_LABELS))


@query(
    "height_bins",
    f"""SELECT yr, height_bin, CASE WHEN height_bin = '20m_plus' THEN 20 ELSE
    CAST(split_part(height_bin, '_', 1) AS INT) END AS bin_order, count(*) AS n_cells,
    round(avg(height), 6) AS mean_height FROM (SELECT yr, height, {HEIGHT_CASE} AS height_bin FROM fx_cells) q
    GROUP BY yr, height_bin""",
)
def height_bins(v):
    # display order: the lower edge written in the label
    lower = F.regexp_extract("height_bin", r"^(\d+)", 1).cast("int")
    return (
        with_height_bin(v)
        .groupBy("yr", "height_bin")
        .agg(F.count(F.lit(1)).alias("n_cells"), rnd(F.avg("height"), 6, "mean_height"))
        .withColumn("bin_order", lower)
        .orderBy("yr", "bin_order")
    )


HEIGHT_SUM_SQL = f"""hs AS (SELECT {HEIGHT_CASE} AS height_bin, yr, sum(tbd) AS biomass FROM fx_cells GROUP BY 1, yr)"""


@query("zonal_sum_height", f"WITH {HEIGHT_SUM_SQL} SELECT height_bin, yr, round(biomass, 6) AS biomass FROM hs")
def zonal_sum_height(v):
    sums = zonal.zonal_sum(with_height_bin(v), ["height_bin", "yr"], "tbd", name="biomass")
    return sums.withColumn("biomass", rnd("biomass", 6))


@query(
    "share_of_total",
    f"""WITH {HEIGHT_SUM_SQL} SELECT yr, height_bin, round(biomass * 5e-1, 7) AS carbon,
    round(biomass * 5e-1 / sum(biomass * 5e-1) OVER (PARTITION BY yr) * 1e2, 6) AS percentage FROM hs""",
)
def share_of_total(v):
    sums = zonal.zonal_sum(with_height_bin(v), ["yr", "height_bin"], "tbd", area_ha=0.5, name="carbon")
    shares = series.share_of_total(sums, ["yr"], "carbon")
    return shares.select("yr", "height_bin", rnd("carbon", 7), rnd("percentage", 6))


def genus_carbon(v):
    """Thousand tonnes of carbon per year, genus and clade."""
    return type_stocks(v).groupBy("yr", "genus", "clade").agg((F.sum("total") * 0.5 / 1e3).alias("carbon"))


@query(
    "annual_flux",
    """WITH y AS (SELECT yr, sum(tbd) * 5e-1 / 1e3 AS carbon FROM fx_cells GROUP BY yr),
    f AS (SELECT yr, carbon, COALESCE(carbon - lag(carbon) OVER (ORDER BY yr), 0) AS annual_flux,
          (carbon - lag(carbon) OVER (ORDER BY yr)) / lag(carbon) OVER (ORDER BY yr) * 1e2 AS pct_change FROM y)
    SELECT yr, yr + 5e-1 AS year_mid, round(carbon, 6) AS carbon, round(annual_flux, 6) AS annual_flux,
    round(pct_change, 6) AS pct_change,
    round(sum(annual_flux) OVER (ORDER BY yr ROWS UNBOUNDED PRECEDING), 6) AS cumulative_flux FROM f""",
)
def annual_flux(v):
    totals = v.cells.groupBy("yr").agg((F.sum("tbd") * 0.5 / 1e3).alias("carbon"))
    flux = series.annual_flux(totals, [], "carbon")
    return flux.select(
        "yr", "year_mid", *[rnd(c, 6) for c in ("carbon", "annual_flux", "pct_change", "cumulative_flux")]
    )


@query(
    "baseline_index",
    f"""WITH {TYPE_SQL}, b AS (SELECT genus, clade, carbon AS base FROM gen WHERE yr = 1995)
    SELECT yr, genus, clade, round(carbon, 6) AS carbon, round(carbon / base * 1e2, 6) AS relative_value
    FROM gen JOIN b USING (genus, clade) WHERE base > 0""",
)
def baseline_index(v):
    indexed = series.baseline_index(genus_carbon(v), ["genus", "clade"], "carbon", 1995)
    return indexed.select("yr", "genus", "clade", rnd("carbon", 6), rnd("relative_value", 6))


@query(
    "start_end_change",
    f"""WITH {TYPE_SQL} SELECT genus, CASE WHEN clade = 'C0' THEN 'Conifer' ELSE clade END AS forest_type,
    round(a.carbon, 6) AS start_value, round(b.carbon, 6) AS end_value, round(b.carbon - a.carbon, 6) AS change,
    round((b.carbon - a.carbon) / a.carbon * 1e2, 6) AS pct_change
    FROM gen a JOIN gen b USING (genus, clade) WHERE a.yr = 1995 AND b.yr = 2000""",
)
def start_end_change(v):
    changed = change.start_end_change(genus_carbon(v), ["genus", "clade"], "carbon", 1995, 2000)
    renamed = F.when(F.col("clade") == "C0", "Conifer").otherwise(F.col("clade"))
    return changed.select(
        "genus",
        renamed.alias("forest_type"),
        *[rnd(c, 6) for c in ("start_value", "end_value", "change", "pct_change")],
    )


@query(
    "pivot_year_genus",
    f"""WITH {TYPE_SQL}, g AS (SELECT yr, genus, avg(carbon) AS carbon FROM gen GROUP BY yr, genus)
    SELECT yr, {", ".join(f"round(max(CASE WHEN genus = 'G{i}' THEN carbon END), 6) AS G{i}" for i in range(8))},
    round(sum(CASE WHEN genus NOT IN ({", ".join(f"'G{i}'" for i in range(8))}) THEN carbon END), 6) AS others
    FROM g GROUP BY yr""",
)
def pivot_year_genus(v):
    """One column per named genus and one with the sum of all others."""
    names = [f"G{i}" for i in range(8)]
    per = genus_carbon(v).groupBy("yr", "genus").agg(F.avg("carbon").alias("carbon"))
    column = F.when(F.col("genus").isin(names), F.col("genus")).otherwise("others")
    wide = per.withColumn("genus", column).groupBy("yr").pivot("genus", [*names, "others"]).agg(F.sum("carbon"))
    return wide.select("yr", *[rnd(n, 6) for n in [*names, "others"]])


@query(
    "storage_breakdown",
    f"""WITH {TYPE_SQL}, w AS (SELECT yr, sum(CASE WHEN clade = 'Broadleaved' THEN carbon ELSE 0 END) AS b,
      sum(CASE WHEN clade = 'C0' THEN carbon ELSE 0 END) AS k,
      sum(CASE WHEN clade = 'Unknown' THEN carbon ELSE 0 END) AS m,
      sum(CASE WHEN clade = 'Broadleaved' AND genus = 'G1' THEN carbon ELSE 0 END) AS g1,
      sum(CASE WHEN clade = 'Broadleaved' AND genus = 'G3' THEN carbon ELSE 0 END) AS g3,
      sum(CASE WHEN clade = 'C0' AND genus = 'G2' THEN carbon ELSE 0 END) AS g2
      FROM gen WHERE yr IN (1995, 2000) GROUP BY yr)
    SELECT yr, 'Forests' AS forest_type, 'Total' AS genus, round(b + k + m, 6) AS carbon FROM w
    UNION ALL SELECT yr, 'Broadleaved', 'G1', round(g1, 6) FROM w
    UNION ALL SELECT yr, 'Broadleaved', 'G3', round(g3, 6) FROM w
    UNION ALL SELECT yr, 'Broadleaved', 'Others', round(b - g1 - g3, 6) FROM w
    UNION ALL SELECT yr, 'Conifer', 'G2', round(g2, 6) FROM w
    UNION ALL SELECT yr, 'Conifer', 'Others', round(k - g2, 6) FROM w
    UNION ALL SELECT yr, 'Mixed', 'Total', round(m, 6) FROM w""",
)
def storage_breakdown(v):
    """Named genera, the remainder of their clade, and the total of all forests."""
    kind = (
        F.when(F.col("clade") == "Broadleaved", "Broadleaved")
        .when(F.col("clade") == "C0", "Conifer")
        .when(F.col("clade") == "Unknown", "Mixed")
    )
    named = (
        F.when((F.col("forest_type") == "Broadleaved") & F.col("genus").isin("G1", "G3"), F.col("genus"))
        .when((F.col("forest_type") == "Conifer") & (F.col("genus") == "G2"), F.col("genus"))
        .when(F.col("forest_type") == "Mixed", "Total")
        .otherwise("Others")
    )
    parts = (
        genus_carbon(v)
        .where(F.col("yr").isin(1995, 2000))
        .withColumn("forest_type", kind)
        .where("forest_type IS NOT NULL")
        .withColumn("genus", named)
    )
    # each part also counts towards the grand total
    rows = F.explode(
        F.array(F.struct("forest_type", "genus"), F.struct(F.lit("Forests").alias("forest_type"), F.lit("Total").alias("genus")))
    )
    return (
        parts.select("yr", "carbon", rows.alias("s"))
        .groupBy("yr", "s.forest_type", "s.genus")
        .agg(rnd(F.sum("carbon"), 6, "carbon"))
    )


PAIRS_SQL = """yy AS (SELECT yr AS year1, lead(yr) OVER (ORDER BY yr) AS year2 FROM (SELECT DISTINCT yr FROM fx_cells) q),
    pr AS (SELECT a.cell, yy.year1, yy.year2, a.tbd AS b1, b.tbd AS b2 FROM yy JOIN fx_cells a ON a.yr = yy.year1
           JOIN fx_cells b ON b.yr = yy.year2 AND b.cell = a.cell)"""


@query(
    "transition_pairs",
    f"""WITH {PAIRS_SQL} SELECT cell, year1, year2, round(b1, 9) AS b1, round(b2, 9) AS b2,
    round(b2 - b1, 9) AS raw_diff FROM pr""",
)
def transition_pairs(v):
    pairs = change.transition_pairs(v.cells)
    raw = F.col("b2") - F.col("b1")
    return pairs.select("cell", "year1", "year2", rnd("b1", 9), rnd("b2", 9), rnd(raw, 9, "raw_diff"))


@query(
    "change_maps",
    f"""WITH {PAIRS_SQL}, z AS (SELECT cell, year1, year2, greatest(b1 - 1e2, 0) AS a, greatest(b2 - 1e2, 0) AS b FROM pr)
    SELECT cell, year1, year2, round(b - a, 9) AS raw_diff,
    round(CASE WHEN a + b > 0 THEN 2e2 * (b - a) / (a + b) ELSE 0 END, 9) AS rel_diff FROM z""",
)
def change_maps(v):
    # shifted down so that the clamp at 0 and the 0/0 rule occur
    pairs = change.transition_pairs(v.cells.withColumn("tbd", F.col("tbd") - 100.0))
    return change.change_columns(pairs).select("cell", "year1", "year2", rnd("raw_diff", 9), rnd("rel_diff", 9))


STATS_SQL = f"""WITH {PAIRS_SQL}, d AS (SELECT *, b2 - b1 AS raw, (b2 - b1) * 5e-1 * 1 / 1e6 AS cc,
      CASE WHEN b1 + b2 > 0 THEN 2e2 * (b2 - b1) / (b1 + b2) ELSE 0 END AS rel FROM pr)
    SELECT year1, year2, concat(year1, '-', year2) AS period, count(*) AS n_valid_pixels,
    {", ".join(f'''round(avg({c}), 9) AS mean_{n}, round(stddev_pop({c}), 9) AS std_{n}, round(min({c}), 9) AS min_{n},
    round(max({c}), 9) AS max_{n}, round(median({c}), 9) AS median_{n}, round(quantile_cont({c}, 0.25), 9) AS q25_{n},
    round(quantile_cont({c}, 0.75), 9) AS q75_{n}''' for c, n in (("raw", "raw_diff"), ("rel", "rel_diff")))},
    round(sum(cc), 9) AS total_carbon_change_Mt, round(sum(CASE WHEN cc > 0 THEN cc END), 9) AS total_gains_Mt,
    round(sum(CASE WHEN cc < 0 THEN cc END), 9) AS total_losses_Mt,
    count(CASE WHEN raw > 1 THEN 1 END) AS n_gain_pixels, count(CASE WHEN raw < -1 THEN 1 END) AS n_loss_pixels,
    count(CASE WHEN abs(raw) < 1 THEN 1 END) AS n_stable_pixels,
    round(1e2 * count(CASE WHEN raw > 1 THEN 1 END) / count(*), 9) AS pct_gain,
    round(1e2 * count(CASE WHEN raw < -1 THEN 1 END) / count(*), 9) AS pct_loss,
    round(1e2 * count(CASE WHEN abs(raw) < 1 THEN 1 END) / count(*), 9) AS pct_stable,
    round(avg(b1), 9) AS mean_biomass_y1, round(avg(b2), 9) AS mean_biomass_y2,
    round(stddev_pop(b1), 9) AS std_biomass_y1, round(stddev_pop(b2), 9) AS std_biomass_y2,
    round(median(b1), 9) AS median_biomass_y1, round(median(b2), 9) AS median_biomass_y2,
    count(CASE WHEN b1 > 10 AND b2 < 10 THEN 1 END) AS transitions_to_zero,
    count(CASE WHEN b1 < 10 AND b2 > 10 THEN 1 END) AS transitions_from_zero,
    count(CASE WHEN raw < -50 THEN 1 END) AS high_loss_transitions,
    count(CASE WHEN raw > 50 THEN 1 END) AS high_gain_transitions,
    round(COALESCE(1e2 * sum(CASE WHEN b1 > 10 AND b2 < 10 AND cc < 0 THEN cc END) / sum(CASE WHEN cc < 0 THEN cc END), 0), 9)
      AS pct_losses_to_zero,
    round(COALESCE(1e2 * sum(CASE WHEN raw < -50 THEN cc END) / sum(CASE WHEN cc < 0 THEN cc END), 0), 9) AS pct_high_losses
    FROM d GROUP BY year1, year2"""


@query("transition_stats", STATS_SQL)
def transition_stats(v):
    stats = change.transition_statistics(change.transition_pairs(v.cells))
    doubles = [f.name for f in stats.schema if f.dataType.typeName() == "double"]
    return stats.withColumns({c: rnd(c, 9) for c in doubles})
