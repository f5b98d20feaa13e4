"""Semantics that are easy to get wrong, on hand-computed frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvagrid.functions import noise, projection
from sylvagrid.operators import (
    catalog,
    change,
    climate,
    composite,
    distributions,
    grid,
    inventory,
    masks,
    metrics,
    montecarlo,
    series,
    spatial,
    variogram,
    zonal,
)
from sylvagrid.sources import tables


def one(spark, value, ddl="v double"):
    return spark.createDataFrame([(value,)], ddl)


# --- masks and bins ----------------------------------------------------------


def test_limits_keep_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (1500.0,), (1500.1,)], "v double")
    got = [r[0] for r in df.select(masks.within_limits(F.col("v"), 0.0, 1500.0)).collect()]
    assert got == [None, 0.0, 0.0, 1500.0, None]


def test_outlier_spares_nodata(spark):
    df = spark.createDataFrame([(-9999.0,), (-9999.05,), (-1.0,), (60.0,), (60.1,)], "v double")
    got = [r[0] for r in df.select(masks.is_outlier(F.col("v"), -9999.0)).collect()]
    assert got == [False, False, True, False, True]


def test_symmetric_change_of_zeros(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (0.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(masks.symmetric_change(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 100.0, 200.0]


def test_group_with_one_null_is_dropped(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 5.0)], "k int, v double")
    assert [r["k"] for r in masks.drop_groups_with_null(df, ["k"], "v").collect()] == [2]


def test_sigma_clip_uses_sample_deviation(spark):
    # mean 2, sample deviation 2.0, population deviation 1.79
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.0, 2.0, 2.0, 6.0)], "v double")
    assert masks.sigma_clip(df, "v", 2.0).count() == 6
    assert masks.sigma_clip(df, "v", 1.9).count() == 5


def test_height_bins_are_half_open(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.9, 2.0, 19.9, 20.0, 99.0)], "h double")
    label = zonal.bin_label(F.col("h"), [0, 2, 6, 10, 20], ["a", "b", "c", "d", "e"])
    assert [r[0] for r in df.select(label).collect()] == ["a", "a", "b", "d", "e", "e"]


def test_unlisted_classes_have_no_group(spark):
    df = spark.createDataFrame([(11,), (12,), (14,), (15,)], "c int")
    group = zonal.group_of_class(F.col("c"), {"urban": range(1, 12), "agricultural": range(15, 23)})
    assert [r[0] for r in df.select(group).collect()] == ["urban", None, None, "agricultural"]


def test_zone_of_nulls_sums_to_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "z int, v double")
    assert zonal.zonal_sum(df, ["z"], "v").first()["total"] == 0.0


def test_zone_sums_add_up(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("z"), (F.col("id") * 0.25).alias("v"))
    total = zonal.zonal_sum(df, ["z"], "v").agg(F.sum("total")).first()[0]
    assert total == pytest.approx(df.agg(F.sum("v")).first()[0])


# --- change ------------------------------------------------------------------


def test_pairs_follow_available_years(spark):
    # 2018 never occurs; cell 2 lacks 2019, so 2017 and 2020 are no pair for it
    df = spark.createDataFrame(
        [(1, 2017, 1.0), (1, 2019, 2.0), (1, 2020, 4.0), (2, 2017, 1.0), (2, 2020, 9.0)], "cell int, yr int, tbd double"
    )
    got = {(r["cell"], r["year1"], r["year2"], r["b1"], r["b2"]) for r in change.transition_pairs(df).collect()}
    assert got == {(1, 2017, 2019, 1.0, 2.0), (1, 2019, 2020, 2.0, 4.0)}


def test_transition_classes_are_strict(spark):
    rows = [(2000, 2001, 10.0, 11.0), (2000, 2001, 10.0, 9.0), (2000, 2001, 10.5, 10.0), (2000, 2001, 100.0, 5.0)]
    df = spark.createDataFrame(rows, "year1 int, year2 int, b1 double, b2 double")
    r = change.transition_statistics(df).first()
    assert (r["n_gain_pixels"], r["n_loss_pixels"], r["n_stable_pixels"]) == (0, 1, 1)
    assert r["transitions_to_zero"] == 1  # exactly 10 is neither above nor below
    assert r["high_loss_transitions"] == 1
    raw = np.array([1.0, -1.0, -0.5, -95.0])
    assert r["std_raw_diff"] == pytest.approx(raw.std())
    assert r["q25_raw_diff"] == pytest.approx(np.percentile(raw, 25))
    assert r["pct_high_losses"] == pytest.approx(100 * 95 / 96.5)


def test_no_losses_gives_zero_shares(spark):
    df = spark.createDataFrame([(2000, 2001, 1.0, 5.0)], "year1 int, year2 int, b1 double, b2 double")
    r = change.transition_statistics(df).first()
    assert (r["pct_losses_to_zero"], r["pct_high_losses"], r["total_losses_Mt"]) == (0.0, 0.0, 0.0)


# --- composites --------------------------------------------------------------


def gap_layer(spark, values, nodata=()):
    rows = [(1, 2017 + i, v, i in nodata) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "cell int, yr int, h double, nd boolean")
    return [(r["h"], r["source"]) for r in composite.gap_fill(df, "cell", "h", "nd").orderBy("yr").collect()]


def test_gap_fill_uses_original_neighbours_only(spark):
    assert gap_layer(spark, [None, 2.0, None, 4.0, None, None]) == [
        (2.0, 2), (2.0, 0), (3.0, 2), (4.0, 0), (None, 3), (None, 3),
    ]


def test_gap_fill_last_year(spark):
    assert gap_layer(spark, [1.0, 5.0, None]) == [(1.0, 0), (5.0, 0), (5.0, 2)]


def test_gap_fill_skips_cells_with_nodata(spark):
    assert gap_layer(spark, [1.0, None, 3.0, None], nodata=(3,)) == [(1.0, 0), (None, 3), (3.0, 0), (None, 1)]


def test_merge_first_is_idempotent(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, None), (1, 3, 9.0)], "cell int, p int, v double")
    once = composite.merge_first(df, ["cell"], "v", ["p"])
    assert once.first()["v"] == 5.0
    again = composite.merge_first(once.withColumn("p", F.lit(0)), ["cell"], "v", ["p"])
    assert again.collect() == once.collect()


def test_best_scenes_prefer_earlier_on_ties(spark):
    df = spark.createDataFrame(
        [(1, "2020-07-01", 80.0), (1, "2020-06-01", 80.0), (1, "2020-08-01", 90.0)], "tile int, d string, validity double"
    ).withColumn("d", F.to_date("d"))
    got = composite.best_scenes(df, ["tile"], "d", 2).orderBy("rank").collect()
    assert [str(r["d"]) for r in got] == ["2020-08-01", "2020-06-01"]
    assert got[0]["span_days"] == 61


# --- catalog -----------------------------------------------------------------


def test_relaxed_search_stops_or_reaches_the_cap(spark):
    rows = [(1, c) for c in (0, 5, 12, 25)] + [(2, 70)] + [(3, 65), (3, 0)]
    df = spark.createDataFrame(rows, "tile int, cloud int")
    got = catalog.relaxed_search(df, ["tile"], "cloud", start=1, step=10, least=3, cap=61).collect()
    limits = {(r["tile"], r["cloud_limit"]) for r in got}
    assert limits == {(1, 21), (3, 61)}
    assert sum(r["tile"] == 1 for r in got) == 3


def test_items_of_unknown_cloud_cover_are_never_found(spark):
    df = spark.createDataFrame([(1, None), (1, 3), (2, None)], "tile int, cloud int")
    got = catalog.relaxed_search(df, ["tile"], "cloud", start=1, step=10, least=1, cap=61).collect()
    assert [(r["tile"], r["cloud"]) for r in got] == [(1, 3)]


def test_product_names(spark):
    names = ["/a/canopy_height_2020_100m_x_code7.tif", "canopy_height_2021_100m.tif", "TBD_S2_mean_2019_100m_merged.tif", "S2_summer_MOSAIC_2018_q_downsampled.tif", "x.tif"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string")
    got = df.orderBy("i").select(*catalog.parse_product_path("p").values()).collect()
    assert [tuple(r)[:3] for r in got] == [("mask", 2020, 7), ("height", 2021, None), ("biomass", 2019, None), ("mosaic", 2018, None), (None, None, None)]
    assert got[0][3] == "canopy_height_2020_100m_x"


def test_paths_with_southern_latitude(spark):
    df = one(spark, "/x/canopy_height_2019_S1.5_W70.0_code12.tif", "p string")
    r = df.select(*[c.alias(n) for n, c in catalog.parse_height_path("p").items()]).first()
    assert (r["year"], r["lat"], r["lon"], r["code"]) == (2019, -1.5, -70.0, 12)


def test_sample_keys(spark):
    df = spark.createDataFrame([("TBD_2017",), ("A_B_2018",), ("2020",)], "k string")
    got = [tuple(r) for r in df.select(*catalog.parse_sample_key("k").values()).collect()]
    assert got == [("TBD", 2017), ("A_B", 2018), ("TBD", 2020)]


# --- climate -----------------------------------------------------------------


def test_effective_year(spark):
    df = spark.createDataFrame([(2001, 8), (2001, 9)], "yr int, mo int")
    assert [r[0] for r in df.select(climate.effective_year()).collect()] == [2000, 2001]


def months(spark, temps, rains):
    return spark.createDataFrame([(1, m + 1, float(t), float(p)) for m, (t, p) in enumerate(zip(temps, rains))], "cell int, mo int, temp double, precip double")


def test_bioclim_by_hand(spark):
    temps = [1.0, 2, 5, 8, 12, 18, 22, 21, 16, 10, 5, 2]
    rains = [30.0, 30, 20, 20, 20, 0, 0, 0, 30, 30, 30, 30]
    r = climate.bioclim(months(spark, temps, rains), ["cell"]).first()
    t, p = np.array(temps), np.array(rains)
    assert r["bio4"] == pytest.approx(t.std() * 100)
    assert (r["bio5"], r["bio6"], r["bio7"]) == (22.0, 1.0, 21.0)
    assert r["bio15"] == pytest.approx(p.std() / p.mean() * 100)
    # autumn (Sep-Nov) and winter (Dec-Feb) are equally wet: the earlier one counts
    assert r["bio16"] == 90.0
    assert r["bio8"] == pytest.approx((16 + 10 + 5) / 3)
    assert r["bio18"] == 0.0


def test_incomplete_year_is_dropped(spark):
    df = months(spark, [1.0] * 12, [1.0] * 12).where("mo <> 4")
    assert climate.bioclim(df, ["cell"]).count() == 0


def test_dry_year_has_no_seasonality(spark):
    assert climate.bioclim(months(spark, [1.0] * 12, [0.0] * 12), ["cell"]).first()["bio15"] == 0.0


def test_rolling_needs_three_consecutive_years(spark):
    df = spark.createDataFrame([(1, y, float(v)) for y, v in ((2000, 1), (2001, 2), (2003, 4), (2004, 5), (2005, 9))], "cell int, eff_year int, b double")
    got = climate.rolling_anomalies(df, ["b"]).collect()
    assert [(r["eff_year"], r["b_2yr"], r["b_3yr"]) for r in got] == [(2005, 7.0, 6.0)]


def test_standardize_centres_constants(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    got = [tuple(r) for r in climate.standardize(df, ["a", "b"]).orderBy("a").collect()]
    assert got[0][0] == pytest.approx(-1 / math.sqrt(2))
    assert [g[1] for g in got] == [0.0, 0.0]


def test_predictors_do_not_match_longer_numbers():
    cols = ["y", "x", "bio1", "bio8", "bio18_2yr", "bio8_3yr", "bio12"]
    assert climate.predictors(cols, "y", ["x"], ["bio8", "bio18"]) == ["bio1", "bio12"]


# --- inventory and space -----------------------------------------------------


def test_wood_density_levels(spark):
    species = spark.createDataFrame([(1, "Pinus a"), (2, "Pinus z"), (3, "Acer x"), (4, "Pinus n")], "code int, binomial string")
    dens = spark.createDataFrame([("Pinus a", 0.4), ("Pinus a", 0.6), ("Pinus b", 0.8), ("Pinus n", None)], "binomial string, density double")
    got = {r["code"]: (r["level"], r["density"]) for r in inventory.wood_density(species, dens).collect()}
    assert got[1] == ("species", 0.5)
    assert got[2] == ("genus", pytest.approx(0.6))
    assert got[3] == ("all", pytest.approx(0.6))
    assert got[4] == ("species", None)


def test_chain_stops_at_missing_parent(spark):
    types = spark.createDataFrame([("T1",), ("No arbolado",), ("Elsewhere",)], "type_name string")
    parents = spark.createDataFrame([("T1", "G1", None, "C1")], "name string, genus string, family string, clade string")
    got = {}
    for r in inventory.tier_chain(types, parents).collect():
        got.setdefault(r["type_name"], set()).add(r["tier"])
    assert got == {"T1": {4, 3, 0}, "No arbolado": {0}, "Elsewhere": {4, 0}}


def test_resolution_defaults_to_zero(spark):
    chain = spark.createDataFrame([("T1", 4, "T1"), ("T1", 0, "General")], "type_name string, tier int, tier_name string")
    fitted = spark.createDataFrame([(0, "Other", 2.0)], "tier int, tier_name string, a double")
    assert inventory.resolve_parameters(chain, fitted, ["a"], "p").first()["p_a"] == 0.0


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


POLY = "poly_id int, label string, ring array<struct<x:double,y:double>>"


def test_point_in_concave_polygon_with_boundary(spark):
    # an L shape; (3, 3) lies in the notch
    shape = ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0))
    polys = spark.createDataFrame([(1, "L", shape)], POLY)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 2.0, 3.0), (4, 0.0, 0.0), (5, 4.1, 1.0)], "id int, x double, y double")
    got = {r["id"] for r in spatial.points_with_polygons(pts, polys, ["label"], 1.5, "inner").collect()}
    assert got == {1, 3, 4}


def test_overlapping_polygons_duplicate_points(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    polys = spark.createDataFrame([(1, "a", square), (2, "b", square)], POLY)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "id int, x double, y double")
    got = [(r["id"], r["label"]) for r in spatial.points_with_polygons(pts, polys, ["label"], 1.0).collect()]
    assert sorted(got, key=str) == [(1, "a"), (1, "b"), (2, None)]
    assert spatial.points_with_polygons(pts, polys, [], 1.0, "left_semi").count() == 1


def test_ring_validity_and_area(spark):
    rows = [(1, "ok", ring((0, 0), (2, 0), (2, 3), (0, 0))), (2, "open", ring((0, 0), (2, 0), (2, 3), (0, 3))), (3, "short", ring((0, 0), (1, 1), (0, 0)))]
    df = spark.createDataFrame(rows, POLY)
    kept = tables.unite_layers([df, df.drop("label").withColumn("poly_id", F.col("poly_id") + 10)], "label", "none", "poly_id", 10.0)
    assert {(r["poly_id"], r["label"]) for r in kept.collect()} == {(1, "ok"), (11, "none")}
    assert kept.select(spatial.ring_area()).first()[0] == 3.0


def test_box_pairs_once_against_brute_force(spark):
    rng = np.random.default_rng(3)

    def boxes(n):
        low = rng.uniform(0, 50, (n, 2))
        size = rng.uniform(0, 20, (n, 2))
        return [(i, *map(float, (a[0], a[0] + s[0], a[1], a[1] + s[1]))) for i, (a, s) in enumerate(zip(low, size))]

    left, right = boxes(30), boxes(30)
    ddl = "id int, x_min double, x_max double, y_min double, y_max double"
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl).withColumnRenamed("id", "other")
    got = [tuple(r) for r in spatial.boxes_overlapping(a, b, ["id"], ["other"], 7.0).collect()]
    want = {(p[0], q[0]) for p in left for q in right if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]}
    assert len(got) == len(want)
    assert set(got) == want


@pytest.mark.parametrize("references", [1000, 25])
def test_lag_sums_against_brute_force(spark, references):
    rng = np.random.default_rng(4)
    places = [(int(r), int(c)) for r, c in rng.integers(-9, 9, (150, 2))]
    cells = {(g, r, c): float(rng.normal()) for g in (1, None) for r, c in places}
    rows = [(*k, v) for k, v in cells.items()] + [(1, 50, 50, None), (2, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "g int, r int, c int, v double").repartition(3)
    got = {(x["g"], x["lag"]): (x["n_pairs"], x["gamma_sum"]) for x in variogram.lag_sums(df, ["g"], "v", 5, references).collect()}
    known = df.where("v IS NOT NULL").select("g", "r", "c")
    chosen = {tuple(x) for x in variogram.ranking.sample_exact(known, ["g"], ["r", "c"], references, 17).collect()}
    want = {}
    for (g, r, c), v in cells.items():
        for (h, s, d), w in cells.items():
            lag = (r - s) ** 2 + (c - d) ** 2
            if g == h and 0 < lag <= 25 and (g, r, c) in chosen:
                n, total = want.get((g, lag), (0, 0.0))
                want[g, lag] = (n + 1, total + 0.5 * (v - w) ** 2)
    assert set(got) == set(want)
    for k, (n, total) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(total)


def test_lag_sums_of_no_cells(spark):
    assert variogram.lag_sums(spark.createDataFrame([], "g int, r int, c int, v double"), ["g"], "v", 5).count() == 0


def test_exponential_fit_recovers_parameters(spark):
    rows = [(1, float(h), 2.0 + 8.0 * (1 - math.exp(-h / 300.0))) for h in range(50, 2000, 50)]
    df = spark.createDataFrame(rows, "g int, distance double, semivariance double")
    r = variogram.fit_exponential(df, ["g"], range(100, 600, 50)).first()
    assert (r["range"], r["nugget"], r["sill"]) == (300.0, pytest.approx(2.0), pytest.approx(10.0))


def test_bilinear_keeps_constants_and_planes(spark):
    cells = spark.range(400).select(
        F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c")
    ).withColumns({"k": F.lit(7.0), "p": F.col("c") * 2.0 + F.col("r")})
    bounds = spark.createDataFrame([(300.0, 1700.0, 300.0, 1700.0)], "x_left double, x_right double, y_bottom double, y_top double")
    tiles = grid.tile_grid(bounds, 130.0)
    flat = grid.regrid_bilinear(tiles, cells, "k", 0.0, 2000.0, 100.0)
    assert {round(r["k"], 9) for r in flat.collect()} == {7.0}
    plane = grid.regrid_bilinear(tiles, cells, "p", 0.0, 2000.0, 100.0).join(tiles, ["tr", "tc"]).collect()
    for r in plane:
        cx, cy = (r["x_min"] + r["x_max"]) / 200 - 0.5, (2000 - (r["y_min"] + r["y_max"]) / 2) / 100 - 0.5
        assert r["p"] == pytest.approx(2 * cx + cy)


def test_utm_known_point_and_round_trip(spark):
    # the zone's central meridian on the equator is the false origin
    df = spark.createDataFrame([(-3.0, 0.0), (-3.7038, 40.4168)], "lon double, lat double")
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), F.lit(30))
    there = df.withColumns({"e": east, "n": north})
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), F.lit(30))
    rows = there.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert (rows[0]["e"], rows[0]["n"]) == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6))
    # Madrid, Puerta del Sol: 440290 E, 4474250 N to the metre scale of the coordinates
    assert rows[1]["e"] == pytest.approx(440290, abs=60)
    assert rows[1]["n"] == pytest.approx(4474250, abs=60)
    for r in rows:
        assert (r["lon2"], r["lat2"]) == (pytest.approx(r["lon"], abs=1e-9), pytest.approx(r["lat"], abs=1e-9))


# --- Monte Carlo -------------------------------------------------------------


def test_noise_is_standard_normal_and_independent(spark):
    df = spark.range(20000).select(noise.normal(7, "id").alias("a"), noise.normal(8, "id").alias("b"))
    r = df.agg(F.avg("a").alias("m"), F.stddev("a").alias("s"), F.corr("a", "b").alias("c")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03 and abs(r["c"]) < 0.03


def test_cell_monte_carlo_meets_the_analytic_moments(spark):
    df = spark.createDataFrame([(i, 100.0, 10.0, 0.3, 0.05) for i in range(40)], "cell int, p50 double, agb_sd double, ratio_mean double, ratio_sd double")
    r = montecarlo.cell_monte_carlo(df, ["cell"], draws=1000).agg(
        *[F.avg(c).alias(c) for c in ("agbd_mean", "agbd_uncertainty", "bgbd_mean", "bgbd_uncertainty", "tbd_mean")]
    ).first()
    sd_bgb = math.sqrt((100**2 + 10**2) * (0.3**2 + 0.05**2) - (100 * 0.3) ** 2)
    assert r["agbd_mean"] == pytest.approx(100, rel=0.002)
    assert r["agbd_uncertainty"] == pytest.approx(19.6, rel=0.02)
    assert r["bgbd_mean"] == pytest.approx(30, rel=0.005)
    assert r["bgbd_uncertainty"] == pytest.approx(1.96 * sd_bgb, rel=0.03)
    assert r["tbd_mean"] == pytest.approx(r["agbd_mean"] + r["bgbd_mean"])


def test_country_total_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    cells = [(1, int(i // 12), int(i % 12), float(m), float(u)) for i, (m, u) in enumerate(rng.uniform([0, 0], [30, 60], (144, 2)))]
    cells += [(1, 0, 13, -4.0, 0.0), (1, 0, 14, 9.0, 0.0), (1, 1, 13, -900.0, 1.0), (1, 1, 14, None, 1.0)]
    df = spark.createDataFrame(cells, "yr int, r int, c int, m double, u double")
    got = {r["sample"]: r["total"] for r in montecarlo.country_samples(df, ["yr"], "m", "u", 5, 50, 42).collect()}
    blocks = {(r // 5, c // 5) for _, r, c, m, u in cells}
    z = {}
    for br, bc in blocks:
        draws = spark.range(50).select("id", noise.normal(42, F.lit(br), F.lit(bc), "id").alias("z")).collect()
        z |= {(br, bc, d["id"]): d["z"] for d in draws}
    for s in (0, 7, 49):
        want = sum(max(m + z[(r // 5, c // 5, s)] * u / 1.96, 0) for _, r, c, m, u in cells if m is not None)
        assert got[s] == pytest.approx(want / 1e6, rel=1e-9)


def test_country_totals_move_sums_alone_and_keep_null_keys(spark, monkeypatch):
    monkeypatch.setattr(montecarlo, "HELD", 2)
    monkeypatch.setattr(montecarlo, "RUN", 3)
    cells = [(k, "a" if i % 2 else None, i // 6, i % 6, float(i), 20.0) for k in (1, 2, None) for i in range(36)] + [(1, "a", None, 3, 9.0, 9.0)]
    df = spark.createDataFrame(cells, "yr int, p string, r int, c int, m double, u double")
    found = montecarlo.country_samples(df, ["yr", "p"], "m", "u", 3, 10, 7)
    got = {(r["yr"], r["p"], r["sample"]): r["total"] for r in found.collect()}
    assert len(got) == 3 * 2 * 10
    for (yr, p, k), total in got.items():
        mine = [c for c in cells if c[:2] == (yr, p) and c[2] is not None]
        want = sum(max(m + montecarlo.block_normals(7, r // 3, c // 3, 10)[k] * u / 1.96, 0) for *_, r, c, m, u in mine)
        assert total == pytest.approx(want / 1e6, rel=1e-9)
    # no row per block and draw exists
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "Window" not in text


def test_flux_draws_with_replacement_from_both_years(spark):
    df = spark.createDataFrame([(y, i, float(y * 10 + i)) for y in (1, 2) for i in range(20)], "yr int, sample int, total double")
    r = montecarlo.interannual_flux(df, combinations=10000).first()
    assert r["n_samples"] == 20
    assert -5 <= r["min_flux"] <= r["mean_flux"] <= r["max_flux"] <= 15


# --- series and metrics ------------------------------------------------------


def test_flux_first_year_is_zero(spark):
    df = spark.createDataFrame([(2017, 10.0), (2018, 12.0), (2019, 9.0)], "yr int, carbon double")
    got = series.annual_flux(df, [], "carbon").orderBy("yr").collect()
    assert [r["annual_flux"] for r in got] == [0.0, 2.0, -3.0]
    assert [r["cumulative_flux"] for r in got] == [0.0, 2.0, -1.0]


def test_early_stop_counts_from_min_trials(spark):
    values = [0.1, 0.5, 0.2, 0.3, 0.6, 0.1, 0.2, 0.3]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "s int, t int, v double")
    r = series.early_stop(df, ["s"], "t", "v", patience=2, min_trials=2).first()
    assert (r["stop_trial"], r["last_best_trial"]) == (3, 4)


def test_knee_of_a_corner(spark):
    df = spark.createDataFrame([(1, float(x), min(float(x), 3.0)) for x in range(11)], "g int, x double, y double")
    assert series.knee(df, ["g"], "x", "y", increasing=True).first()["knee_x"] == 3.0


def test_empty_range_reports_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "target double, pred double")
    got = {r["range_name"]: (r["n"], r["mae"]) for r in metrics.by_range(df, [(0, 2), (2, 6)]).collect()}
    assert got == {"h_0_2": (1, 1.0), "h_2_6": (0, 0.0)}


def test_poisson_weights_have_mean_and_variance_one():
    limits = np.array([math.ceil(s * metrics.PRIME - 0.5) for s in metrics.POISSON_STEPS])
    w = metrics.poisson_weights(np.arange(40000), np.array([3]), limits).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.03)
    assert w.var() == pytest.approx(1, abs=0.05)


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(t), float(e)) for i, (t, e) in enumerate(zip(rng.uniform(0, 40, 2000), rng.normal(0.5, 2, 2000)))]
    df = spark.createDataFrame(rows, "id int, target double, residual double")
    got = {r["metric"]: (r["lower"], r["upper"]) for r in metrics.bootstrap_intervals(df, ["id"], 200).collect()}
    rmse = math.sqrt(np.mean([e * e for _, _, e in rows]))
    assert got["rmse"][0] < rmse < got["rmse"][1]
    # normal-theory half width of an RMSE is about 1.96 rmse / sqrt(2 n)
    assert got["rmse"][1] - got["rmse"][0] == pytest.approx(2 * 1.96 * rmse / math.sqrt(4000), rel=0.35)


def test_bootstrap_width_is_that_of_independent_resamples(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(t), float(e)) for i, (t, e) in enumerate(zip(rng.uniform(0, 40, 2000), rng.normal(0, 2, 2000)))]
    df = spark.createDataFrame(rows, "id int, target double, residual double")
    widths = []
    for seed in range(6):
        got = {r["metric"]: r["upper"] - r["lower"] for r in metrics.bootstrap_intervals(df, ["id"], 400, seed).collect()}
        widths.append(got["rmse"])
    theory = 2 * 1.96 * 2 / math.sqrt(4000)
    assert max(abs(w - theory) for w in widths) < 0.25 * theory
    assert np.std(widths) < 0.1 * theory


def test_diverse_batches_equal_a_plain_walk(spark):
    rng = np.random.default_rng(12)
    rows = [(k, i, 0, float(rng.uniform(0, 13)), float(rng.uniform(0.3, 1)), float(rng.uniform(0, 1))) for k in (1, None) for i in range(70)]
    rows += [(2, i, 0, None if i else 20.0, 1.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, pr int, pc int, diversity double, valid_ratio double, low_ratio double").repartition(3)
    place = {(r["k"], r["pr"]): r["u"] for r in df.select("k", "pr", metrics.uniform(3, "k", "pr", "pc").alias("u")).collect()}
    want = set()
    for k in (1, 2, None):
        order = sorted((r for r in rows if r[0] == k), key=lambda r: place[k, r[1]])
        for b in range(0, len(order), 30):
            block, chosen, passed, tried = order[b : b + 30], 0, [], []
            for a, (_, pr, _, d, valid, lowveg) in enumerate(block):
                if chosen == 6:
                    break
                p = a / len(block)
                ease = 3 if p > 0.75 else 1.5 if p > 0.5 else 1
                ask = 10.0
                for start, share, level in ((0.25, 0.25, 8.25), (0.5, 0.5, 6.5), (0.75, 0.75, 3.0), (0.9, 1.0, 3.0)):
                    ask = level if p > start and chosen <= 6 * share else ask
                good = d is not None and d >= ask and (p > 0.9 or (valid >= 1 - 0.3 * ease and lowveg <= 0.7 * ease))
                (passed if good else tried).append(a)
                chosen += good
            rest = [a for a in range(len(block)) if a not in passed and a not in tried]
            for pick, a in enumerate((passed + tried + rest)[:6], 1):
                want.add((k, b // 30, a, block[a][1], a in passed, pick))
    got = metrics.diverse_patches(df, ["k"], 6, 30, 3)
    assert {(r["k"], r["batch"], r["attempt"], r["pr"], r["passed"], r["pick"]) for r in got.collect()} == want


def test_bootstrap_weights_are_poisson_and_independent():
    limits = np.array([math.ceil(s * metrics.PRIME - 0.5) for s in metrics.POISSON_STEPS])
    keys = np.arange(4000) * 8 + 1  # keys as regular as order numbers
    w = metrics.poisson_weights(keys, np.arange(200), limits).astype(float)
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.002)
    # neither rows nor replicates follow one another
    rows, replicates = np.corrcoef(w[:300]), np.corrcoef(w.T)
    for r, n in ((rows, 200), (replicates, 4000)):
        off = r[~np.eye(len(r), dtype=bool)]
        assert off.std() == pytest.approx(1 / math.sqrt(n), rel=0.1) and abs(off).max() < 6 / math.sqrt(n)
    # exact remainders
    x = np.array([0, metrics.PRIME, metrics.PRIME - 1, 2**62 - 1, metrics.PRIME**2, 12345678901234567])
    assert [int(v) % metrics.PRIME for v in metrics.folded(x.copy())] == [int(v) % metrics.PRIME for v in x]
    assert metrics.folded(x.copy()).max() <= metrics.PRIME


def test_kolmogorov_tail_probabilities(spark):
    # tabulated values of the Kolmogorov distribution: 1 - K(l)
    known = {0.0: 1.0, 0.1: 1.0, 0.5: 0.9639452436, 0.8275735552: 0.5, 1.0: 0.2699996717, 1.2238478702: 0.1, 1.3580986394: 0.05, 1.6276236115: 0.01, 3.0: 3.04599e-08}
    df = spark.createDataFrame([(x,) for x in known], "l double")
    n = F.lit(2000.0)
    p = distributions.kolmogorov_p(F.col("l") / F.sqrt(n / 2), n, n)
    for r in df.select("l", p.alias("p")).collect():
        assert r["p"] == pytest.approx(known[r["l"]], abs=1e-8)


def test_incomplete_plots_are_left_out(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 3.0, 1.0), (2, None, 1.0), (2, 1.0, 1.0), (None, 4.0, None)], "k int, agb double, bgb double")
    got = {r["k"]: (r["agb"], r["bgb"]) for r in inventory.plot_totals(df, ["k"], complete=True).collect()}
    assert got == {1: (5.0, 1.0), None: (4.0, 0.0)}


def star(n, x, y, seed):
    """A closed ring with very many edges around (x, y)."""
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = rng.uniform(200, 900, n)
    ring = [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(turn, far)]
    return [*ring, ring[0]]


def within(px, py, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            odd = not odd
    return odd


RINGS = "array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize("size", [90.0, 400.0])
def test_points_in_parts_and_outside_holes(spark, size):
    # a part with a hole, an island in the hole, and a second part; one polygon without holes
    def shrunk(ring, x, y, by):
        return [(x + (a - x) * by, y + (b - y) * by) for a, b in ring]

    outer = star(60, 1000.0, 1000.0, 1)
    first = [outer, shrunk(outer, 1000.0, 1000.0, 0.6), shrunk(outer, 1000.0, 1000.0, 0.3), star(20, 3000.0, 900.0, 2)]
    polygons = {"a": first, "b": [star(12, 1900.0, 1100.0, 3)]}
    rng = np.random.default_rng(5)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 4000, (900, 2)))]
    layer = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in polygons.items()], f"id string, rings {RINGS}")
    got = spatial.points_with_polygons(spark.createDataFrame(points, "i int, x double, y double"), layer, ["id"], size, "inner")
    want = {(i, k) for i, x, y in points for k, rings in polygons.items() if sum(within(x, y, r) for r in rings) % 2}
    assert {(r["i"], r["id"]) for r in got.collect()} == want and len({k for _, k in want}) == 2
    assert spatial.valid_polygons(layer, "id", size).count() == 2


@pytest.mark.parametrize("size", [1.0, 3.0, 50.0])
def test_crossing_outlines_are_invalid(spark, size):
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]

    def moved(ring, dx, dy):
        return [(x + dx, y + dy) for x, y in ring]

    cases = {
        "square": ([square], True),
        "hole": ([square, hole], True),
        "hole touches in a point": ([square, [(0.0, 3.0), (2.0, 2.0), (2.0, 4.0), (0.0, 3.0)]], True),
        "parts touch in a corner": ([square, moved(square, 8.0, 8.0)], True),
        "star": ([star(80, 0.0, 0.0, 4)], True),
        "bow tie": ([[square[i] for i in (0, 2, 1, 3, 4)]], False),
        "hole across the border": ([square, moved(hole, 5.0, 0.0)], False),
        "shared border": ([square, moved(square, 8.0, 0.0)], False),
        "folded back": ([[(0.0, 0.0), (8.0, 0.0), (3.0, 0.0), (3.0, 5.0), (0.0, 0.0)]], False),
        "touches itself": ([[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 0.0), (0.0, 8.0), (0.0, 0.0)]], False),
        "open": ([square[:4]], False),
        "stuck": ([[square[0], *square]], False),
        "open hole": ([square, hole[:3]], False),
        "none": (None, False),
    }
    rows = [(k, rings and [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, (rings, _) in cases.items()]
    got = spatial.valid_polygons(spark.createDataFrame(rows, f"id string, rings {RINGS}"), "id", size if size > 1 else 1.5)
    assert {r["id"] for r in got.collect()} == {k for k, (_, good) in cases.items() if good}


@pytest.mark.parametrize("size", [60.0, 250.0, 5000.0])
def test_points_in_outlines_of_many_edges(spark, size):
    rings = {1: star(500, 0, 0, 1), 2: star(7, 300, -200, 2), 3: [(-400.0, -400.0), (500.0, -400.0), (500.0, 500.0), (-400.0, 500.0), (-400.0, -400.0)]}
    polygons = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in rings.items()], "id int, ring array<struct<x:double,y:double>>")
    rng = np.random.default_rng(5)
    where = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1000, 1000, (1500, 2)))] + [(9000, 500.0, 0.0), (9001, -400.0, -400.0)]
    points = spark.createDataFrame(where, "p int, x double, y double")
    got = {(r["p"], r["id"]) for r in spatial.points_with_polygons(points, polygons, ["id"], size).collect() if r["id"]}
    want = {(p, i) for p, x, y in where[:-2] for i, r in rings.items() if within(x, y, r)}
    assert {g for g in got if g[0] < 9000} == want
    assert (9000, 3) in got and (9001, 3) in got
    clipped = spatial.points_with_polygons(points, polygons, [], size, "left_semi")
    assert {r["p"] for r in clipped.collect()} == {p for p, _ in got}


def test_buckets_carry_local_edges_only(spark):
    ring = star(2000, 0, 0, 3)
    polygons = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "id int, ring array<struct<x:double,y:double>>")
    sizes = [r["n"] for r in spatial.polygon_buckets(polygons, ["id"], 20.0).select(F.size("edges").alias("n")).where("n >= 0").collect()]
    assert max(sizes) < 700 and np.mean(sizes) < 250


# --- sinks -------------------------------------------------------------------


def test_shared_folder_is_required_beyond_one_process():
    from types import SimpleNamespace

    from sylvagrid.session import shared_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert shared_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))


def test_partitioned_write_round_trip(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("yr"), F.col("id").alias("v"))
    path = tables.write_partitioned(df, str(tmp_path / "p"), ["yr"])
    assert spark.read.parquet(path).where("yr = 1").count() == 33
    path = tables.write_skewed(df, str(tmp_path / "s"), ["yr"], "v", 3)
    assert spark.read.parquet(path).agg(F.sum("v")).first()[0] == 4950


def test_result_table_is_one_csv(spark, tmp_path):
    path = tables.write_table(spark.createDataFrame([(1, "a")], "k int, s string"), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.csv"))) == 1
    assert spark.read.option("header", True).csv(path).first()["s"] == "a"
