"""Physical plans: what is pushed down, what is read, what is shuffled."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sylvagrid.operators import composite, montecarlo, spatial, zonal
from sylvagrid.plans.views import Views
from sylvagrid.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Views(spark, SF).cells.select("cell", "yr", "height"))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    text = plan(Views(spark, SF).cells.where("cell < 100"))
    assert "PushedFilters: [IsNotNull(l_partkey)" in text or "cast(l_partkey" in text


def test_zonal_sum_combines_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("z"), F.col("id").cast("double").alias("v"))
    text = plan(zonal.zonal_sum(df, ["z"], "v"))
    assert text.count("Exchange") == 1
    assert "partial_sum" in text


def test_monte_carlo_shuffles_cells_not_draws(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], "cell int, p50 double, agb_sd double, ratio_mean double, ratio_sd double")
    text = plan(montecarlo.cell_monte_carlo(df, ["cell"], 50))
    assert text.count("Exchange") == 1
    assert text.index("Generate explode") < text.index("Exchange")  # printed from the top: the exchange lies below


def test_gap_fill_shuffles_once(spark):
    df = spark.createDataFrame([(1, 2017, 1.0, False)], "cell int, yr int, h double, nd boolean")
    text = plan(composite.gap_fill(df, "cell", "h", "nd"))
    body = text.split("Subquery")[0] + text.split("Generate", 1)[1]
    assert "Window" not in text
    assert body.count("Exchange hashpartitioning(cell") == 1


def test_spatial_join_is_an_equi_join(spark):
    v = Views(spark, SF)
    text = plan(spatial.points_with_polygons(v.plots, v.rings, ["label"], 1000.0))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_bucketed_layers_join_without_a_shuffle(spark, tmp_path):
    cells = spark.range(2000).select(F.col("id").alias("cell"), (F.col("id") * 0.5).alias("v"))
    tables.write_layer(cells, "layer_a", "cell", 4, str(tmp_path / "a"))
    tables.write_layer(cells.withColumnRenamed("v", "t"), "layer_b", "cell", 4, str(tmp_path / "b"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("layer_a").join(spark.table("layer_b"), "cell")
        assert "Exchange" not in plan(joined)
        assert joined.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE layer_a")
        spark.sql("DROP TABLE layer_b")


@pytest.mark.parametrize("key", ["point_in_polygon", "transition_pairs", "semivariogram_pairs", "work_plan", "missing_tiles", "mc_country_total"])
def test_no_cross_joins(spark, key):
    text = plan(entry.queries()[key](spark, SF))
    assert "Cartesian" not in text and "NestedLoop" not in text
