"""Domain layers derived from the input tables.

`Views` builds them with the DataFrame API; `VIEW_SQL` states the same layers as
SQL for the checks. Inputs with fixed decimals are summed as scaled integers and
divided once, so both sides hold bit-equal doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW_SQL = {
    "fx_types": """SELECT DISTINCT b AS code, concat('T', CAST(b AS VARCHAR)) AS name,
        concat('G', CAST(b % 8 AS VARCHAR)) AS genus, concat('F', CAST(b % 4 AS VARCHAR)) AS family,
        concat('C', CAST(b % 2 AS VARCHAR)) AS clade
        FROM (SELECT CAST(substr(p_brand, 7) AS INT) AS b FROM part) q""",
    "fx_grid": """SELECT CAST(p_partkey AS INT) AS cell, CAST(floor(p_partkey / 5e1) AS INT) AS r,
        CAST(p_partkey % 50 AS INT) AS c, 5e5 + (p_partkey % 50 + 5e-1) * 1e2 AS x,
        45e5 - (floor(p_partkey / 5e1) + 5e-1) * 1e2 AS y, CAST(substr(p_brand, 7) AS INT) AS type_code,
        p_size AS landcover FROM part""",
    "fx_cells": """SELECT CAST(l_partkey AS INT) AS cell, CAST(floor(l_partkey / 5e1) AS INT) AS r,
        CAST(l_partkey % 50 AS INT) AS c, CAST(year(l_shipdate) AS INT) AS yr,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS height,
        CAST(sum(CAST(round(l_extendedprice * 1e2) AS BIGINT)) AS DOUBLE) / (count(*) * 1e4) AS tbd,
        CAST(sum(CAST(round(l_discount * 1e2) AS BIGINT) * CAST(round(l_extendedprice * 1e2) AS BIGINT)) AS DOUBLE)
            / (count(*) * 1e6) + 1e0 AS tbd_unc
        FROM lineitem GROUP BY l_partkey, year(l_shipdate)""",
    "fx_climate": """SELECT CAST(l_suppkey AS INT) AS cell, CAST(year(l_shipdate) AS INT) AS yr,
        CAST(month(l_shipdate) AS INT) AS mo,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) - 1e1 AS temp,
        CAST(sum(CAST(round(l_tax * 1e2) AS BIGINT)) AS DOUBLE) AS precip
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)""",
    "fx_scenes": """SELECT CAST(l_suppkey % 20 AS INT) AS tile, CAST(l_shipdate AS DATE) AS scene_date,
        CAST(year(l_shipdate) AS INT) AS yr, CAST(l_partkey % 100 AS INT) AS px,
        CAST(l_linenumber + 1 AS INT) AS scl, l_extendedprice / 1e1 AS red, l_quantity * 1e2 AS nir
        FROM lineitem""",
    "fx_catalog": """SELECT o_orderkey AS item_id, CAST(o_custkey % 20 AS INT) AS tile,
        CAST(o_orderdate AS DATE) AS item_date, CAST(year(o_orderdate) AS INT) AS yr,
        CAST(floor(o_totalprice) AS BIGINT) % 100 AS cloud FROM orders""",
    "fx_plots": """SELECT o_orderkey AS estadillo, CAST(c_nationkey AS INT) AS provincia,
        CAST(year(o_orderdate) AS INT) AS yr, 5e5 + o_orderkey % 5000 AS x, 45e5 - (o_orderkey * 7) % 4000 AS y
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_trees": """SELECT l_orderkey AS estadillo, CAST(substr(p_brand, 7) AS INT) AS especie, l_quantity AS vcc,
        l_quantity * l_tax AS vle,
        CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE l_extendedprice / 1e2 END AS ba,
        l_extendedprice * (2e-1 + l_discount) / 1e2 AS br
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_polygons": """SELECT CAST(n_nationkey AS INT) AS poly_id, n_name AS label,
        5e5 + (n_nationkey % 5) * 1e3 AS x_min, 5e5 + (n_nationkey % 5) * 1e3 + 11e2 AS x_max,
        45e5 - (floor(n_nationkey / 5e0) + 1) * 8e2 AS y_min, 45e5 - floor(n_nationkey / 5e0) * 8e2 AS y_max
        FROM nation""",
    "fx_pred": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 13e-1 AS target,
        l_quantity * 13e-1 + (l_discount - 5e-2) * 1e2 AS pred FROM lineitem""",
    # one fitted model per order: a run of the customer's search, scored by the order total
    "fx_models": """SELECT o_orderkey AS run_id, o_custkey AS study,
        CAST(CAST(round(o_totalprice * 1e2) AS BIGINT) % 1000 AS DOUBLE) / 1e3 AS val_r2,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL
             ELSE CAST(CAST(round(o_totalprice * 1e2) AS BIGINT) % 700 AS DOUBLE) / 1e3 END AS test_r2
        FROM orders""",
    # the features that model selected
    "fx_model_features": """SELECT DISTINCT l_orderkey AS run_id,
        concat('bio', CAST(l_partkey % 19 + 1 AS VARCHAR),
               CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_2yr' ELSE '_3yr' END) AS feature
        FROM lineitem""",
}


class Views:
    """Input tables (`t`) and the derived layers, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def types(self) -> DataFrame:
        b = F.col("b")

        def tag(prefix, value):
            return F.concat(F.lit(prefix), value.cast("string"))

        return (
            self.t("part")
            .select(F.substring("p_brand", 7, 10).cast("int").alias("b"))
            .distinct()
            .select(
                b.alias("code"),
                tag("T", b).alias("name"),
                tag("G", b % 8).alias("genus"),
                tag("F", b % 4).alias("family"),
                tag("C", b % 2).alias("clade"),
            )
        )

    @cached_property
    def grid(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.t("part").select(
            key.cast("int").alias("cell"),
            F.floor(key / 50.0).cast("int").alias("r"),
            (key % 50).cast("int").alias("c"),
            (F.lit(5e5) + (key % 50 + F.lit(0.5)) * 1e2).alias("x"),
            (F.lit(45e5) - (F.floor(key / 50.0) + F.lit(0.5)) * 1e2).alias("y"),
            F.substring("p_brand", 7, 10).cast("int").alias("type_code"),
            F.col("p_size").alias("landcover"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        cents = F.round(F.col("l_extendedprice") * 1e2).cast("bigint")
        points = F.round(F.col("l_discount") * 1e2).cast("bigint")
        n = F.count(F.lit(1))
        return (
            self.t("lineitem")
            .groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("yr"))
            .agg(
                (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / n).alias("height"),
                (F.sum(cents).cast("double") / (n * 1e4)).alias("tbd"),
                (F.sum(points * cents).cast("double") / (n * 1e6) + 1.0).alias("tbd_unc"),
            )
            .select(
                F.col("k").cast("int").alias("cell"),
                F.floor(F.col("k") / 50.0).cast("int").alias("r"),
                (F.col("k") % 50).cast("int").alias("c"),
                "yr",
                "height",
                "tbd",
                "tbd_unc",
            )
        )

    @cached_property
    def climate(self) -> DataFrame:
        return (
            self.t("lineitem")
            .groupBy(
                F.col("l_suppkey").cast("int").alias("cell"),
                F.year("l_shipdate").alias("yr"),
                F.month("l_shipdate").alias("mo"),
            )
            .agg(
                (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count(F.lit(1)) - 10.0).alias("temp"),
                F.sum(F.round(F.col("l_tax") * 1e2).cast("bigint")).cast("double").alias("precip"),
            )
        )

    @cached_property
    def scenes(self) -> DataFrame:
        return self.t("lineitem").select(
            (F.col("l_suppkey") % 20).cast("int").alias("tile"),
            F.col("l_shipdate").cast("date").alias("scene_date"),
            F.year("l_shipdate").alias("yr"),
            (F.col("l_partkey") % 100).cast("int").alias("px"),
            (F.col("l_linenumber") + 1).alias("scl"),
            (F.col("l_extendedprice") / 10.0).alias("red"),
            (F.col("l_quantity") * 1e2).alias("nir"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("item_id"),
            (F.col("o_custkey") % 20).cast("int").alias("tile"),
            F.col("o_orderdate").cast("date").alias("item_date"),
            F.year("o_orderdate").alias("yr"),
            (F.floor("o_totalprice").cast("bigint") % 100).alias("cloud"),
        )

    @cached_property
    def plots(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.t("orders")
            .join(self.t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("estadillo"),
                F.col("c_nationkey").cast("int").alias("provincia"),
                F.year("o_orderdate").alias("yr"),
                (F.lit(5e5) + key % 5000).alias("x"),
                (F.lit(45e5) - (key * 7) % 4000).alias("y"),
            )
        )

    @cached_property
    def trees(self) -> DataFrame:
        lost = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
        return (
            self.t("lineitem")
            .join(self.t("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("estadillo"),
                F.substring("p_brand", 7, 10).cast("int").alias("especie"),
                F.col("l_quantity").alias("vcc"),
                (F.col("l_quantity") * F.col("l_tax")).alias("vle"),
                F.when(~lost, F.col("l_extendedprice") / 1e2).alias("ba"),
                (F.col("l_extendedprice") * (F.lit(0.2) + F.col("l_discount")) / 1e2).alias("br"),
            )
        )

    @cached_property
    def polygons(self) -> DataFrame:
        key = F.col("n_nationkey")
        column, band = (key % 5) * 1e3, F.floor(key / 5.0)
        return self.t("nation").select(
            key.cast("int").alias("poly_id"),
            F.col("n_name").alias("label"),
            (F.lit(5e5) + column).alias("x_min"),
            (F.lit(5e5) + column + F.lit(1.1e3)).alias("x_max"),
            (F.lit(45e5) - (band + 1) * 8e2).alias("y_min"),
            (F.lit(45e5) - band * 8e2).alias("y_max"),
        )

    @cached_property
    def rings(self) -> DataFrame:
        """The polygons as closed rings."""

        def corner(x, y):
            return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

        ring = F.array(
            corner("x_min", "y_min"),
            corner("x_max", "y_min"),
            corner("x_max", "y_max"),
            corner("x_min", "y_max"),
            corner("x_min", "y_min"),
        )
        return self.polygons.select("poly_id", "label", ring.alias("ring"))

    @cached_property
    def pred(self) -> DataFrame:
        target = F.col("l_quantity") * 1.3
        return self.t("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            target.alias("target"),
            (target + (F.col("l_discount") - F.lit(0.05)) * 1e2).alias("pred"),
        )

    @cached_property
    def models(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 1e2).cast("bigint")
        return self.t("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("study"),
            ((cents % 1000).cast("double") / 1e3).alias("val_r2"),
            F.when(F.col("o_orderkey") % 5 != 0, (cents % 700).cast("double") / 1e3).alias("test_r2"),
        )

    @cached_property
    def model_features(self) -> DataFrame:
        lag = (
            F.when(F.col("l_suppkey") % 3 == 0, "")
            .when(F.col("l_suppkey") % 3 == 1, "_2yr")
            .otherwise("_3yr")
        )
        return (
            self.t("lineitem")
            .select(
                F.col("l_orderkey").alias("run_id"),
                F.concat(F.lit("bio"), (F.col("l_partkey") % 19 + 1).cast("string"), lag).alias("feature"),
            )
            .distinct()
        )
