"""Regular grids: coordinates, tiles, windows, regridding, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_centre(r: Column, c: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    return F.lit(x0) + (c + 0.5) * res, F.lit(y0) - (r + 0.5) * res


def cell_corner(r: Column, c: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    return F.lit(x0) + c * res, F.lit(y0) - r * res


def cell_index(x: Column, y: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """Row and column of the cell that contains a point."""
    return F.floor((F.lit(y0) - y) / res).cast("int"), F.floor((x - F.lit(x0)) / res).cast("int")


def tile_grid(bounds: DataFrame, size: float) -> DataFrame:
    """Tiles covering the bounds from the upper left, the last ones cut at the edge.

    Grid rows come from the one-row bounds and are spread over the cluster before
    each one generates its tiles.
    """
    rows = F.ceil((F.col("y_top") - F.col("y_bottom")) / size).cast("int")
    cols = F.ceil((F.col("x_right") - F.col("x_left")) / size).cast("int")
    spread = bounds.select(
        "x_left", "x_right", "y_bottom", "y_top", cols.alias("_cols"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("tr")
    ).repartition("tr")
    tiles = spread.withColumn("tc", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    return tiles.select(
        "tr",
        "tc",
        (F.col("x_left") + F.col("tc") * size).alias("x_min"),
        F.least(F.col("x_left") + (F.col("tc") + 1) * size, "x_right").alias("x_max"),
        F.greatest(F.col("y_top") - (F.col("tr") + 1) * size, "y_bottom").alias("y_min"),
        (F.col("y_top") - F.col("tr") * size).alias("y_max"),
    )


def covering_windows(cells: DataFrame, size: int, stride: int) -> DataFrame:
    """Every cell once per window (start a multiple of the stride) that covers it."""

    def starts(i):
        first = F.greatest(F.floor((F.col(i) - size) / stride) + 1, F.lit(0))
        return F.explode(F.sequence(first.cast("int"), F.floor(F.col(i) / stride).cast("int")))

    return cells.withColumn("pr", starts("r")).withColumn("pc", starts("c"))


def regrid_nearest(targets: DataFrame, source: DataFrame, value: str, x0: float, y0: float, res: float) -> DataFrame:
    """Value of the source cell under each target centre; targets outside the source are dropped."""
    r, c = cell_index((F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, x0, y0, res)
    placed = targets.select("tr", "tc", r.alias("r"), c.alias("c"))
    return placed.join(source.select("r", "c", value), ["r", "c"]).select("tr", "tc", value)


def regrid_bilinear(
    targets: DataFrame, source: DataFrame, value: str, x0: float, y0: float, res: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Distance-weighted mean of the four source cells around each target centre.

    Missing neighbours drop out and the remaining weights are rescaled.
    """
    px = ((F.col("x_min") + F.col("x_max")) / 2 - x0) / res - 0.5
    py = (F.lit(y0) - (F.col("y_min") + F.col("y_max")) / 2) / res - 0.5
    placed = targets.select("tr", "tc", px.alias("_px"), py.alias("_py"))
    c0, r0 = F.floor("_px"), F.floor("_py")
    wx, wy = F.col("_px") - c0, F.col("_py") - r0
    corners = [
        F.struct((r0 + dr).cast("int").alias("r"), (c0 + dc).cast("int").alias("c"), (fy * fx).alias("w"))
        for dr, fy in ((0, 1.0 - wy), (1, wy))
        for dc, fx in ((0, 1.0 - wx), (1, wx))
    ]
    near = placed.select("tr", "tc", F.inline(F.array(*corners))).where("w > 0")
    known = source.where(F.col(value).isNotNull()).select(*keys, "r", "c", value)
    return (
        near.join(known, ["r", "c"])
        .groupBy(*keys, "tr", "tc")
        .agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
    )


def grid_check(layers: DataFrame, layer: str, reference: DataFrame) -> DataFrame:
    """Extent of every layer beside the reference extent, and whether they agree."""

    def extent(prefix=""):
        return [
            agg(col).alias(f"{prefix}{col}_{name}")
            for col in ("r", "c")
            for name, agg in (("min", F.min), ("max", F.max))
        ]

    names = ["r_min", "r_max", "c_min", "c_max"]
    ref = reference.agg(F.struct(*extent(), F.count(F.lit(1)).alias("n"))).scalar()
    per = layers.groupBy(layer).agg(*extent(), F.count(F.lit(1)).alias("n_cells")).withColumn("_ref", ref)
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"_ref.{n}"))
    return per.select(layer, *names, "n_cells", (F.col("_ref.n") - F.col("n_cells")).alias("n_missing"), same.alias("aligned"))


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def estimated_resolution(cells: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rounded metre resolution from degree spacing.

    The mean step between sorted distinct coordinates is their range over their
    number less one, so nothing has to be sorted.
    """
    # fixed values: metres per degree of longitude (near 40 N) and latitude
    per_lon, per_lat = 85000.0, 111000.0

    def step(col):
        return (F.max(col) - F.min(col)) / (F.count_distinct(col) - 1)

    metres = (step(x) * per_lon + step(y) * per_lat) / 2
    out = cells.groupBy(*keys).agg(metres.alias("estimate"))
    e = F.col("estimate")
    unit = F.when(e < 100, 10.0).when(e < 1000, 100.0).otherwise(1000.0)
    return out.withColumn("resolution", F.bround(e / unit) * unit)
