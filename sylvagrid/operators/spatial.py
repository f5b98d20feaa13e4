"""Spatial joins as equi-joins on grid buckets, refined by an exact predicate.

A box is listed in every bucket it touches, a polygon in those it covers, a point in
one. The buckets give the join a hashable key, so it shuffles (and, under adaptive
execution, splits a crowded bucket) like any equi-join; the exact test then runs
only on the candidates. Bucket size should be near the usual geometry size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagrid.session import stage


def _bucket(value, size: float) -> Column:
    return F.floor((F.col(value) if isinstance(value, str) else value) / size)


def _ring_edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))


def ring_bounds(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the bounding box and the edge list of a polygon.

    A polygon is a `ring` of (x, y) points or, where there is a column `rings`, any number of rings: the outlines of
    its parts and of their holes, in any order and direction. The edges of all rings are one list, and what an odd
    number of edges lies right of is inside: holes are outside, islands in them inside.
    """
    if "rings" in polygons.columns:
        points, edges = F.flatten("rings"), F.flatten(F.transform("rings", _ring_edges))
    else:
        points, edges = F.col(ring), _ring_edges(F.col(ring))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    bounds = {"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)}
    return polygons.withColumns(bounds | {"edges": edges})


def valid_ring(ring: str | Column = "ring") -> Column:
    """Closed, at least a triangle, and no repeated consecutive point."""
    points = F.col(ring) if isinstance(ring, str) else ring
    closed = F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1)
    stuck = F.exists(
        F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.get(points, i) == F.get(points, i - 1)
    )
    return F.coalesce((F.size(points) >= 4) & closed & ~stuck, F.lit(False))


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Positive where c lies left of the line from a to b, 0 on it."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _on(a: Column, b: Column, c: Column) -> Column:
    """The point c lies on the segment from a to b."""
    inside = c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return (_turn(a, b, c) == 0) & inside


def _along(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return F.least(low[value], high[value]), F.greatest(low[value], high[value])


def self_crossing(polygons: DataFrame, ident: str, size: float) -> DataFrame:
    """The `ident` of polygons whose outline crosses, touches or overlaps itself.

    Edges of a polygon meet in the buckets they pass, so an edge is compared with the few of its neighbourhood only.
    Neighbours in a ring may share the point between them and nothing else, other edges of a ring nothing at all;
    different rings may touch in points, but neither cross nor share a stretch.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    listed = polygons.select(F.col(ident).alias("_pid"), F.posexplode(rings).alias("_ring", "_points"))
    listed = listed.select("_pid", "_ring", (F.size("_points") - 1).alias("_n"), F.posexplode(_ring_edges(F.col("_points"))).alias("_i", "e"))
    spots = stage(_edge_buckets(listed, ["_pid", "_ring", "_n", "_i", "e"], size), "edges")
    p, q = spots.alias("p"), spots.alias("q")
    a, b, c, d = F.col("p.e.a"), F.col("p.e.b"), F.col("q.e.a"), F.col("q.e.b")
    same = F.col("p._ring") == F.col("q._ring")
    order = (F.col("p._ring") < F.col("q._ring")) | (same & (F.col("p._i") < F.col("q._i")))
    crosses = (F.signum(_turn(a, b, c)) * F.signum(_turn(a, b, d)) < 0) & (F.signum(_turn(c, d, a)) * F.signum(_turn(c, d, b)) < 0)
    touches = _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)
    level = (_turn(a, b, c) == 0) & (_turn(a, b, d) == 0)
    shared = [F.least(_along(v, a, b)[1], _along(v, c, d)[1]) - F.greatest(_along(v, a, b)[0], _along(v, c, d)[0]) for v in ("x", "y")]
    stretch = level & (shared[0] >= 0) & (shared[1] >= 0) & ((shared[0] > 0) | (shared[1] > 0))
    neighbours = (F.col("q._i") - F.col("p._i") == 1) | ((F.col("p._i") == 0) & (F.col("q._i") == F.col("p._n") - 1))
    bad = crosses | stretch | (same & ~neighbours & touches)
    met = (F.col("p._pid") == F.col("q._pid")) & (F.col("p._bx") == F.col("q._bx")) & (F.col("p._by") == F.col("q._by"))
    return p.join(q, met & order & bad).select(F.col("p._pid").alias(ident)).distinct()


def valid_polygons(polygons: DataFrame, ident: str, size: float) -> DataFrame:
    """Polygons all of whose rings are closed triangles at least, and whose outline does not cross itself."""
    rings = F.forall("rings", valid_ring) if "rings" in polygons.columns else valid_ring()
    whole = stage(polygons.where(rings), "rings")
    return whole.join(self_crossing(whole, ident, size), ident, "left_anti")


def ring_area(ring: str = "ring") -> Column:
    points = F.col(ring)
    twice = F.aggregate(
        F.sequence(F.lit(1), F.size(points) - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.get(points, i - 1)["x"] * F.get(points, i)["y"]
        - F.get(points, i)["x"] * F.get(points, i - 1)["y"],
    )
    return F.abs(twice) / 2.0


def point_in_ring(x: str, y: str, edges: str = "edges") -> Column:
    """Inside or on the boundary: odd number of edges right of the point, or on an edge."""
    px, py = F.col(x), F.col(y)

    def crosses(e):
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > py) != (b["y"] > py), px < at).otherwise(F.lit(False))

    def touches(e):
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        return (
            (turn == 0)
            & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
            & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        )

    odd = F.size(F.filter(F.col(edges), crosses)) % 2 == 1
    return odd | F.exists(F.col(edges), touches)


def _spread(boxes: DataFrame, size: float) -> DataFrame:
    """One row per bucket that the bounding box touches."""
    return boxes.withColumn(
        "_bx", F.explode(F.sequence(_bucket("x_min", size), _bucket("x_max", size)))
    ).withColumn("_by", F.explode(F.sequence(_bucket("y_min", size), _bucket("y_max", size))))


def _edge_buckets(edges: DataFrame, columns: Sequence[str], size: float) -> DataFrame:
    """(columns, _by, _bx): every bucket that an edge `e` passes, row of buckets by row of buckets."""
    a, b = F.col("e.a"), F.col("e.b")
    low, high = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    rows = F.explode(F.sequence(_bucket(low, size), _bucket(high, size))).alias("_by")
    bands = edges.select(*columns, rows)

    def x_at(y):
        return a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"])

    ends = [
        F.when(a["y"] == b["y"], p["x"]).otherwise(x_at(y))
        for p, y in ((a, F.greatest(low, F.col("_by") * size)), (b, F.least(high, (F.col("_by") + 1) * size)))
    ]
    slack = size * 1e-9
    touched = F.sequence(_bucket(F.least(*ends) - slack, size), _bucket(F.greatest(*ends) + slack, size))
    return bands.select(*columns, "_by", F.explode(touched).alias("_bx"))


def polygon_buckets(polygons: DataFrame, attributes: Sequence[str], size: float) -> DataFrame:
    """(_bx, _by, edges, attributes): the buckets that polygons cover, one row per polygon and bucket.

    A bucket that the outline crosses carries the edges of its row of buckets from it to
    the right, which decide every point in it. A bucket wholly inside carries none
    (`edges` is null); the others are left out. So an outline of very many edges is never
    copied whole, and only points near it are tested against edges.
    """
    named = ring_bounds(polygons).withColumn("_pid", F.monotonically_increasing_id())
    named = stage(named.select("_pid", "x_min", "x_max", "edges", *attributes), "polygons")
    a, b = F.col("e.a"), F.col("e.b")

    def x_at(y):
        return a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"])

    rows = F.explode(F.sequence(_bucket(F.least(a["y"], b["y"]), size), _bucket(F.greatest(a["y"], b["y"]), size))).alias("_by")
    bands = named.select("_pid", F.explode("edges").alias("e")).select("_pid", "e", rows)
    border = _edge_buckets(named.select("_pid", F.explode("edges").alias("e")), ["_pid", "e"], size).select("_pid", "_by", "_bx").distinct()
    local = (
        border.join(bands, ["_pid", "_by"])
        .where(F.greatest(a["x"], b["x"]) >= F.col("_bx") * size)
        .groupBy("_pid", "_bx", "_by")
        .agg(F.collect_list("e").alias("edges"))
    )
    # where the middle line of a row of buckets enters and leaves the polygon
    middle = (F.col("_by") + 0.5) * size
    crossed = F.when((a["y"] > middle) != (b["y"] > middle), x_at(middle))
    lines = bands.groupBy("_pid", "_by").agg(F.collect_list(crossed).alias("_xs"))
    columns = F.explode(F.sequence(_bucket("x_min", size), _bucket("x_max", size))).alias("_bx")
    inner = lines.join(named.select("_pid", "x_min", "x_max"), "_pid").select("_pid", "_by", "_xs", columns)
    right = F.size(F.filter("_xs", lambda x: x > (F.col("_bx") + 0.5) * size))
    inner = inner.where(right % 2 == 1).join(border, ["_pid", "_bx", "_by"], "left_anti")
    inner = inner.select("_pid", "_bx", "_by", F.lit(None).cast(local.schema["edges"].dataType).alias("edges"))
    return local.unionByName(inner).join(named.select("_pid", *attributes), "_pid").drop("_pid")


def points_with_polygons(
    points: DataFrame, polygons: DataFrame, attributes: Sequence[str], size: float, how: str = "left"
) -> DataFrame:
    """Points joined to every polygon they intersect (`left` keeps the others; `left_semi` clips)."""
    near = points.withColumns({"_bx": _bucket("x", size), "_by": _bucket("y", size)}).alias("p")
    buckets = polygon_buckets(polygons, attributes, size).alias("g")
    inside = (
        (F.col("p._bx") == F.col("g._bx"))
        & (F.col("p._by") == F.col("g._by"))
        & (F.col("g.edges").isNull() | point_in_ring("p.x", "p.y", "g.edges"))
    )
    joined = near.join(buckets, inside, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bx", "_by")
    return joined.select(*[f"p.{c}" for c in points.columns], *[f"g.{a}" for a in attributes])


def boxes_overlapping(
    left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str], size: float
) -> DataFrame:
    """Pairs of boxes that intersect or touch, each exactly once.

    A pair meets in every bucket both boxes cover; it is kept only in the bucket
    of the lower corner of their intersection, so no distinct is needed.
    """
    a, b = _spread(left, size).alias("a"), _spread(right, size).alias("b")
    hit = (
        (F.col("a._bx") == F.col("b._bx"))
        & (F.col("a._by") == F.col("b._by"))
        & (F.col("a.x_min") <= F.col("b.x_max"))
        & (F.col("b.x_min") <= F.col("a.x_max"))
        & (F.col("a.y_min") <= F.col("b.y_max"))
        & (F.col("b.y_min") <= F.col("a.y_max"))
        & (_bucket(F.greatest("a.x_min", "b.x_min"), size) == F.col("a._bx"))
        & (_bucket(F.greatest("a.y_min", "b.y_min"), size) == F.col("a._by"))
    )
    return a.join(b, hit).select(*[f"a.{c}" for c in left_columns], *[f"b.{c}" for c in right_columns])


def within_bounds_of(boxes: DataFrame, points: DataFrame, buffer: float) -> DataFrame:
    """Boxes that meet the buffered bounding box of all points (four scalars)."""

    def bound(agg, col):
        return points.agg(agg(col)).scalar()

    return boxes.where(
        (F.col("x_max") >= bound(F.min, "x") - buffer)
        & (F.col("x_min") <= bound(F.max, "x") + buffer)
        & (F.col("y_max") >= bound(F.min, "y") - buffer)
        & (F.col("y_min") <= bound(F.max, "y") + buffer)
    )


def sample_at_points(points: DataFrame, cells: DataFrame, keys: Sequence[str], x0: float, y0: float, res: float) -> DataFrame:
    """Left equi-join of points to the cell that contains them."""
    placed = points.withColumns(
        {
            "r": F.floor((F.lit(y0) - F.col("y")) / res).cast("int"),
            "c": F.floor((F.col("x") - F.lit(x0)) / res).cast("int"),
        }
    )
    return placed.join(cells, [*keys, "r", "c"], "left")
