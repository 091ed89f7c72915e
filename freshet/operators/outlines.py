"""Outlines as sets of edges: areas of grid cells inside shapes, shapes drawn twice, shapes inside another.

Shapes come as edges (`spatial.vertex_edges`), told apart by shape_id and, where they have holes or parts, by ring_no.
No shape is ever gathered into one row: each edge is cut at the grid's lines, its pieces are summed by cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.spatial import EARTH_KM, grid_key, ring_area, ring_signs

#: Nodes and weights of three-point Gauss quadrature on 0..1: exact to double precision within a cell of a few degrees.
GAUSS = ((0.5 - math.sqrt(0.15), 5 / 18), (0.5, 8 / 18), (0.5 + math.sqrt(0.15), 5 / 18))


def _pieces(edges: DataFrame, step: float) -> DataFrame:
    """Edges cut at the lines of the grid: (edge columns, row, col, t0, t1), t being the place along the edge. Both
    neighbours of a line cut at the same number, so nothing is lost or counted twice between them."""
    at = lambda lo, hi, t: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(t)
    spread = lambda a, b: F.sequence(F.floor(F.least(a, b) / step - 1e-9).cast("int"), F.floor(F.greatest(a, b) / step + 1e-9).cast("int"))
    cut = lambda n, lo, hi: F.try_divide(F.col(n) * step - F.col(lo), F.col(hi) - F.col(lo))
    e = edges.where("y1 <> y2").withColumn("row", F.explode(spread(F.col("y1"), F.col("y2"))))
    e = e.withColumns({"_a": cut("row", "y1", "y2"), "_top": F.col("row") + 1}).withColumn("_b", cut("_top", "y1", "y2"))
    e = e.withColumns({"t0": F.greatest(F.lit(0.0), F.least("_a", "_b")), "t1": F.least(F.lit(1.0), F.greatest("_a", "_b"))}).where("t0 < t1")
    upright = F.array(F.floor(F.col("x1") / step).cast("int"))
    e = e.withColumn("col", F.explode(F.when(F.col("x1") == F.col("x2"), upright).otherwise(spread(at("x1", "x2", "t0"), at("x1", "x2", "t1")))))
    e = e.withColumns({"_a": cut("col", "x1", "x2"), "_east": F.col("col") + 1}).withColumn("_b", cut("_east", "x1", "x2"))
    inner = {"t0": F.greatest("t0", F.coalesce(F.least("_a", "_b"), F.lit(0.0))), "t1": F.least("t1", F.coalesce(F.greatest("_a", "_b"), F.lit(1.0)))}
    return e.withColumns(inner).where("t0 < t1").drop("_a", "_b", "_top", "_east")


def cell_areas(edges: DataFrame, step: float) -> DataFrame:
    """(shape_id, col, row, full, km2): the part of each grid cell that a shape covers, on the sphere.

    An edge piece covers what lies east of it: a part of its own cell and its whole height in every cell further east,
    so cells without an edge get the running sum of heights and need no edge at all; those are `full`. Rings count by
    themselves, a ring inside an odd number of others is a hole, however it is drawn. Repeated vertices and edges along
    a parallel add nothing; rows with a null coordinate must not be given."""
    p = _pieces(ring_signs(edges), step)
    lat = lambda t: F.radians(F.col("y1") + (F.col("y2") - F.col("y1")) * t)
    lon = lambda t: F.radians(F.col("x1") + (F.col("x2") - F.col("x1")) * t)
    rise = (F.col("t1") - F.col("t0")) * F.radians(F.col("y2") - F.col("y1"))
    part: Column = F.lit(0.0)
    for node, weight in GAUSS:
        t = F.col("t0") + (F.col("t1") - F.col("t0")) * node
        part = part + weight * (F.radians((F.col("col") + 1) * step) - lon(t)) * F.cos(lat(t))
    height = 2 * F.cos((lat(F.col("t0")) + lat(F.col("t1"))) / 2) * F.sin(rise / 2)
    c = p.groupBy("shape_id", "row", "col").agg(F.sum(-F.col("sign") * rise * part).alias("_part"), F.sum(-F.col("sign") * height).alias("_h"))
    w = Window.partitionBy("shape_id", "row").orderBy("col")
    c = c.withColumns({"_all": F.sum("_h").over(w), "_next": F.lead("col").over(w)})
    width, whole = math.radians(step), F.sin(F.radians((F.col("row") + 1) * step)) - F.sin(F.radians(F.col("row") * step))
    own = F.struct("col", F.lit(False).alias("full"), (F.col("_part") + (F.col("_all") - F.col("_h")) * width).alias("km2"))
    inner = F.transform(F.sequence(F.col("col") + 1, F.col("_next") - 1), lambda k: F.struct(k.alias("col"), F.lit(True).alias("full"), (F.col("_all") * width).alias("km2")))
    cells = F.when((F.col("_next") > F.col("col") + 1) & (F.col("_all") > 1e-9 * whole), F.concat(F.array(own), inner)).otherwise(F.array(own))
    return c.select("shape_id", "row", F.explode(cells).alias("c")).select("shape_id", "c.col", "row", "c.full", (F.col("c.km2") * EARTH_KM**2).alias("km2"))


def cell_weights(edges: DataFrame, step: float, sliver: float = 1e-9, closure: float = 1e-7) -> DataFrame:
    """(shape_id, col, row, full, km2, share, closure, refused): each cell's share of a shape, slivers left out.

    `closure` is by what part of the shape's area its cells miss it. A shape that encloses nothing, or whose cells do
    not close, has one row without a cell and the reason in `refused` (no_area, not_closed), never weights."""
    cells = cell_areas(edges, step)
    sums = cells.groupBy("shape_id").agg(F.sum("km2").alias("_cells"))
    shapes = ring_area(edges).select("shape_id", F.col("area_km2").alias("_shape")).join(sums, "shape_id", "left")
    miss = F.try_divide(F.abs(F.coalesce("_cells", F.lit(0.0)) - F.col("_shape")), F.col("_shape"))
    shapes = shapes.withColumn("closure", F.when(F.col("_shape") > 0, miss))
    why = F.when(F.col("closure").isNull(), "no_area").when(F.col("closure") > closure, "not_closed")
    shapes = shapes.withColumn("refused", why)
    kept = cells.join(shapes, "shape_id").where(F.col("refused").isNull() & (F.col("km2") > sliver * F.col("_shape")))
    total = kept.groupBy("shape_id").agg(F.sum("km2").alias("_kept"))
    good = kept.join(total, "shape_id").select("shape_id", "col", "row", "full", "km2", (F.col("km2") / F.col("_kept")).alias("share"), "closure", "refused")
    return good.unionByName(shapes.where("refused is not null").select("shape_id", "closure", "refused"), allowMissingColumns=True)


def twins(edges: DataFrame, digits: int = 7) -> DataFrame:
    """(shape_id, twin_of, twins): shapes with the same outline, each with the smallest of them and how many they are.

    An outline is the set of its undirected edges, so where a ring begins, which way it runs and how rings are
    numbered do not matter. Edges are hashed and their hashes added up, which needs no order and combines before the
    shuffle; shapes of one digest are then compared edge by edge with the first of them. Edges without length do not
    count; shapes without any other edge have no twin."""
    a, b = F.struct(F.round("x1", digits).alias("x"), F.round("y1", digits).alias("y")), F.struct(F.round("x2", digits).alias("x"), F.round("y2", digits).alias("y"))
    e = edges.select("shape_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").groupBy("shape_id", "a", "b").agg(F.count("*").alias("times"))
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b", "times").cast("decimal(20,0)"))
    d = e.groupBy("shape_id").agg(F.count("*").alias("n"), h(1).alias("h1"), h(2).alias("h2"))
    alike = d.groupBy("n", "h1", "h2").agg(F.min("shape_id").alias("twin_of"), F.count("*").alias("_c")).where("_c > 1")
    pairs = d.join(alike, ["n", "h1", "h2"]).select("shape_id", "twin_of", "n")
    first = e.withColumnRenamed("shape_id", "twin_of")
    same = pairs.join(e, "shape_id").join(first, ["twin_of", "a", "b", "times"]).groupBy("shape_id", "twin_of", "n").agg(F.count("*").alias("_met")).where("_met = n")
    size = same.groupBy("twin_of").agg(F.count("*").alias("twins"))
    return same.join(size, "twin_of").where("twins > 1").select("shape_id", "twin_of", "twins")


def swallowed(cells: DataFrame, points: DataFrame, step: float, least: int = 3) -> DataFrame:
    """(shape_id, owner_id, points): owners, other than the shape itself, all of whose points (`least` or more) lie in
    the shape's raster cells. Points without coordinates count for nothing."""
    known = points.where("lon is not null and lat is not null")
    at = known.groupBy("owner_id", grid_key("lon", step).alias("col"), grid_key("lat", step).alias("row")).agg(F.count("*").alias("_n"))
    total = at.groupBy("owner_id").agg(F.sum("_n").alias("points")).where(F.col("points") >= least)
    held = at.join(cells, ["col", "row"]).where("owner_id <> shape_id").groupBy("shape_id", "owner_id").agg(F.sum("_n").alias("points"))
    return held.join(total, ["owner_id", "points"]).select("shape_id", "owner_id", "points")


def review(edges: DataFrame, cells: DataFrame, score: DataFrame, dirt: DataFrame, points: DataFrame, step: float, agreement: float, overlap: float, foreign: float, fewest: int = 12) -> DataFrame:
    """(shape_id, grade, blocked, twin_of, overlap_share, swallowed): may a shape be computed against?

    The first reason that holds blocks it: a twin, too few points of its own, overlap with others beyond its share,
    agreement below the bound, too many points of others inside, or all points of another inside."""
    w = cells.groupBy("col", "row").agg(F.count("*").alias("_o"))
    share = cells.join(w, ["col", "row"]).groupBy("shape_id").agg((F.count_if(F.col("_o") > 1) / F.count("*")).alias("overlap_share"))
    eaten = swallowed(cells, points, step).groupBy("shape_id").agg(F.count("*").alias("swallowed"))
    j = edges.select("shape_id").distinct().join(twins(edges), "shape_id", "left").join(share, "shape_id", "left").join(score, "shape_id", "left").join(dirt, "shape_id", "left").join(eaten, "shape_id", "left")
    none = F.lit(0)
    why = (
        F.when(F.col("twin_of").isNotNull(), "one_outline_serves_several").when(F.coalesce("points", none) < fewest, "too_few_points").when(F.col("overlap_share") > overlap, "overlaps_another")
        .when(F.col("agreement") < agreement, "agreement_below_bound").when(F.col("foreign_share") > foreign, "holds_points_of_others").when(F.coalesce("swallowed", none) > 0, "holds_every_point_of_another")
    )
    return j.select("shape_id", F.when(why.isNull(), "zonal").otherwise("none").alias("grade"), why.alias("blocked"), "twin_of", F.round("overlap_share", 6).alias("overlap_share"), F.coalesce("swallowed", none).alias("swallowed"))
