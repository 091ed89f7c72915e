"""Queries on outlines: shares of cells, twins, swallowed shapes, and whether a shape may be computed against."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import outlines as o
from freshet.operators import spatial as s
from freshet.plans import places as p
from freshet.plans.bindings import view, with_views
from freshet.plans.registry import query

WEIGHT_STEP = 0.1


def _on(sql, rings, points="v_points"):
    return sql.replace("v_ring_vertices", rings).replace("v_points", points)


#: Each edge cut at rows, then at columns; what a piece covers of its own cell, and its height for the cells further east.
_PIECES = f"""SELECT shape_id, row, col, sgn, x1, y1, x2, y2, greatest(t0, CASE WHEN x1 = x2 THEN 0.0 ELSE least((col * st - x1) / (x2 - x1), ((col + 1) * st - x1) / (x2 - x1)) END) AS t0, least(t1, CASE WHEN x1 = x2 THEN 1.0 ELSE greatest((col * st - x1) / (x2 - x1), ((col + 1) * st - x1) / (x2 - x1)) END) AS t1, st
 FROM (SELECT *, unnest(CASE WHEN x1 = x2 THEN [CAST(floor(x1 / st) AS BIGINT)] ELSE generate_series(CAST(floor(least(x1 + (x2 - x1) * t0, x1 + (x2 - x1) * t1) / st - 1e-9) AS BIGINT), CAST(floor(greatest(x1 + (x2 - x1) * t0, x1 + (x2 - x1) * t1) / st + 1e-9) AS BIGINT)) END) AS col
  FROM (SELECT *, greatest(0.0, least((row * st - y1) / (y2 - y1), ((row + 1) * st - y1) / (y2 - y1))) AS t0, least(1.0, greatest((row * st - y1) / (y2 - y1), ((row + 1) * st - y1) / (y2 - y1))) AS t1
   FROM (SELECT *, unnest(generate_series(CAST(floor(least(y1, y2) / st - 1e-9) AS BIGINT), CAST(floor(greatest(y1, y2) / st + 1e-9) AS BIGINT))) AS row
    FROM (SELECT *, sign(sum(x1 * y2 - x2 * y1) OVER (PARTITION BY shape_id)) AS sgn, {WEIGHT_STEP}::DOUBLE AS st FROM ({p._EDGES})) WHERE y1 <> y2)) WHERE t0 < t1)"""
_AT = "(t0 + (t1 - t0) * {n})"
_PART = " + ".join(f"{w!r}::DOUBLE * (radians((col + 1) * st) - radians(x1 + (x2 - x1) * {_AT.format(n=repr(n))})) * cos(radians(y1 + (y2 - y1) * {_AT.format(n=repr(n))}))" for n, w in o.GAUSS)
_AREAS = f"""SELECT shape_id, row, unnest(CASE WHEN nxt > col + 1 AND alln > 1e-9 THEN list_concat([{{'col': col, 'full': false, 'km2': km2}}], list_transform(generate_series(col + 1, nxt - 1), lambda k: {{'col': k, 'full': true, 'km2': inner_km2}})) ELSE [{{'col': col, 'full': false, 'km2': km2}}] END) AS c
 FROM (SELECT shape_id, row, col, nxt, alln / (sin(radians((row + 1) * {WEIGHT_STEP}::DOUBLE)) - sin(radians(row * {WEIGHT_STEP}::DOUBLE))) AS alln, (part + (alln - h) * radians({WEIGHT_STEP}::DOUBLE)) * 6371.0 * 6371.0 AS km2, alln * radians({WEIGHT_STEP}::DOUBLE) * 6371.0 * 6371.0 AS inner_km2
  FROM (SELECT *, sum(h) OVER w AS alln, lead(col) OVER w AS nxt FROM (SELECT shape_id, row, col, sum(-sgn * radians(y2 - y1) * (t1 - t0) * ({_PART})) AS part, sum(-sgn * 2 * cos((radians(y1 + (y2 - y1) * t0) + radians(y1 + (y2 - y1) * t1)) / 2) * sin(radians(y2 - y1) * (t1 - t0) / 2)) AS h
   FROM ({_PIECES}) WHERE t0 < t1 GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY shape_id, row ORDER BY col)))"""


@query("cell_weights", with_views(f"""SELECT shape_id, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, "full", round(km2, 4) AS km2, round(km2 / sum(km2) OVER (PARTITION BY shape_id), 9) AS share, CAST(NULL AS VARCHAR) AS refused
 FROM (SELECT shape_id, row, c.col AS col, c."full" AS "full", c.km2 AS km2, sum(c.km2) OVER (PARTITION BY shape_id) AS total FROM ({_AREAS})) WHERE km2 > 1e-9 * total""", "v_ring_vertices"))
def cell_weights(spark, d):
    w = o.cell_weights(p._edges(spark, d), WEIGHT_STEP)
    return w.select("shape_id", "col", "row", "full", F.round("km2", 4).alias("km2"), F.round("share", 9).alias("share"), "refused")


_SET = "SELECT shape_id, list_sort(list(least(a, b) || '-' || greatest(a, b))) AS edges FROM (SELECT shape_id, printf('%.7f %.7f', x1, y1) AS a, printf('%.7f %.7f', x2, y2) AS b FROM ({})) WHERE a <> b GROUP BY 1".format(_on(p._EDGES, "{rings}"))


@query("outline_twins", with_views(f"SELECT shape_id, min(shape_id) OVER w AS twin_of, count(*) OVER w AS twins FROM ({_SET.format(rings='v_outlines')}) WINDOW w AS (PARTITION BY edges) QUALIFY count(*) OVER w > 1", "v_outlines"))
def outline_twins(spark, d):
    """Every customer's outline; keys equal modulo 500 share it, begin elsewhere and run the other way round."""
    return o.twins(s.vertex_edges(view(spark, d, "v_outlines")))


_RINGS, _AROUND = "v_reviewed_rings", "v_review_points"
_SWALLOWED = _on(f"""SELECT shape_id, owner_id, n AS points FROM (SELECT shape_id, owner_id, count(*) AS n FROM {p._HELD} WHERE owner_id <> shape_id GROUP BY 1, 2)
 JOIN (SELECT owner_id, count(*) AS n FROM v_points GROUP BY 1 HAVING count(*) >= 3) USING (owner_id, n)""", _RINGS, _AROUND)


def _reviewed(spark, d):
    e = s.vertex_edges(view(spark, d, _RINGS))
    return e, s.rasterize(e, p.STEP), view(spark, d, _AROUND)


@query("swallowed_shapes", with_views(_SWALLOWED, _AROUND, _RINGS))
def swallowed_shapes(spark, d):
    _, cells, points = _reviewed(spark, d)
    return o.swallowed(cells, points, p.STEP)


@query("outline_review", with_views(f"""SELECT shape_id, CASE WHEN blocked IS NULL THEN 'zonal' ELSE 'none' END AS grade, blocked, twin_of, round(overlap_share, 6) AS overlap_share, coalesce(eaten, 0) AS swallowed FROM (
 SELECT *, CASE WHEN twin_of IS NOT NULL THEN 'one_outline_serves_several' WHEN coalesce(points, 0) < 12 THEN 'too_few_points' WHEN overlap_share > 0.2 THEN 'overlaps_another' WHEN agreement < 0.8 THEN 'agreement_below_bound'
  WHEN foreign_share > 0.6 THEN 'holds_points_of_others' WHEN coalesce(eaten, 0) > 0 THEN 'holds_every_point_of_another' END AS blocked FROM (SELECT DISTINCT shape_id FROM {_RINGS})
 LEFT JOIN (SELECT shape_id, min(shape_id) OVER w AS twin_of FROM ({_SET.format(rings=_RINGS)}) WINDOW w AS (PARTITION BY edges) QUALIFY count(*) OVER w > 1) USING (shape_id)
 LEFT JOIN (SELECT shape_id, count(*) FILTER (o > 1) / count(*) AS overlap_share FROM (SELECT shape_id, count(*) OVER (PARTITION BY col, row) AS o FROM ({_on(p._CELLS, _RINGS)})) GROUP BY 1) USING (shape_id)
 LEFT JOIN ({_on(p._SCORE, _RINGS, _AROUND)}) USING (shape_id)
 LEFT JOIN (SELECT shape_id, round(count(*) FILTER (owner_id <> shape_id) / count(*), 6) AS foreign_share FROM {_on(p._HELD, _RINGS, _AROUND)} GROUP BY 1) USING (shape_id)
 LEFT JOIN (SELECT shape_id, count(*) AS eaten FROM ({_SWALLOWED}) GROUP BY 1) USING (shape_id))""", _AROUND, _RINGS))
def outline_review(spark, d):
    """Shapes and copies of every fifth; agreement 0.8, at most 0.2 shared with others and 0.6 of the points foreign."""
    e, cells, points = _reviewed(spark, d)
    return o.review(e, cells, s.shape_score(points, e), s.contamination(cells, points, p.STEP), points, p.STEP, 0.8, 0.2, 0.6)
