"""Queries on places, rings and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import spatial as s
from freshet.plans.bindings import view, with_views
from freshet.plans.registry import query
from freshet.shared import numbered

BOX, STEP = (89.6, 24.0, 96.1, 28.5), 0.05
_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


def _points(spark, d):
    return view(spark, d, "v_points")


def _vertices(spark, d):
    return view(spark, d, "v_ring_vertices")


def _edges(spark, d):
    return s.vertex_edges(_vertices(spark, d))


def _places(spark, d):
    return view(spark, d, "v_localities")


_EDGES = "SELECT shape_id, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v_ring_vertices WINDOW w AS (PARTITION BY shape_id ORDER BY seq)"
_INSIDE = f"SELECT point_id, owner_id, lon, lat, shape_id FROM v_points CROSS JOIN ({_EDGES}) WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1"


@query("haversine", with_views(f"SELECT a.locality_id, p.point_id, round({_KM.format(a='a', b='p')}, 6) AS km FROM v_localities a JOIN v_points p ON a.district_id = p.owner_id", "v_localities", "v_points"))
def haversine(spark, d):
    p = _points(spark, d).withColumnRenamed("owner_id", "district_id")
    return s.distances(_places(spark, d), p, "locality_id", "point_id", "district_id")


@query("coord_envelope", with_views(f"SELECT owner_id, CASE WHEN lon IS NULL OR lat IS NULL THEN 'missing' WHEN lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} THEN 'valid' ELSE 'invalid' END AS state, count(*) AS points FROM (SELECT owner_id, lon, CASE WHEN point_id % 11 <> 0 THEN lat END AS lat FROM v_points) GROUP BY 1, 2", "v_points"))
def coord_envelope(spark, d):
    p = _points(spark, d).withColumn("lat", F.when(F.col("point_id") % 11 != 0, F.col("lat")))
    return p.groupBy("owner_id", s.coord_state("lon", "lat", BOX).alias("state")).agg(F.count("*").alias("points"))


@query("bbox_agg", with_views("SELECT owner_id, round(min(lon) - 0.1, 6) AS west, round(min(lat) - 0.1, 6) AS south, round(max(lon) + 0.1, 6) AS east, round(max(lat) + 0.1, 6) AS north, count(*) AS points FROM v_points GROUP BY 1", "v_points"))
def bbox_agg(spark, d):
    r = lambda c: F.round(c, 6)
    return _points(spark, d).groupBy("owner_id").agg(
        r(F.min("lon") - 0.1).alias("west"), r(F.min("lat") - 0.1).alias("south"), r(F.max("lon") + 0.1).alias("east"), r(F.max("lat") + 0.1).alias("north"), F.count("*").alias("points"),
    )


@query("grid_cell", with_views("SELECT CAST(floor(round(lon / 0.1, 9)) AS INTEGER) AS col, CAST(floor(round(lat / 0.1, 9)) AS INTEGER) AS row, printf('%.2f_%.2f', floor(round(lon / 0.1, 9)) * 0.1, floor(round(lat / 0.1, 9)) * 0.1) AS cell_id, count(*) AS points FROM v_points GROUP BY 1, 2, 3", "v_points"))
def grid_cell(spark, d):
    p = _points(spark, d).select(s.grid_key("lon", 0.1).alias("col"), s.grid_key("lat", 0.1).alias("row"))
    return p.groupBy("col", "row", F.format_string("%.2f_%.2f", F.col("col") * 0.1, F.col("row") * 0.1).alias("cell_id")).agg(F.count("*").alias("points"))


@query("vertex_edges", with_views(f"SELECT * FROM ({_EDGES})", "v_ring_vertices"))
def vertex_edges(spark, d):
    return _edges(spark, d)


@query("ring_area", with_views(f"""SELECT shape_id, vertices, round(abs(a), 6) AS area, round(sx / (6 * a), 6) AS cx, round(sy / (6 * a), 6) AS cy, round(abs(km2), 3) AS area_km2 FROM (SELECT shape_id, count(*) AS vertices, sum(x1 * y2 - x2 * y1) / 2 AS a,
 sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy, -sum(radians(x2 - x1) * CASE WHEN abs(radians(y2) - radians(y1)) < 1e-12 THEN sin(radians(y1)) ELSE (cos(radians(y1)) - cos(radians(y2))) / (radians(y2) - radians(y1)) END) * 6371.0 * 6371.0 AS km2 FROM ({_EDGES}) GROUP BY 1)""", "v_ring_vertices"))
def ring_area(spark, d):
    a = s.ring_area(_edges(spark, d))
    return a.select("shape_id", "vertices", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy")], F.round("area_km2", 3).alias("area_km2"))


@query("point_in_polygon", with_views(f"SELECT point_id, shape_id FROM ({_INSIDE})", "v_points", "v_ring_vertices"))
def point_in_polygon(spark, d):
    return s.points_in_shapes(_points(spark, d), _edges(spark, d)).select("point_id", "shape_id")


@query("place_assign", with_views(f"SELECT p.point_id, min(shape_id) AS shape_id, count(shape_id) AS holders FROM v_points p LEFT JOIN ({_INSIDE}) i USING (point_id) GROUP BY 1", "v_points", "v_ring_vertices"))
def place_assign(spark, d):
    return s.first_shape(_points(spark, d), _edges(spark, d)).select("point_id", "shape_id", "holders")


@query("majority_assign", with_views(f"""SELECT owner, b.shape_id AS shape_id, round(coalesce(b.c, 0) / n, 6) AS share FROM (SELECT shape_id AS owner, count(*) AS n FROM v_ring_vertices WHERE seq % 3 = 0 GROUP BY 1) LEFT JOIN (
 SELECT owner, arg_max({{'shape_id': shape_id, 'c': c}}, (c, -shape_id)) AS b FROM (SELECT owner, shape_id, count(*) AS c FROM (SELECT v.shape_id AS owner, v.seq, e.shape_id FROM v_ring_vertices v CROSS JOIN ({_EDGES}) e
  WHERE v.seq % 3 = 0 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) WHERE owner <> shape_id GROUP BY 1, 2) GROUP BY 1) USING (owner)""", "v_ring_vertices"))
def majority_assign(spark, d):
    return s.majority_shape(_vertices(spark, d), _edges(spark, d))


_CELLS = f"""SELECT shape_id, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS col, row FROM (SELECT shape_id, row, CAST(ceil(round(xc / {STEP} - 0.5, 6)) AS BIGINT) AS lo, CAST(ceil(round(xe / {STEP} - 0.5, 6)) AS BIGINT) - 1 AS hi FROM (
 SELECT shape_id, row, xc, lead(xc) OVER w AS xe, row_number() OVER w AS k FROM (SELECT *, round((x2 - x1) * (yc - y1) / (y2 - y1) + x1, 9) AS xc FROM (SELECT *, (row + 0.5) * {STEP} AS yc FROM (
  SELECT *, CAST(unnest(generate_series(CAST(floor(round(least(y1, y2) / {STEP}, 9)) AS BIGINT), CAST(floor(round(greatest(y1, y2) / {STEP}, 9)) AS BIGINT))) AS INTEGER) AS row FROM ({_EDGES}))) WHERE (y1 > yc) <> (y2 > yc))
 WINDOW w AS (PARTITION BY shape_id, row ORDER BY xc, seq)) WHERE k % 2 = 1 AND xe IS NOT NULL) WHERE lo <= hi"""


def _cells(spark, d):
    return s.rasterize(_edges(spark, d), STEP)


@query("rasterize", with_views(f"SELECT shape_id, count(*) AS cells, min(col) AS col0, max(col) AS col1, min(row) AS row0, max(row) AS row1 FROM ({_CELLS}) GROUP BY 1", "v_ring_vertices"))
def rasterize(spark, d):
    return _cells(spark, d).groupBy("shape_id").agg(F.count("*").alias("cells"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.min("row").alias("row0"), F.max("row").alias("row1"))


@query("cell_overlap", with_views(f"SELECT a.shape_id, b.shape_id AS other, count(*) AS cells FROM ({_CELLS}) a JOIN ({_CELLS}) b ON a.col = b.col AND a.row = b.row AND a.shape_id < b.shape_id GROUP BY 1, 2", "v_ring_vertices"))
def cell_overlap(spark, d):
    return s.overlaps(_cells(spark, d))


@query("cell_intersect", with_views(f"SELECT count(*) AS cells, round(count(*) * {STEP} * {STEP}, 6) AS area FROM (SELECT col, row FROM ({_CELLS}) WHERE shape_id % 2 = 0 INTERSECT SELECT col, row FROM ({_CELLS}) WHERE shape_id % 2 = 1)", "v_ring_vertices"))
def cell_intersect(spark, d):
    c = _cells(spark, d)
    both = c.where("shape_id % 2 = 0").select("col", "row").intersect(c.where("shape_id % 2 = 1").select("col", "row"))
    return both.agg(F.count("*").alias("cells"), F.round(F.count("*") * STEP * STEP, 6).alias("area"))


_HELD = f"v_points p JOIN ({_CELLS}) c ON c.col = CAST(floor(round(lon / {STEP}, 9)) AS INTEGER) AND c.row = CAST(floor(round(lat / {STEP}, 9)) AS INTEGER)"


@query("contamination", with_views(f"SELECT shape_id, own, fgn AS foreign, round(fgn / (own + fgn), 6) AS foreign_share FROM (SELECT shape_id, count(*) FILTER (owner_id = shape_id) AS own, count(*) FILTER (owner_id <> shape_id) AS fgn FROM {_HELD} GROUP BY 1)".replace("AS foreign,", 'AS "foreign",'), "v_points", "v_ring_vertices"))
def contamination(spark, d):
    return s.contamination(_cells(spark, d), _points(spark, d), STEP)


@query("stray_owners", with_views(f"SELECT * FROM (SELECT shape_id, owner_id, count(*) AS points, row_number() OVER (PARTITION BY shape_id ORDER BY count(*) DESC, owner_id) AS rank FROM {_HELD} WHERE owner_id <> shape_id GROUP BY 1, 2) WHERE rank <= 5", "v_points", "v_ring_vertices"))
def stray_owners(spark, d):
    from pyspark.sql import Window

    p = _points(spark, d).withColumns({"col": s.grid_key("lon", STEP), "row": s.grid_key("lat", STEP)}).join(_cells(spark, d), ["col", "row"]).where("owner_id <> shape_id")
    g = p.groupBy("shape_id", "owner_id").agg(F.count("*").alias("points"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("shape_id").orderBy(F.desc("points"), "owner_id"))).where("rank <= 5")


_DIST = f"""SELECT point_id, shape_id, min(sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2))) AS distance FROM (SELECT *, greatest(0.0, least(1.0, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0.0))) AS t
 FROM (SELECT *, (lon - x1) * k.lon_km AS px, (lat - y1) * 110.57::DOUBLE AS py, (x2 - x1) * k.lon_km AS dx, (y2 - y1) * 110.57::DOUBLE AS dy FROM v_points JOIN ({_EDGES}) ON owner_id = shape_id, (SELECT 111.32::DOUBLE * cos(radians(26.0)) AS lon_km) k)) GROUP BY 1, 2"""
_SCORE = f"""SELECT shape_id, points, inside, close, len(s) AS strays, round(s[len(s) // 2 + 1], 6) AS median_stray_km, round(s[len(s)], 6) AS max_stray_km, round((inside + close) / points, 6) AS agreement FROM (
 SELECT shape_id, count(*) AS points, count(*) FILTER (inn) AS inside, count(*) FILTER (NOT inn AND distance <= 0.5) AS close, coalesce(list_sort(list(distance) FILTER (NOT inn AND distance > 0.5)), []) AS s
 FROM (SELECT d.*, i.point_id IS NOT NULL AS inn FROM ({_DIST}) d LEFT JOIN (SELECT * FROM ({_INSIDE}) WHERE owner_id = shape_id) i USING (point_id)) GROUP BY 1)"""


@query("shape_score", with_views(_SCORE, "v_points", "v_ring_vertices"))
def shape_score(spark, d):
    return s.shape_score(_points(spark, d), _edges(spark, d))


@query("boundary_grade", with_views(f"""SELECT shape_id, CASE WHEN points < 3 THEN 'too_few_points' WHEN agreement < 0.5 THEN 'disagrees' WHEN coalesce(fgn, 0) > 20 * inside THEN 'contaminated' WHEN agreement < 0.8 THEN 'partial' ELSE 'good' END AS grade
 FROM ({_SCORE}) LEFT JOIN (SELECT shape_id, count(*) FILTER (owner_id <> shape_id) AS fgn FROM {_HELD} GROUP BY 1) USING (shape_id)""", "v_points", "v_ring_vertices"))
def boundary_grade(spark, d):
    score = s.shape_score(_points(spark, d), _edges(spark, d)).join(s.contamination(_cells(spark, d), _points(spark, d), STEP), "shape_id", "left")
    grade = F.when(F.col("points") < 3, "too_few_points").when(F.col("agreement") < 0.5, "disagrees").when(F.coalesce("foreign", F.lit(0)) > 20 * F.col("inside"), "contaminated").when(F.col("agreement") < 0.8, "partial").otherwise("good")
    return score.select("shape_id", grade.alias("grade"))


@query("edge_dissolve", with_views(f"""WITH n AS (SELECT round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, count(*) AS n FROM (SELECT x1, y1, x2, y2 FROM ({_EDGES}) UNION ALL SELECT x2, y2, x1, y1 FROM ({_EDGES}) WHERE shape_id % 3 = 0 AND seq < 3) GROUP BY 1, 2, 3, 4)
SELECT a.x1, a.y1, a.x2, a.y2, a.n - coalesce(b.n, 0) AS left_over FROM n a LEFT JOIN n b ON a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 WHERE a.n > coalesce(b.n, 0)""", "v_ring_vertices"))
def edge_dissolve(spark, d):
    e = _edges(spark, d)
    back = e.where("shape_id % 3 = 0 and seq < 3").select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return s.dissolve(e.select("x1", "y1", "x2", "y2").unionByName(back))


_NEAR = f"SELECT a.locality_id, p.point_id, round({_KM.format(a='a', b='p')}, 6) AS km FROM v_localities a CROSS JOIN v_points p"


def _stations(spark, d):
    return _points(spark, d).select("point_id", "lon", "lat")


@query("radius_join", with_views(f"SELECT * FROM ({_NEAR}) WHERE km <= 70", "v_localities", "v_points"))
def radius_join(spark, d):
    return s.near(_places(spark, d).select("locality_id", "lon", "lat"), _stations(spark, d), 70, exact=False).select("locality_id", "point_id", "km")


_NEAREST = f"SELECT locality_id, arg_min(point_id, (km, point_id)) AS point_id, min(km) AS km FROM ({_NEAR}) WHERE km <= 60 GROUP BY 1"


def _nearest(spark, d):
    return s.nearest(_places(spark, d).select("locality_id", "lon", "lat"), _stations(spark, d), "locality_id", "point_id", 60)


@query("nearest_station", with_views(f"SELECT l.locality_id, n.point_id, n.km, n.km IS NULL AS far FROM v_localities l LEFT JOIN ({_NEAREST}) n USING (locality_id)", "v_localities", "v_points"))
def nearest_station(spark, d):
    """Beyond 60 km there is no nearest station."""
    return _nearest(spark, d).withColumn("far", F.col("km").isNull())


_ANY = f"SELECT locality_id, arg_min(point_id, (km, point_id)) AS point_id, min(km) AS km FROM ({_NEAR}) GROUP BY 1"


@query("nearest_any", with_views(_ANY, "v_localities", "v_points"))
def nearest_any(spark, d):
    """At whatever distance; the first look is at 1 km."""
    return s.nearest_any(_places(spark, d).select("locality_id", "lon", "lat"), _stations(spark, d), "locality_id", "point_id", 1)


@query("assigned_distance", with_views(f"""SELECT l.locality_id, l.locality_id * 10 AS assigned_id, a.km AS assigned_km, n.point_id, n.km AS nearest_km, coalesce(a.km > 60, false) AS far, coalesce(n.point_id <> l.locality_id * 10 AND a.km - n.km > 25, false) AS much_nearer
 FROM v_localities l LEFT JOIN ({_NEAR}) a ON a.locality_id = l.locality_id AND a.point_id = l.locality_id * 10 LEFT JOIN ({_ANY}) n ON n.locality_id = l.locality_id""", "v_localities", "v_points"))
def assigned_distance(spark, d):
    places = _places(spark, d).select("locality_id", "lon", "lat", (F.col("locality_id") * 10).alias("assigned_id"))
    return s.assigned_distance(places, _stations(spark, d), "locality_id", "point_id", "assigned_id")


@query("review_queue", with_views(f"SELECT locality_id, coalesce(km, 0) AS km, row_number() OVER (ORDER BY coalesce(km, 0) DESC, locality_id) AS place FROM v_localities LEFT JOIN ({_NEAREST}) USING (locality_id)", "v_localities", "v_points"))
def review_queue(spark, d):
    """The whole queue, worst distances first."""
    queue = _nearest(spark, d).select("locality_id", F.coalesce("km", F.lit(0.0)).alias("km"))
    return numbered(queue, "place", F.desc("km"), F.asc("locality_id"))


@query("mapping_demote", with_views(f"""SELECT locality_id, point_id, CASE WHEN locality_id % 7 = 0 THEN 'reviewed' WHEN km IS NULL THEN 'unresolved' WHEN km > 25 THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT l.locality_id, CASE WHEN l.locality_id % 7 = 0 THEN l.locality_id * 10 ELSE n.point_id END AS point_id, n.km FROM v_localities l LEFT JOIN ({_NEAREST}) n USING (locality_id))""", "v_localities", "v_points"))
def mapping_demote(spark, d):
    """A reviewed override comes before the default; automation only demotes."""
    fixed = _places(spark, d).where("locality_id % 7 = 0").select("locality_id", (F.col("locality_id") * 10).alias("override"))
    j = _nearest(spark, d).join(fixed, "locality_id", "left")
    level = F.when(F.col("override").isNotNull(), "reviewed").when(F.col("km").isNull(), "unresolved").when(F.col("km") > 25, "low").otherwise("medium")
    return j.select("locality_id", F.coalesce("override", "point_id").alias("point_id"), level.alias("confidence"))


@query("drift_check", with_views(f"SELECT locality_id, point_id FROM ({_NEAREST}) EXCEPT ALL SELECT locality_id, point_id FROM ({_NEAREST}) WHERE locality_id % 5 <> 0", "v_localities", "v_points"))
def drift_check(spark, d):
    """Recomputed rows that are not among the committed ones."""
    now = _nearest(spark, d).where("point_id is not null").select("locality_id", "point_id")
    return now.exceptAll(now.where("locality_id % 5 <> 0"))


@query("packet_totals", with_views(f"SELECT count(*) AS localities, count(*) FILTER (km IS NULL) AS far, count(*) FILTER (km > 25) AS review, count(DISTINCT point_id) AS stations FROM v_localities LEFT JOIN ({_NEAREST}) USING (locality_id)", "v_localities", "v_points"))
def packet_totals(spark, d):
    return _nearest(spark, d).agg(F.count("*").alias("localities"), F.count_if(F.col("km").isNull()).alias("far"), F.count_if(F.col("km") > 25).alias("review"), F.count_distinct("point_id").alias("stations"))


@query("packet_order", with_views(f"SELECT locality_id, CASE WHEN km IS NULL THEN 0 WHEN km > 25 THEN 1 ELSE 2 END AS priority, km FROM v_localities LEFT JOIN ({_NEAREST}) USING (locality_id) ORDER BY priority, km DESC, locality_id", "v_localities", "v_points"))
def packet_order(spark, d):
    p = F.when(F.col("km").isNull(), 0).when(F.col("km") > 25, 1).otherwise(2)
    return _nearest(spark, d).select("locality_id", p.alias("priority"), "km").orderBy("priority", F.desc("km"), "locality_id")


@query("downstream_readers", with_views(f"SELECT point_id, count(*) AS n, string_agg(CAST(locality_id AS VARCHAR), ',' ORDER BY locality_id) AS localities FROM ({_NEAREST}) GROUP BY 1", "v_localities", "v_points"))
def downstream_readers(spark, d):
    g = _nearest(spark, d).where("point_id is not null").groupBy("point_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("locality_id")).alias("l"))
    return g.select("point_id", "n", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("localities"))


@query("coherent_points", with_views(f"""SELECT owner_id, near, n, lon, lat FROM (SELECT owner_id, count(*) AS near, max(n) AS n, round(avg(lon), 8) AS lon, round(avg(lat), 8) AS lat FROM (SELECT p.*, m.n, {_KM.format(a='p', b='m')} AS km FROM v_points p JOIN (SELECT owner_id, median(lon) AS lon, median(lat) AS lat, count(*) AS n FROM v_points GROUP BY 1) m USING (owner_id)) WHERE km <= 250 GROUP BY 1) WHERE 2 * near > n""", "v_points"))
def coherent_points(spark, d):
    return s.coherent(_points(spark, d), "owner_id", 250)


@query("centre_fallback", with_views("""SELECT locality_id, round(coalesce(o.lon, d.lon, l.lon), 6) AS lon, round(coalesce(o.lat, d.lat, l.lat), 6) AS lat, CASE WHEN o.lon IS NOT NULL THEN 'own' WHEN d.lon IS NOT NULL THEN 'district' ELSE 'place' END AS source FROM v_localities l
 LEFT JOIN (SELECT point_id, lon, lat FROM v_points WHERE point_id % 3 = 0) o ON o.point_id = l.locality_id LEFT JOIN (SELECT owner_id, median(lon) AS lon, median(lat) AS lat FROM v_points WHERE owner_id % 4 <> 0 GROUP BY 1) d ON d.owner_id = l.district_id""", "v_localities", "v_points"))
def centre_fallback(spark, d):
    own = _points(spark, d).where("point_id % 3 = 0").select(F.col("point_id").alias("locality_id"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    dist = _points(spark, d).where("owner_id % 4 <> 0").groupBy(F.col("owner_id").alias("district_id")).agg(F.median("lon").alias("d_lon"), F.median("lat").alias("d_lat"))
    j = _places(spark, d).join(own, "locality_id", "left").join(dist, "district_id", "left")
    src = F.when(F.col("o_lon").isNotNull(), "own").when(F.col("d_lon").isNotNull(), "district").otherwise("place")
    return j.select("locality_id", F.round(F.coalesce("o_lon", "d_lon", "lon"), 6).alias("lon"), F.round(F.coalesce("o_lat", "d_lat", "lat"), 6).alias("lat"), src.alias("source"))
