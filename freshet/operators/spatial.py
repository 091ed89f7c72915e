"""Places, rings and raster cells, as equi-joins on grid keys.

A ring is a table of edges. Points and edges, points and stations, meet through a degree grid, so the exact test
runs only on neighbours; nothing is compared all against all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.shared import keep

EARTH_KM = 6371.0


def haversine_km(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    a = F.pow(F.sin(F.radians(F.col(lat2) - F.col(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(F.col(lon2) - F.col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def coord_state(lon: str, lat: str, box: tuple[float, float, float, float]) -> Column:
    missing = F.col(lon).isNull() | F.col(lat).isNull()
    inside = F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])
    return F.when(missing, "missing").when(inside, "valid").otherwise("invalid")


def grid_key(value: Column | str, step: float) -> Column:
    """Index of the cell whose lower corner is at or below the value; rounding keeps corners in their own cell."""
    return F.floor(F.round((F.col(value) if isinstance(value, str) else value) / step, 9)).cast("int")


def vertex_edges(vertices: DataFrame) -> DataFrame:
    """Edges of closed rings: each vertex and its successor, the last one with the first. A shape with holes or parts has
    its rings told apart by a column ring_no, which the edges keep; without that column a shape is one ring."""
    ring = ["shape_id", "ring_no"] if "ring_no" in vertices.columns else ["shape_id"]
    w = Window.partitionBy(*ring).orderBy("seq")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(full))
    return vertices.select(*ring, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def ring_area(edges: DataFrame) -> DataFrame:
    """(shape_id, vertices, area, cx, cy, area_km2): planar area, centroid and the area on the sphere.

    Each ring counts by itself, whichever way it is drawn: a ring inside an odd number of the shape's other rings is a
    hole. On the sphere the integral of -sin(lat) d(lon) is exact along edges that are straight in degrees. A ring
    without area adds nothing; if none has any, the centroid is the mean of the vertices."""
    ring = ["shape_id", "ring_no"] if "ring_no" in edges.columns else ["shape_id"]
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    p1, p2 = F.radians("y1"), F.radians("y2")
    along = F.when(F.abs(p2 - p1) < 1e-12, F.sin(p1)).otherwise(F.try_divide(F.cos(p1) - F.cos(p2), p2 - p1))
    g = edges.groupBy(*ring).agg(
        (F.sum(cross) / 2).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"),
        (-F.sum(F.radians(F.col("x2") - F.col("x1")) * along) * EARTH_KM**2).alias("km2"), F.count("*").alias("n"), F.sum("x1").alias("vx"), F.sum("y1").alias("vy"),
    )
    sign = F.lit(1)
    if len(ring) > 1:
        g = g.join(_ring_depths(edges), ring, "left")
        sign = F.when(F.coalesce("depth", F.lit(0)) % 2 == 1, -1).otherwise(1)
    way = F.when(F.col("a") < 0, -sign).otherwise(sign)
    g = g.groupBy("shape_id").agg(
        F.sum("n").alias("vertices"), F.sum(way * F.col("a")).alias("a"), F.sum(way * F.col("sx")).alias("sx"), F.sum(way * F.col("sy")).alias("sy"), F.sum(sign * F.abs("km2")).alias("km2"), F.sum("vx").alias("vx"), F.sum("vy").alias("vy"),
    )
    centre = lambda c: F.coalesce(F.try_divide(F.col(f"s{c}"), 6 * F.col("a")), F.col(f"v{c}") / F.col("vertices"))
    return g.select("shape_id", "vertices", F.abs("a").alias("area"), centre("x").alias("cx"), centre("y").alias("cy"), F.abs("km2").alias("area_km2"))


def _ring_depths(edges: DataFrame) -> DataFrame:
    """(shape_id, ring_no, depth): how many of a shape's other rings hold the ring's first vertex, by the even-odd rule."""
    first = edges.groupBy("shape_id", "ring_no").agg(F.min_by(F.struct("x1", "y1"), "seq").alias("p")).select("shape_id", F.col("ring_no").alias("own"), F.col("p.x1").alias("px"), F.col("p.y1").alias("py"))
    met = first.join(edges, "shape_id").where((F.col("ring_no") != F.col("own")) & ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))))
    left = F.col("px") < F.try_divide((F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    held = met.groupBy("shape_id", "own", "ring_no").agg((F.count_if(left) % 2).alias("odd"))
    return held.groupBy("shape_id", F.col("own").alias("ring_no")).agg(F.sum("odd").alias("depth"))


def ring_signs(edges: DataFrame) -> DataFrame:
    """Edges with the sign that makes what their rings enclose count as positive: 1 for rings drawn against the clock,
    -1 for the others, turned round for holes, 0 for rings without area."""
    ring = ["shape_id", "ring_no"] if "ring_no" in edges.columns else ["shape_id"]
    way = edges.groupBy(*ring).agg(F.signum(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))).alias("sign"))
    if len(ring) > 1:
        way = way.join(_ring_depths(edges), ring, "left").withColumn("sign", F.when(F.coalesce("depth", F.lit(0)) % 2 == 1, -F.col("sign")).otherwise(F.col("sign"))).drop("depth")
    return edges.join(way, ring)


def rows_of(edges: DataFrame, step: float) -> DataFrame:
    """Edges repeated for every grid row they touch: the join key of points and scanlines."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    return edges.withColumn("row", F.explode(F.sequence(grid_key(lo, step), grid_key(hi, step))))


def cover(edges: DataFrame, step: float, slack: float = 1e-6) -> DataFrame:
    """(shape_id, col, row, full): the cells of a shape. Border cells are those that an edge meets or nearly meets (within
    `slack` of a cell); of the others the centre decides, by the even-odd rule over all rings, so full cells lie inside
    as a whole. Inner cells outnumber border cells by the shape's width in cells and carry no edges."""
    wide = lambda lo, hi: F.sequence(F.floor(lo / step - slack).cast("int"), F.floor(hi / step + slack).cast("int"))
    e = edges.select("shape_id", "x1", "y1", "x2", "y2").withColumn("row", F.explode(wide(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    t = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n * step - F.col("y1")) / (F.col("y2") - F.col("y1"))))
    steep = F.abs(F.col("y2") - F.col("y1")) > slack * step
    x = lambda n, flat: F.when(steep, F.col("x1") + (F.col("x2") - F.col("x1")) * t(n)).otherwise(F.col(flat))
    e = e.withColumns({"_a": x(F.col("row") - slack, "x1"), "_b": x(F.col("row") + 1 + slack, "x2")})
    border = e.select("shape_id", F.explode(wide(F.least("_a", "_b"), F.greatest("_a", "_b"))).alias("col"), "row").distinct()
    inner = rasterize(edges, step).join(border, ["shape_id", "col", "row"], "left_anti")
    return border.withColumn("full", F.lit(False)).unionByName(inner.select("shape_id", "col", "row", F.lit(True).alias("full")))


def points_in_shapes(points: DataFrame, edges: DataFrame, step: float = 0.1) -> DataFrame:
    """(point columns, shape_id) for every shape that holds the point by the even-odd rule over all its rings.

    Points meet the cells that shapes cover: in a full cell a point is inside at once, in a border cell it is tested
    against the edges of that shape alone, in its row. The crossing test is strict on one side, so a point on a shared
    border belongs to one side only. Counts combine before the final shuffle. Equal point rows are tested once and come
    back as often as they were given."""
    p = points.groupBy(*points.columns).agg(F.count("*").alias("_n")).withColumns({"col": grid_key("lon", step), "row": grid_key("lat", step)})
    met = p.join(cover(edges, step), ["col", "row"]).drop("col")
    j = met.where("not full").join(rows_of(edges.drop("seq", "ring_no"), step), ["shape_id", "row"])
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hit = j.where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))).where(crosses)
    held = hit.groupBy(*points.columns, "shape_id", "_n").agg(F.count("*").alias("_c")).where("_c % 2 = 1").drop("_c")
    held = held.unionByName(met.where("full").select(*held.columns))
    return held.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_i")


def first_shape(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Each point with the first shape that holds it, null outside all."""
    inside = points_in_shapes(points, edges).groupBy("point_id").agg(F.min("shape_id").alias("shape_id"), F.count("*").alias("holders"))
    return points.join(inside, "point_id", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))


def majority_shape(vertices: DataFrame, edges: DataFrame, stride: int = 3) -> DataFrame:
    """For each ring, the other shape that holds most of every third vertex, and its share."""
    every = vertices.where(F.col("seq") % stride == 0).select(F.col("shape_id").alias("owner"), "seq", F.col("x").alias("lon"), F.col("y").alias("lat"))
    n = every.groupBy("owner").agg(F.count("*").alias("n"))
    held = points_in_shapes(every, edges).where("owner <> shape_id").groupBy("owner", "shape_id").agg(F.count("*").alias("c"))
    best = held.groupBy("owner").agg(F.max_by(F.struct("shape_id", "c"), F.struct("c", -F.col("shape_id"))).alias("b"))
    return n.join(best, "owner", "left").select("owner", F.col("b.shape_id").alias("shape_id"), F.round(F.coalesce("b.c", F.lit(0)) / F.col("n"), 6).alias("share"))


def rasterize(edges: DataFrame, step: float) -> DataFrame:
    """(shape_id, col, row) cells whose centre lies inside: crossings of each row's centre line, paired in order."""
    y = (F.col("row") + 0.5) * step
    r = rows_of(edges, step).withColumn("yc", y).where((F.col("y1") > F.col("yc")) != (F.col("y2") > F.col("yc")))
    r = r.withColumn("xc", F.round((F.col("x2") - F.col("x1")) * (F.col("yc") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"), 9))
    w = Window.partitionBy("shape_id", "row").orderBy("xc", "seq")
    spans = r.select("shape_id", "row", "xc", F.lead("xc").over(w).alias("xe"), F.row_number().over(w).alias("k")).where("k % 2 = 1 and xe is not null")
    lo, hi = F.ceil(F.round(F.col("xc") / step - 0.5, 6)), F.ceil(F.round(F.col("xe") / step - 0.5, 6)) - 1
    return spans.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select("shape_id", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("col"), "row")


def overlaps(cells: DataFrame) -> DataFrame:
    """Cells shared by pairs of shapes: the holders of one cell are few, so pairs are made per cell."""
    b = cells.select(F.col("shape_id").alias("other"), "col", "row")
    return cells.join(b, ["col", "row"]).where("shape_id < other").groupBy("shape_id", "other").agg(F.count("*").alias("cells"))


def contamination(cells: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """Per shape: points of its own and of others inside its cells."""
    p = points.withColumns({"col": grid_key("lon", step), "row": grid_key("lat", step)})
    j = p.join(cells, ["col", "row"])
    g = j.groupBy("shape_id").agg(F.count_if(F.col("owner_id") == F.col("shape_id")).alias("own"), F.count_if(F.col("owner_id") != F.col("shape_id")).alias("foreign"))
    return g.withColumn("foreign_share", F.round(F.col("foreign") / (F.col("own") + F.col("foreign")), 6))


def rounded_km(km: Column) -> Column:
    """Six decimals, halves up, without a decimal number per row."""
    return F.floor(km * 1e6 + 0.5) / 1e6


def _by_position(rows: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """(lon, lat, name): the other columns of the rows of a position as an array of at most about `most` structs; a position
    with more rows has several arrays."""
    at, others = rows.where("lon is not null and lat is not null"), F.struct(*[c for c in rows.columns if c not in ("lon", "lat")])
    n = at.groupBy("lon", "lat").agg(F.ceil(F.count("*") / most).alias("_n"))
    dealt = at.join(n, ["lon", "lat"]).withColumn("_part", F.pmod(F.xxhash64(others), F.col("_n")))
    return dealt.groupBy("lon", "lat", "_part").agg(F.collect_list(others).alias(name)).drop("_part")


def _met(left: DataFrame, right: DataFrame, km: float, fine: int = 1) -> DataFrame:
    """Pairs of rows within km, with lon2, lat2 and the distance: the left side looks into the grid cells around its own,
    `fine` on each side. Cells are bands of latitude, cut into equal parts; so many parts together are at least as wide as
    km spans at the band's highest latitude and the bands beyond, so pairs meet at any latitude and across 180 degrees."""
    lat_step, around_ = km / 110.0 / fine, range(-fine, fine + 1)
    top = F.least(F.lit(90.0), (F.greatest(F.abs("gy"), F.abs(F.col("gy") + 1)) + fine) * lat_step)
    span = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / (2 * EARTH_KM))) / F.cos(F.radians(top)))))
    parts = F.greatest(F.lit(1), F.floor(360 / span * fine))
    cell = F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) * parts / 360)
    band = grid_key("lat", lat_step)
    around = left.withColumn("gy", F.explode(F.array(*[band + i for i in around_])))
    around = around.withColumn("gx", F.explode(F.array_distinct(F.array(*[F.pmod(cell + i, parts) for i in around_]))))
    other = right.withColumn("gy", band).withColumn("gx", F.pmod(cell, parts)).withColumnsRenamed({"lon": "lon2", "lat": "lat2"})
    if fine > 1:  # few bytes but many pairs: a fixed number of partitions, which AQE does not coalesce
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        around, other = around.repartition(n, "gx", "gy"), other.repartition(n, "gx", "gy")
    return around.join(other, ["gx", "gy"]).withColumn("km", haversine_km("lon", "lat", "lon2", "lat2")).where(F.col("km") <= km).drop("gx", "gy")


def near(left: DataFrame, right: DataFrame, km: float, exact: bool = True) -> DataFrame:
    """Pairs within km, with the distance. Each pair of positions is measured once; the rows of the positions are put in
    afterwards, without a shuffle. With exact=False the distance is rounded to six decimals, also for the limit."""
    pairs = _met(_by_position(left, "_l"), _by_position(right, "_r"), km + (0.0 if exact else 1e-6), fine=3)
    if not exact:
        pairs = pairs.withColumn("km", rounded_km(F.col("km"))).where(F.col("km") <= km)
    return pairs.select("lon", "lat", "lon2", "lat2", "km", "_r", F.inline("_l")).select("*", F.inline("_r")).drop("_r")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float) -> DataFrame:
    """Nearest right row within km of each left row (equal distances: smaller id); null beyond."""
    return left.select(left_id, "lon", "lat").join(_nearest_positions(left, right, right_id, km), ["lon", "lat"], "left").select(left_id, right_id, "km")


def nearest_any(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float) -> DataFrame:
    """Nearest right row of each left row at whatever distance (equal distances: smaller id); the first look is at km or
    nearer. Null only where left has no coordinates or right is empty."""
    best = _nearest_positions(left, right, right_id, math.pi * EARTH_KM + 1, km)
    return left.select(left_id, "lon", "lat").join(best, ["lon", "lat"], "left").select(left_id, right_id, "km")


def _nearest_positions(left: DataFrame, right: DataFrame, right_id: str, most: float, first: float | None = None) -> DataFrame:
    """(lon, lat, right_id, km) of every position of left with a right row within `most` km: distinct positions on both
    sides, of a right position the smallest id. The first look is as far as right positions lie apart on average, so few
    are met; positions that find none look again four times as far. Distances are rounded, also for the limit."""
    there = "lon is not null and lat is not null"
    rest = left.where(there).select("lon", "lat").distinct()
    spots = keep(right.where(there).groupBy("lon", "lat").agg(F.min(right_id).alias(right_id)), "positions")
    n, x0, x1, y0, y1 = spots.agg(F.count("*"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if not n:
        return rest.limit(0).withColumns({right_id: F.lit(None).cast(right.schema[right_id].dataType), "km": F.lit(None).cast("double")})
    apart = 111.2 * math.sqrt(max(x1 - x0, 1e-3) * max(y1 - y0, 1e-3) / n)
    km, found = min(most, max(apart, 1e-3), first or most), None
    while True:
        met = _met(rest, spots, km + 1e-6).withColumn("km", rounded_km(F.col("km"))).where(F.col("km") <= km)
        best = met.groupBy("lon", "lat").agg(F.min(F.struct("km", right_id)).alias("_b"))
        got = keep(rest.join(best, ["lon", "lat"], "left").select("lon", "lat", f"_b.{right_id}", "_b.km"), "nearest")
        hit, rest = got.where("km is not null"), got.where("km is null").select("lon", "lat")
        found = hit if found is None else found.unionByName(hit)
        if km >= most or rest.isEmpty():
            return found
        km = min(4 * km, most)


def pairs_of(left: DataFrame, right: DataFrame, key: str, by: tuple[list[str], list[str]] | None = None, grid: tuple[int, int] | None = None) -> DataFrame:
    """The equi-join on a key of few values, where each row meets very many: rows of both sides are dealt into parts, and each
    pair of parts is a task of its own, so no task holds all of a key. A part is copied to its tasks by one task, in blocks
    that are long enough to compress well. by: what left and right rows are dealt by, all columns
    if not given; grid: parts of left and of right, by default as many pairs of parts as shuffles have partitions."""
    n = math.ceil(math.sqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    (rows, cols), (by_left, by_right) = grid or (n, n), by or (left.columns, right.columns)
    part = lambda names, parts: F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    deal = lambda df, parts, name: df.repartitionById(parts, F.col(name))
    a = deal(left.withColumn("_i", part(by_left, rows)), rows, "_i").withColumn("_t", F.explode(F.sequence(F.col("_i") * cols, F.col("_i") * cols + cols - 1))).drop("_i")
    b = deal(right.withColumn("_j", part(by_right, cols)), cols, "_j").withColumn("_t", F.explode(F.sequence("_j", F.lit(rows * cols - 1), F.lit(cols)))).drop("_j")
    return deal(b, rows * cols, "_t").join(deal(a, rows * cols, "_t").hint("merge"), [key, "_t"]).drop("_t")


def _ids_by_position(rows: DataFrame, row_id: str, key: str, name: str, most: int = 64) -> DataFrame:
    """(key, lon, lat, _part, name): the ids of the rows of a key at one position as arrays of at most `most`. Rows without
    coordinates and without id stay."""
    nth = F.row_number().over(Window.partitionBy(key, "lon", "lat").orderBy(row_id))
    dealt = rows.select(key, "lon", "lat", row_id, F.floor((nth - 1) / most).alias("_part"))
    return dealt.groupBy(key, "lon", "lat", "_part").agg(F.collect_list(F.struct(row_id)).alias(name)).withColumn(name, F.col(name)[row_id])


def distances(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, most: int = 1 << 25) -> DataFrame:
    """(left_id, right_id, km) for every pair of rows with an equal key, rounded; null without coordinates.

    The result is as long as its pairs are many, so it is kept short to write: a pair of positions is measured once and its
    rows follow each other, places in runs, and a task makes about `most` pairs of few positions, all keys among them, so
    that equal values stand together and a file's values are few. The right side is the one with more rows at a position."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").cast("double").alias(name))
    pairs, n_left, n_right = count(left, "_a").join(count(right, "_b"), key).agg(F.sum(F.col("_a") * F.col("_b")), F.sum("_a"), F.sum("_b")).first()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((pairs or 0) / most))
    rows = min(tasks, max(1, round(math.sqrt(tasks * (n_left or 1) / (n_right or 1)))))
    a = _ids_by_position(left, left_id, key, "_l")
    b = _ids_by_position(right, right_id, key, "_r").withColumnsRenamed({"lon": "lon2", "lat": "lat2", "_part": "_part2"})
    j = pairs_of(a, b, key, (["lon", "lat", "_part"], ["lon2", "lat2", "_part2"]), (rows, math.ceil(tasks / rows)))
    j = j.select("_l", "_r", rounded_km(haversine_km("lon", "lat", "lon2", "lat2")).alias("km"))
    return j.select("_r", "km", F.explode("_l").alias(left_id)).select(left_id, F.explode("_r").alias(right_id), "km")


def assigned_distance(left: DataFrame, right: DataFrame, left_id: str, right_id: str, assigned: str, km: float = 60, far: float = 60, margin: float = 25) -> DataFrame:
    """Distance to the assigned right row and to the nearest one, and two marks: assigned beyond `far` km, and another row
    nearer by more than `margin` km. Without an assigned row, or one without coordinates, its distance is null and neither
    mark is set."""
    own = right.select(F.col(right_id).alias(assigned), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    a = left.join(own, assigned, "left").withColumn("assigned_km", F.round(haversine_km("lon", "lat", "lon2", "lat2"), 6)).select(left_id, assigned, "assigned_km")
    out = a.join(nearest_any(left, right, left_id, right_id, km).withColumnRenamed("km", "nearest_km"), left_id)
    much = F.coalesce((F.col(right_id) != F.col(assigned)) & (F.col("assigned_km") - F.col("nearest_km") > margin), F.lit(False))
    return out.withColumns({"far": F.coalesce(F.col("assigned_km") > far, F.lit(False)), "much_nearer": much})


def coherent(points: DataFrame, key: str, km: float) -> DataFrame:
    """Keys whose points mostly lie within km of their median point, with the centre of those."""
    mid = points.groupBy(key).agg(F.median("lon").alias("mlon"), F.median("lat").alias("mlat"), F.count("*").alias("n"))
    j = points.join(mid, key).where(haversine_km("lon", "lat", "mlon", "mlat") <= km)
    g = j.groupBy(key).agg(F.count("*").alias("near"), F.max("n").alias("n"), F.round(F.avg("lon"), 8).alias("lon"), F.round(F.avg("lat"), 8).alias("lat"))
    return g.where("2 * near > n")


# Kilometres of a degree of latitude, and of longitude at 26 degrees north.
KM_LAT, KM_LON = 110.57, 111.32 * math.cos(math.radians(26.0))


def distance_to_edges(points: DataFrame, edges: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(point_id, shape_id, distance): kilometres in the local plane from each point to the outline of its own shape, the
    nearest of its edges. A repeated vertex makes an edge without length, which is as near as the vertex."""
    j = points.join(edges, F.col(owner) == F.col("shape_id"))
    px, py, dx, dy = ((F.col("lon") - F.col("x1")) * KM_LON, (F.col("lat") - F.col("y1")) * KM_LAT, (F.col("x2") - F.col("x1")) * KM_LON, (F.col("y2") - F.col("y1")) * KM_LAT)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    return j.withColumn("_d", F.hypot(px - t * dx, py - t * dy)).groupBy("point_id", "shape_id").agg(F.min("_d").alias("distance"))


def shape_score(points: DataFrame, edges: DataFrame, close: float = 0.5) -> DataFrame:
    """Per shape, over its own points: inside, outside but no further than `close` kilometres, agreement of both, and how
    far the others, the strays, lie: their upper median and their maximum, null without strays."""
    inside = points_in_shapes(points, edges).where("owner_id = shape_id").select("point_id", F.lit(True).alias("inside")).distinct()
    d = distance_to_edges(points, edges).join(inside, "point_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    out = ~F.col("inside")
    stray = F.when(out & (F.col("distance") > close), F.col("distance"))
    g = d.groupBy("shape_id").agg(
        F.count("*").alias("points"), F.count_if(F.col("inside")).alias("inside"), F.count_if(out & (F.col("distance") <= close)).alias("close"),
        F.count(stray).alias("strays"), F.sort_array(F.collect_list(stray)).alias("_s"),
    )
    at = lambda i: F.round(F.when(F.size("_s") > 0, F.get("_s", i)), 6)
    g = g.withColumns({"median_stray_km": at(F.floor(F.size("_s") / 2).cast("int")), "max_stray_km": at(F.size("_s") - 1)}).drop("_s")
    return g.withColumn("agreement", F.round((F.col("inside") + F.col("close")) / F.col("points"), 6))


def dissolve(edges: DataFrame) -> DataFrame:
    """Outline of a union: directed edges that are not met by their reverse, with how many remain."""
    r = edges.select(*[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])
    n = r.groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))
    back = n.select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("n").alias("m"))
    left = n.join(back, ["x1", "y1", "x2", "y2"], "left").withColumn("left_over", F.col("n") - F.coalesce("m", F.lit(0)))
    return left.where("left_over > 0").select("x1", "y1", "x2", "y2", "left_over")
