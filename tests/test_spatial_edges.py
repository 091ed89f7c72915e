import math
import random

from freshet.operators import spatial
from freshet.shared import numbered
from pyspark.sql import functions as F


def km(a, b):
    (lon1, lat1), (lon2, lat2) = [[math.radians(v) for v in p] for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * spatial.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def test_near_at_every_latitude_and_across_the_date_line(spark):
    draw = random.Random(5)
    bases = [(0, 0), (92, 26), (10, 60), (179.9, 45), (-179.9, -70), (30, 89.5), (0, -89.8)]
    points = [(((x + draw.uniform(-2, 2) + 180) % 360) - 180, max(-90.0, min(90.0, y + draw.uniform(-1.2, 1.2)))) for x, y in bases for _ in range(12)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "a int, lon double, lat double")
    right = left.withColumnRenamed("a", "b")
    got = sorted((r["a"], r["b"]) for r in spatial.near(left, right, 70).collect())
    want = sorted((i, j) for i, p in enumerate(points) for j, q in enumerate(points) if km(p, q) <= 70)
    assert got == want and len(want) > len(points)


def test_repeated_points_are_inside_too(spark):
    ring = [("s", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])]
    edges = spatial.vertex_edges(spark.createDataFrame(ring, "shape_id string, seq int, x double, y double"))
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (3, 9.0, 1.0), (None, 1.0, 3.0)], "point_id int, lon double, lat double")
    got = sorted(str(r["point_id"]) for r in spatial.points_in_shapes(points, edges).collect())
    assert got == ["1", "2", "2", "None"]


def test_holes_are_rings_of_their_own(spark):
    square = lambda s, r, lo, hi: [(s, r, i, float(x), float(y)) for i, (x, y) in enumerate([(lo, lo), (hi, lo), (hi, hi), (lo, hi)])]
    rings = square("a", 1, 0, 10) + square("a", 2, 4, 6) + square("a", 3, 20, 21)
    edges = spatial.vertex_edges(spark.createDataFrame(rings, "shape_id string, ring_no int, seq int, x double, y double"))
    assert edges.count() == 12 and edges.where("abs(x2 - x1) > 10").isEmpty()
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.5, 20.5), (4, 15.0, 15.0)], "point_id int, lon double, lat double")
    assert {r["point_id"] for r in spatial.points_in_shapes(points, edges).collect()} == {1, 3}


def test_nearest_at_any_distance(spark):
    left = [(1, 91.0, 26.0), (2, -70.0, -80.0), (3, 179.9, 10.0), (4, None, 1.0)]
    right = [(10, 91.0, 26.5), (11, -179.9, 10.0), (12, 60.0, 60.0), (13, 91.0, 26.5)]
    a, b = spark.createDataFrame(left, "id int, lon double, lat double"), spark.createDataFrame(right, "rid int, lon double, lat double")

    want = {i: min((round(km((x, y), (u, v)), 6), r) for r, u, v in right)[1] if x is not None else None for i, x, y in left}
    assert {r["id"]: r["rid"] for r in spatial.nearest_any(a, b, "id", "rid", 5).collect()} == want
    assert {r["rid"] for r in spatial.nearest_any(a, b.limit(0), "id", "rid", 5).collect()} == {None}
    marks = spatial.assigned_distance(a.withColumn("own", F.when(F.col("id") < 3, 12).otherwise(99)), b, "id", "rid", "own").collect()
    assert {r["id"]: (r["far"], r["much_nearer"]) for r in marks} == {1: (True, True), 2: (True, want[2] != 12), 3: (False, False), 4: (False, False)}


def test_places_are_numbered_whole(spark):
    rows = [(i, i * 7919 % 101) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "id int, v int").repartition(7), "place", F.desc("v"), F.asc("id")).collect()
    assert {r["id"]: r["place"] for r in got} == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert numbered(spark.createDataFrame([], "id int"), "place", F.asc("id")).collect() == []
