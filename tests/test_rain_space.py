from datetime import datetime, timedelta

from freshet.operators import publication as p
from freshet.operators import rainfall as r
from freshet.operators import spatial as s
from pyspark.sql import functions as F

END = datetime(2024, 7, 4)
AS_OF = "2024-07-04 00:00:00"


def obs(spark, skip=()):
    rows = [(c, END - timedelta(minutes=30 * i), 2.0) for c in ("c1", "c2") for i in range(1, 145) if (c, i) not in skip]
    return spark.createDataFrame(rows, "cell_id string, interval_start timestamp_ntz, rate double").select("cell_id", "interval_start", F.col("rate").cast("decimal(18,6)").alias("rate_mm_h"))


def totals(spark, o):
    w = spark.createDataFrame([("z", "c1", 0.25), ("z", "c2", 0.75)], "zone_id string, cell_id string, share double")
    return {x["window_hours"]: (x["total_mm"], x["unavailable_reason"]) for x in r.window_totals(w, o, r.windows(spark, (1, 3, 24, 72), AS_OF)).collect()}


def test_one_missing_half_hour_refuses_only_the_windows_that_hold_it(spark):
    assert totals(spark, obs(spark)) == {h: (float(h) * 2, None) for h in (1, 3, 24, 72)}
    got = totals(spark, obs(spark, skip={("c1", 10)}))
    assert got[1] == (2.0, None) and got[3] == (6.0, None) and got[24] == (None, "series_broken") and got[72] == (None, "series_broken")
    assert totals(spark, obs(spark, skip={("c2", 1)}))[3] == (None, "window_not_covered")
    assert totals(spark, obs(spark).where("cell_id = 'c1'"))[1] == (None, "missing_cells")


def square(spark, *corners):
    rows = [(i, k, x + dx, y + dy) for i, (x, y) in enumerate(corners) for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    return s.vertex_edges(spark.createDataFrame([(i, k, float(x), float(y)) for i, k, x, y in rows], "shape_id long, seq int, x double, y double"))


def test_shared_border_belongs_to_one_side(spark):
    e = square(spark, (90, 25), (91, 25))
    pts = spark.createDataFrame([(1, 90.5, 25.5), (2, 91.0, 25.5), (3, 91.5, 25.0), (4, 95.0, 25.5)], "point_id long, lon double, lat double")
    got = {(x["point_id"], x["shape_id"]) for x in s.points_in_shapes(pts, e).collect()}
    assert got == {(1, 0), (2, 1), (3, 1)}
    area = s.ring_area(e).collect()
    assert all(abs(a["area"] - 1) < 1e-9 for a in area) and {round(a["cx"], 6) for a in area} == {90.5, 91.5}


def test_raster_matches_area_and_overlaps_pair_once(spark):
    cells = s.rasterize(square(spark, (90, 25), (90.5, 25)), 0.1)
    assert {x["shape_id"]: x["count"] for x in cells.groupBy("shape_id").count().collect()} == {0: 100, 1: 100}
    assert [tuple(x) for x in s.overlaps(cells).collect()] == [(0, 1, 50)]


def test_nearest_looks_into_neighbouring_cells(spark):
    a = spark.createDataFrame([(1, 90.0, 25.0), (2, 99.0, 25.0)], "a long, lon double, lat double")
    b = spark.createDataFrame([(7, 90.3, 25.3), (8, 89.9, 24.95), (9, 89.9, 24.95)], "b long, lon double, lat double")
    assert {x["a"]: x["b"] for x in s.nearest(a, b, "a", "b", 60).collect()} == {1: 8, 2: None}


def test_two_far_schools_give_no_centre(spark):
    pts = spark.createDataFrame([("a", 90.0, 25.0), ("a", 92.0, 27.0), ("b", 90.0, 25.0), ("b", 90.01, 25.0), ("b", 93.0, 25.0)], "k string, lon double, lat double")
    assert [x["k"] for x in s.coherent(pts, "k", 5).collect()] == ["b"]


def test_quarantined_revision_leaves_the_pointer(spark):
    d = lambda i: datetime(2024, 1, i)
    rows = [(1, 1, d(1), d(1), "validated", 1.0), (2, 1, d(2), d(2), "quarantined", 2.0), (3, 1, d(1), d(1), "validated", 3.0), (4, 2, d(1), d(1), "quarantined", 4.0)]
    rev = spark.createDataFrame(rows, "revision_id long, entity_id long, report_date timestamp_ntz, fetched_at timestamp_ntz, publication_state string, metric double")
    got = {x["entity_id"]: (x["latest_attempt"], x["latest_valid"], x["newer_quarantined"]) for x in p.status(rev).collect()}
    assert got == {1: (2, 3, True), 2: (4, None, True)}
    assert {x["revision_id"]: x["state"] for x in p.states(rev).collect()} == {1: "superseded", 2: "quarantined", 3: "current", 4: "quarantined"}


def test_content_revision_ignores_row_order(spark):
    df = spark.range(50).withColumn("k", F.lit(1)).withColumn("v", F.col("id") * 3)
    a = p.content_revision(df, ["k"], ["id", "v"]).first()["revision"]
    assert a == p.content_revision(df.orderBy(F.desc("id")).repartition(4), ["k"], ["id", "v"]).first()["revision"]
    assert a != p.content_revision(df.withColumn("v", F.col("v") + 1), ["k"], ["id", "v"]).first()["revision"]
