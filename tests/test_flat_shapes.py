"""Equal times, repeated vertices, flat rings and holes."""

import math
from datetime import datetime, timedelta

import pytest
from freshet.operators import gauges, hydrology, spatial
from pyspark.sql import functions as F

T0 = datetime(2024, 7, 1)
RINGS = "shape_id int, ring_no int, seq int, x double, y double"


def square(shape, ring, x, y, side, back=False):
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(shape, ring, i, float(a), float(b)) for i, (a, b) in enumerate(reversed(corners) if back else corners)]


def edges(spark, rows):
    return spatial.vertex_edges(spark.createDataFrame(rows, RINGS))


def test_readings_of_one_time_have_no_trend(spark):
    rows = [("a", T0, 1.0), ("a", T0, 2.0), ("b", T0, 1.0), ("b", T0 + timedelta(hours=1), 1.5)]
    got = {r.gauge_id: (r.trend_cm_per_hour, r.reason) for r in gauges.trend(spark.createDataFrame(rows, "gauge_id string, observed_at timestamp_ntz, level_m double")).collect()}
    assert got == {"a": (None, "one_time"), "b": (50.0, None)}


def test_a_constant_side_has_no_correlation(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 2.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, 3.0, 6.0), (2, None, 9.0), (3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {r.k: r.c for r in df.groupBy("k").agg(hydrology.pearson(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got[1] is None and got[3] is None and got[2] == pytest.approx(1.0)


@pytest.mark.parametrize("back", [False, True])
def test_holes_islands_and_flat_rings(spark, back):
    rows = square(1, 0, 90, 25, 10) + square(1, 1, 92, 27, 2, back) + square(1, 2, 92.5, 27.5, 0.5) + [(1, 3, 0, 91.0, 26.0), (1, 3, 1, 92.0, 26.0), (1, 3, 2, 91.5, 26.0)]
    rows += [(2, 0, 0, 90.0, 25.0), (2, 0, 1, 91.0, 25.0), (2, 0, 2, 92.0, 25.0)]
    got = {r.shape_id: r for r in spatial.ring_area(edges(spark, rows)).collect()}
    assert got[1].area == pytest.approx(100 - 4 + 0.25) and got[1].vertices == 15
    assert (got[2].area, got[2].cx, got[2].cy, got[2].area_km2) == (0.0, 91.0, 25.0, pytest.approx(0.0, abs=1e-6))


def test_area_on_the_sphere_is_exact_and_adds_up(spark):
    whole = square(1, 0, 90, 20, 8)
    parts = [r for i in range(4) for r in square(10 + i, 0, 90 + 4 * (i % 2), 20 + 4 * (i // 2), 4)]
    got = {r.shape_id: r.area_km2 for r in spatial.ring_area(edges(spark, whole + parts)).collect()}
    band = 6371.0**2 * math.radians(8) * (math.sin(math.radians(28)) - math.sin(math.radians(20)))
    assert got[1] == pytest.approx(band, rel=1e-12) and sum(v for k, v in got.items() if k >= 10) == pytest.approx(band, rel=1e-12)


def test_a_repeated_vertex_and_strays(spark):
    ring = square(1, 0, 90, 26, 1) + [(1, 0, 4, 90.0, 27.0)]
    km = spatial.KM_LAT
    points = [(1, 1, 90.5, 26.5), (2, 1, 90.5, 27 + 0.4 / km), (3, 1, 90.5, 27 + 2 / km), (4, 1, 90.5, 26 - 3 / km), (5, 1, 90.5, 26 - 1 / km), (6, 2, 0.0, 0.0)]
    df = spark.createDataFrame([(*p[:2], *p[2:]) for p in points], "point_id int, owner_id int, lon double, lat double")
    r = spatial.shape_score(df, edges(spark, ring)).first()
    assert (r.points, r.inside, r.close, r.strays, r.median_stray_km, r.max_stray_km, r.agreement) == (5, 1, 1, 3, 2.0, 3.0, 0.4)
