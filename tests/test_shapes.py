import pytest
from freshet.operators import shapes as sh
from freshet.operators import spatial as s
from freshet.plans import registry

U = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]


def ring(spark, corners=U, at=90.0):
    return spark.createDataFrame([(1, k, at + x, 25.0 + y) for k, (x, y) in enumerate(corners)], "shape_id long, seq int, x double, y double")


def test_cell_shares_close(spark):
    w = sh.cell_weights(ring(spark), 0.7).collect()
    assert abs(sum(r["share"] for r in w) - 1) < 1e-9 and all(r["closure"] < 1e-7 for r in w)


def test_interior_point_of_a_concave_ring(spark):
    e = s.vertex_edges(ring(spark))
    p = sh.interior_points(e, s.ring_area(e).select("shape_id", "cx", "cy"), 0.1).first()
    held = s.points_in_shapes(spark.createDataFrame([(1, p["lon"], p["lat"])], "point_id long, lon double, lat double"), e).count()
    assert not p["centroid"] and held == 1


def test_line_joins_vertices_across_an_exit(spark):
    line = spark.createDataFrame([(1, i, 90.0 + x, 27.0) for i, x in enumerate([0.2, 0.8, 1.5, 2.2, 5.0])], "line_id long, seq int, lon double, lat double")
    got = sh.line_inside(line, s.vertex_edges(ring(spark))).first()
    assert got["vertices"] == 3 and 195 < got["km"] < 200


def test_search_ranks(spark):
    q = spark.createDataFrame([("dubri",)], "q string")
    places = spark.createDataFrame([(1, "Dhubri"), (2, "Dubri Bazar"), (3, "Dubri"), (4, "Majuli"), (5, "Dabbare")], "place_id long, name string")
    got = [(r["place_id"], r["rank"]) for r in sh.search(q, places, 3).orderBy("place").collect()]
    assert got == [(3, 0), (2, 1), (5, 3)]


@pytest.mark.parametrize("name", ["snapshot_join", "window_totals", "publication_state"])
def test_registered_queries_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
