"""Cells, twins and swallowed shapes against clipping and plain Python."""

import math
import random

import pytest
from freshet.operators import outlines as o
from freshet.operators import spatial as s

U = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
HOLE = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
STAR = [(90 + (1 + i % 2) * math.cos(i * math.pi / 7), 25 + (1 + i % 2) * math.sin(i * math.pi / 7)) for i in range(14)]


def edges(spark, *rings):
    """rings: (shape, ring, corners)."""
    rows = [(sh, r, k, float(x), float(y)) for sh, r, c in rings for k, (x, y) in enumerate(c)]
    return s.vertex_edges(spark.createDataFrame(rows, "shape_id long, ring_no int, seq int, x double, y double"))


def clip(ring, axis, bound, sign):
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        u, v = sign * (p[axis] - bound), sign * (q[axis] - bound)
        if u >= 0:
            out.append(p)
        if (u >= 0) != (v >= 0):
            t = u / (u - v)
            out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
    return out


def sphere(ring):
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b = math.radians(y1), math.radians(y2)
        total += math.radians(x2 - x1) * (math.sin(a) if abs(b - a) < 1e-13 else (math.cos(a) - math.cos(b)) / (b - a))
    return abs(total) * 6371.0**2


def in_cell(ring, col, row, step):
    for axis, bound, sign in ((0, col * step, 1), (0, (col + 1) * step, -1), (1, row * step, 1), (1, (row + 1) * step, -1)):
        ring = clip(ring, axis, bound, sign)
    return sphere(ring) if len(ring) > 2 else 0.0


@pytest.mark.parametrize("step", [0.5, 0.3, 0.07])
@pytest.mark.parametrize("shape", ["u", "holed", "star"])
def test_areas_equal_clipping(spark, step, shape):
    rings = {"u": [(1, U)], "holed": [(1, SQUARE), (-1, HOLE)], "star": [(1, STAR)]}[shape]
    got = {(r.col, r.row): r.km2 for r in o.cell_areas(edges(spark, *[(1, i, c) for i, (_, c) in enumerate(rings)]), step).collect()}
    xs, ys = [x for _, c in rings for x, _ in c], [y for _, c in rings for _, y in c]
    for col in range(math.floor(min(xs) / step) - 1, math.floor(max(xs) / step) + 2):
        for row in range(math.floor(min(ys) / step) - 1, math.floor(max(ys) / step) + 2):
            assert got.get((col, row), 0.0) == pytest.approx(sum(g * in_cell(c, col, row, step) for g, c in rings), abs=1e-6)


def test_weights_close_and_flat_shapes_are_refused(spark):
    flat = [(5.0, 5.0), (6.0, 5.0), (7.0, 5.0)]
    repeated = [(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    w = o.cell_weights(edges(spark, (1, 0, SQUARE), (1, 1, HOLE), (2, 0, flat), (3, 0, repeated)), 0.3).collect()
    for k in (1, 3):
        mine = [r for r in w if r.shape_id == k]
        assert sum(r.share for r in mine) == pytest.approx(1, abs=1e-12) and all(r.closure < 1e-7 and r.refused is None for r in mine)
    assert [(r.shape_id, r.col, r.refused) for r in w if r.refused] == [(2, None, "no_area")]
    assert any(r.full for r in w) and o.cell_weights(edges(spark, (1, 0, SQUARE)).limit(0), 0.3).count() == 0


def test_weights_refuse_what_does_not_close(spark):
    eight = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 3.0)]
    w = o.cell_weights(edges(spark, (1, 0, SQUARE)), 0.3, closure=-1.0).collect()
    assert [(r.share, r.refused) for r in w] == [(None, "not_closed")]
    assert {r.refused for r in o.cell_weights(edges(spark, (1, 0, eight)), 0.3).collect()} <= {None, "not_closed"}


def test_points_by_cover_equal_the_plain_rule(spark):
    random.seed(3)
    rings = [(1, 0, U), (2, 0, SQUARE), (2, 1, HOLE), (3, 0, [(x - 89.3, y - 24.1) for x, y in STAR])]
    pts = [(i, round(random.uniform(-2, 4), 1), round(random.uniform(-2, 4), 1)) for i in range(400)] + [(400 + i, random.uniform(-2, 4), random.uniform(-2, 4)) for i in range(800)]
    p = spark.createDataFrame(pts + [(2000, None, 1.0), (2001, 1.0, None)], "point_id long, lon double, lat double")

    def inside(x, y, cs):
        n = 0
        for c in cs:
            for (x1, y1), (x2, y2) in zip(c, c[1:] + c[:1], strict=True):
                n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return n % 2 == 1

    want = {(i, k) for i, x, y in pts for k in (1, 2, 3) if inside(x, y, [c for sh, _, c in rings if sh == k])}
    for step in (0.1, 0.37):
        got = [(r.point_id, r.shape_id) for r in s.points_in_shapes(p, edges(spark, *rings), step).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_twins_whatever_the_start_direction_and_ring_order(spark):
    turned = U[3:] + U[:3]
    near = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.001)]
    got = o.twins(edges(spark, (1, 0, U), (2, 0, turned), (3, 0, U[::-1]), (4, 0, near), (5, 0, SQUARE), (5, 1, HOLE), (6, 0, HOLE[::-1]), (6, 1, [SQUARE[0], *SQUARE]), (7, 0, SQUARE), (8, 0, [(1.0, 1.0)])))
    assert sorted((r.shape_id, r.twin_of, r.twins) for r in got.collect()) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (5, 5, 2), (6, 5, 2)]


def test_swallowed_needs_every_point_and_three(spark):
    cells = s.rasterize(edges(spark, (1, 0, SQUARE)), 0.1)
    pts = [(9, 0.55, 0.55), (9, 0.55, 0.55), (9, 1.25, 1.25), (9, None, 3.0), (8, 0.5, 0.5), (8, 0.6, 0.6), (8, 0.7, 0.7), (8, 3.0, 3.0), (7, 0.5, 0.5), (7, 0.6, 0.6), (1, 0.5, 0.5), (1, 0.6, 0.6), (1, 0.7, 0.7)]
    p = spark.createDataFrame(pts, "owner_id long, lon double, lat double")
    assert [tuple(r) for r in o.swallowed(cells, p, 0.1).collect()] == [(1, 9, 3)]
