"""Geometry kernels against closed forms and brute force; no Spark needed."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpanel.functions.kernels import clip_ring, dissolve, rect_planes, ring_area, slab_area


def edges(*polygons, role=0):
    rows = []
    for i, ring in enumerate(polygons):
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            rows.append((i, role, xa, ya, xb, yb))
    return [np.array(c, dtype=float if k > 1 else int) for k, c in enumerate(zip(*rows))]


def rect(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


BOX = (0.0, 0.0, 10.0, 10.0)


def area(*polygons, box=BOX):
    return slab_area(*edges(*polygons), box)


def test_single_shapes():
    assert area(rect(1, 1, 3, 4)) == 6
    assert area(rect(0, 0, 10, 10)) == 100
    assert area(rect(-5, -5, 15, 15)) == 100
    assert area(rect(11, 0, 12, 5)) == 0
    assert abs(area([(0, 0), (10, 0), (0, 10)]) - 50) < 1e-9


def test_overlap_touch_and_copies_count_once():
    assert area(rect(0, 0, 2, 2), rect(1, 1, 3, 3)) == 7
    assert area(rect(0, 0, 2, 2), rect(2, 0, 4, 2)) == 8
    assert area(rect(0, 0, 2, 2), rect(2, 2, 4, 4)) == 8
    assert area(rect(0, 0, 2, 2), rect(0, 0, 2, 2)) == 4


def test_hole_by_parity_and_bowtie():
    poly, role, *c = edges(rect(0, 0, 6, 6), rect(1, 1, 5, 5))
    assert slab_area(np.zeros_like(poly), role, *c, BOX) == 20
    assert abs(area([(0, 0), (4, 4), (4, 0), (0, 4)]) - 8) < 1e-9


def test_mask_limits_area():
    a, b = edges(rect(0, 0, 6, 6)), edges(rect(3, 3, 9, 9), role=1)
    both = [np.concatenate(p) for p in zip(a, b)]
    both[0] = np.array([0] * 4 + [1] * 4)
    assert slab_area(*both, BOX) == 9


def test_clip_ring_keeps_exact_area():
    ring = np.array([(-2, 5), (5, -2), (12, 5), (5, 12)], dtype=float)
    x, y = clip_ring(ring[:, 0], ring[:, 1], rect_planes(*BOX))
    assert abs(abs(ring_area(x, y)) - area([tuple(p) for p in ring])) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=8))
def test_rectangle_union_equals_lattice_count(boxes):
    grid = np.zeros((10, 10), dtype=bool)
    for a, b, w, h in boxes:
        grid[b:b + h, a:a + w] = True
    assert abs(area(*[rect(a, b, a + w, b + h) for a, b, w, h in boxes]) - grid.sum()) < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=3, max_size=3, unique=True), min_size=1, max_size=5))
def test_triangle_union_matches_dissolve_and_bounds(triangles):
    shapes = [[(x / 4, y / 4) for x, y in t] for t in triangles]
    total = area(*shapes)
    poly, _, *c = edges(*shapes)
    parts = sum((t - b) * ((xr - xl) + (tr - tl)) / 2 for b, t, xl, xr, tl, tr in dissolve(poly, *c, BOX))
    assert abs(total - parts) < 1e-6
    single = [area(s) for s in shapes]
    assert max(single) - 1e-9 <= total <= sum(single) + 1e-9
