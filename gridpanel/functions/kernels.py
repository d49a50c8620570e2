"""Small NumPy kernels that Spark calls on bounded pieces of polygons.

``clip_ring`` cuts one ring by a half-plane sequence; ``slab_area`` measures the
dissolved area of all edges of one window. Partitioning, candidate search, window
splitting and every aggregation stay in Spark.
"""

from __future__ import annotations

import numpy as np


def clip_ring(xs: np.ndarray, ys: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clip an open ring by half-planes ``a*x + b*y + c >= 0``; the even-odd area stays exact."""
    for a, b, c in planes:
        if len(xs) == 0:
            break
        d = a * xs + b * ys + c
        keep = d >= 0
        if keep.all():
            continue
        nxt = np.roll(np.arange(len(xs)), -1)
        crossing = keep != keep[nxt]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = d / (d - d[nxt])
        # slot 2i holds vertex i, slot 2i+1 the crossing on edge i
        px = np.empty(2 * len(xs))
        py = np.empty(2 * len(xs))
        px[0::2], py[0::2] = xs, ys
        t = np.where(crossing, t, 0.0)
        px[1::2], py[1::2] = xs + t * (xs[nxt] - xs), ys + t * (ys[nxt] - ys)
        taken = np.empty(2 * len(xs), dtype=bool)
        taken[0::2], taken[1::2] = keep, crossing
        xs, ys = px[taken], py[taken]
    return xs, ys


def rect_planes(x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    return np.array([[1.0, 0.0, -x0], [-1.0, 0.0, x1], [0.0, 1.0, -y0], [0.0, -1.0, y1]])


def segments_meet_convex(first: np.ndarray, last: np.ndarray, planes: np.ndarray, hair: float = 1e-7) -> np.ndarray:
    """Which closed segments share a point with the closed set where all ``planes`` are at least zero."""
    low, high, out = np.zeros(len(first)), np.ones(len(first)), np.zeros(len(first), bool)
    for a, b, c in planes:
        da, db = first @ (a, b) + (c + hair), last @ (a, b) + (c + hair)
        out |= (da < 0) & (db < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = da / (da - db)
        low = np.where((da < 0) & (db >= 0), np.maximum(low, at), low)
        high = np.where((db < 0) & (da >= 0), np.minimum(high, at), high)
    return ~out & (low <= high)


def ring_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Signed shoelace area of an open ring, relative to its first point."""
    if len(xs) < 3:
        return 0.0
    u, v = xs - xs[0], ys - ys[0]
    return float(np.sum(u * np.roll(v, -1) - np.roll(u, -1) * v) / 2)


def _event_ordinates(xa, ya, xb, yb, x0, y0, x1, y1):
    """Ordinates where the left-to-right order of edges can change inside the window."""
    slope = (xb - xa) / (yb - ya)
    events = [np.array([y0, y1]), ya, yb]
    slanted = slope != 0
    if slanted.any():
        for bound in (x0, x1):
            with np.errstate(divide="ignore", invalid="ignore"):
                events.append((ya + (bound - xa) / slope)[slanted])
        # every pair with at least one slanted edge; two vertical edges never cross
        i = np.flatnonzero(slanted)
        with np.errstate(divide="ignore", invalid="ignore"):
            base = xa - slope * ya
            cross = (base[None, :] - base[i][:, None]) / (slope[i][:, None] - slope[None, :])
        low = np.maximum(ya[i][:, None], ya[None, :])
        high = np.minimum(yb[i][:, None], yb[None, :])
        events.append(cross[(cross > low) & (cross < high)])
    ys = np.concatenate(events)
    return np.unique(ys[(ys >= y0) & (ys <= y1)])


def slab_intervals(poly, role, xa, ya, xb, yb, window):
    """Even-odd x-intervals of every polygon at the middle of every slab.

    Returns slab ordinates and ``(slab, role, left edge, right edge)`` arrays, where
    the edges index the oriented edge arrays that are returned with them.
    """
    x0, y0, x1, y1 = window
    up = ya < yb
    xa, xb = np.where(up, xa, xb), np.where(up, xb, xa)
    ya, yb = np.where(up, ya, yb), np.where(up, yb, ya)
    use = (ya < yb) & (yb > y0) & (ya < y1)
    poly, role, xa, ya, xb, yb = (v[use] for v in (poly, role, xa, ya, xb, yb))
    edges = (xa, ya, xb, yb)
    if len(xa) == 0:
        empty = np.array([], dtype=int)
        return np.array([y0, y1]), empty, empty, empty, empty, edges
    ys = _event_ordinates(xa, ya, xb, yb, x0, y0, x1, y1)
    mid = (ys[:-1] + ys[1:]) / 2
    first, last = np.searchsorted(mid, ya), np.searchsorted(mid, yb)
    count = last - first
    edge = np.repeat(np.arange(len(xa)), count)
    slab = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    x = xa[edge] + (mid[slab] - ya[edge]) * (xb[edge] - xa[edge]) / (yb[edge] - ya[edge])
    order = np.lexsort((x, poly[edge], role[edge], slab))
    edge, slab = edge[order], slab[order]
    left, right = edge[0::2], edge[1::2]
    return ys, slab[0::2], role[left], left, right, edges


def _pair_crossings(win, xa, ya, xb, yb, count):
    """Ordinates where a slanted edge meets any other edge of its window."""
    slope = (xb - xa) / (yb - ya)
    base = xa - slope * ya
    start = np.cumsum(count) - count
    i = np.flatnonzero(slope != 0)
    n = count[win[i]]
    left = np.repeat(i, n)
    right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[win[i]], n)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (base[right] - base[left]) / (slope[left] - slope[right])
    ok = (y > np.maximum(ya[left], ya[right])) & (y < np.minimum(yb[left], yb[right]))
    return win[left][ok], y[ok]


def slab_areas(win, poly, role, xa, ya, xb, yb, boxes) -> np.ndarray:
    """Dissolved area of many windows at once.

    ``win`` numbers the window of each edge, ``boxes`` holds one ``(x0, y0, x1, y1)``
    row per window. The area is that of the union of role-0 polygons, limited to the
    union of role-1 polygons in windows that have any. Windows are cut into slabs at
    every ordinate where the order of edges can change; inside a slab the covered
    length is linear, so its value at mid-height times the height is exact.
    """
    areas = np.zeros(len(boxes))
    up = ya < yb
    xa, xb = np.where(up, xa, xb), np.where(up, xb, xa)
    ya, yb = np.where(up, ya, yb), np.where(up, yb, ya)
    box = boxes[win]
    use = np.flatnonzero((ya < yb) & (yb > box[:, 1]) & (ya < box[:, 3]))
    use = use[np.argsort(win[use], kind="stable")]
    win, poly, role, xa, ya, xb, yb = (v[use] for v in (win, poly, role, xa, ya, xb, yb))
    if len(win) == 0:
        return areas
    box = boxes[win]
    count = np.bincount(win, minlength=len(boxes))
    slope = (xb - xa) / (yb - ya)
    low, high = np.maximum(ya, box[:, 1]), np.minimum(yb, box[:, 3])
    ev_win, ev_y = [win, win], [low, high]
    slanted = slope != 0
    if slanted.any():
        for side in (0, 2):
            with np.errstate(divide="ignore", invalid="ignore"):
                y = ya + (box[:, side] - xa) / slope
            ok = slanted & (y > low) & (y < high)
            ev_win.append(win[ok])
            ev_y.append(y[ok])
        pairs = _pair_crossings(win, xa, ya, xb, yb, count)
        ok = (pairs[1] > boxes[pairs[0], 1]) & (pairs[1] < boxes[pairs[0], 3])
        ev_win.append(pairs[0][ok])
        ev_y.append(pairs[1][ok])
    ew, ey = np.concatenate(ev_win), np.concatenate(ev_y)
    order = np.lexsort((ey, ew))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (ew[order][1:] != ew[order][:-1]) | (ey[order][1:] != ey[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    ys = ey[order][fresh]
    slab_win = ew[order][fresh]
    height = np.append(np.diff(ys), 0.0)
    mid = ys + height / 2
    first, last = number[: len(win)], number[len(win): 2 * len(win)]
    n = last - first
    edge = np.repeat(np.arange(len(win)), n)
    slab = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    x = xa[edge] + (mid[slab] - ya[edge]) * slope[edge]
    order = np.lexsort((x, poly[edge], role[edge], slab))
    edge, slab, x = edge[order], slab[order], x[order]
    # consecutive crossings of one polygon enclose its even-odd spans
    kind = role[edge]
    x = np.clip(x, boxes[slab_win[slab], 0], boxes[slab_win[slab], 2])
    step = np.where(np.arange(len(x)) % 2 == 0, 1, -1)
    order = np.lexsort((x, slab))
    x, slab, step, kind = x[order], slab[order], step[order], kind[order]
    masked = np.zeros(len(boxes), dtype=bool)
    masked[win[role == 1]] = True
    inside = np.cumsum(np.where(kind == 0, step, 0)) > 0
    inside &= (np.cumsum(np.where(kind == 1, step, 0)) > 0) | ~masked[slab_win[slab]]
    width = np.append(np.diff(x), 0.0)
    width[:-1][slab[1:] != slab[:-1]] = 0.0
    return areas + np.bincount(slab_win[slab], weights=width * inside * height[slab], minlength=len(boxes))


def slab_area(poly, role, xa, ya, xb, yb, window) -> float:
    """One window; see ``slab_areas``."""
    win = np.zeros(len(poly), dtype=np.int64)
    return float(slab_areas(win, poly, role, xa, ya, xb, yb, np.array([window], dtype=float))[0])


def edge_chunks(win: np.ndarray, slanted: np.ndarray, windows: int, budget: int = 2_000_000):
    """Window ranges whose edge pairs stay within a memory budget."""
    pairs = np.bincount(win, minlength=windows) * np.maximum(np.bincount(win, weights=slanted, minlength=windows), 4)
    marks = np.floor(np.cumsum(pairs) / budget)
    cuts = np.flatnonzero(np.diff(marks) > 0) + 1
    return zip(np.r_[0, cuts], np.r_[cuts, windows])


def dissolve(poly, xa, ya, xb, yb, window):
    """Disjoint trapezoids ``(bottom, top, xl_bottom, xr_bottom, xl_top, xr_top)`` of an even-odd union."""
    role = np.zeros(len(xa), dtype=int)
    ys, slab, _, left, right, (ea, fa, eb, fb) = slab_intervals(poly, role, xa, ya, xb, yb, window)
    out = []

    def at(edge, y):
        x = ea[edge] + (y - fa[edge]) * (eb[edge] - ea[edge]) / (fb[edge] - fa[edge])
        return min(max(x, window[0]), window[2])

    for s in np.unique(slab):
        mid = (ys[s] + ys[s + 1]) / 2
        spans = sorted((at(a, mid), at(b, mid), a, b) for a, b in zip(left[slab == s], right[slab == s]))
        merged: list[list] = []
        for xl, xr, a, b in spans:
            if merged and xl <= merged[-1][1]:
                if xr > merged[-1][1]:
                    merged[-1][1], merged[-1][3] = xr, b
            elif xr > xl:
                merged.append([xl, xr, a, b])
        for xl, xr, a, b in merged:
            if xr > xl:
                out.append((ys[s], ys[s + 1], at(a, ys[s]), at(b, ys[s]), at(a, ys[s + 1]), at(b, ys[s + 1])))
    return out
