"""Polygon layers on a grid: tile joins, clips, dissolved areas and class shares.

Candidates come from equi-joins on integer tile or cell keys. Windows the polygon
edges never enter are settled by Column algebra; only cut windows reach a kernel.
A window with very many edges is split into smaller ones, and what they cut is clipped to
them, as long as that makes them smaller; batches of what stays crowded are dissolved. Since
areas of disjoint windows add up, no group ever has to fit one task, and a window above the bound is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.functions.geometry import (
    bbox,
    clipped_area,
    inside_even_odd,
    polygon_area,
    rect_ring,
    ring_edges,
)
from gridpanel.functions.kernels import clip_ring, dissolve, edge_chunks, rect_planes, ring_area, segments_meet_convex, slab_areas
from gridpanel.operators.prefix import row_index
from gridpanel.operators.skew import classes, packed, salted_join
from gridpanel.operators.sweep import Tiles, met_squares, polygon_edges
from gridpanel.session import broadcast_if_small, materialize, spread

BOX = ("xmin", "ymin", "xmax", "ymax")
#: A round that splits or merges must leave less than this share of the edges in crowded windows.
PROGRESS = 0.9
RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


def with_bbox(polys: DataFrame) -> DataFrame:
    box = bbox(F.col("rings"))
    return polys.withColumns({c: box[c] for c in BOX})


def read_bbox(layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose box meets the given box; four range predicates that reach the scan."""
    return layer.where(
        (F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)
    )


# ------------------------------------------------------------------ tile join


def tile_explode(df: DataFrame, size: float, closed: bool = True) -> DataFrame:
    """One row per tile ``(tx, ty)`` the box meets; ``closed=False`` leaves out edge contact above."""
    upper = (lambda c: F.floor(F.col(c) / size)) if closed else (lambda c: F.ceil(F.col(c) / size) - 1)
    low_x, low_y = F.floor(F.col("xmin") / size), F.floor(F.col("ymin") / size)
    return df.withColumn("tx", F.explode(F.sequence(low_x, F.greatest(low_x, upper("xmax"))))).withColumn(
        "ty", F.explode(F.sequence(low_y, F.greatest(low_y, upper("ymax"))))
    )


def _split_hot_tiles(sides: Sequence[DataFrame], size: float, per_tile: int) -> list[DataFrame]:
    """Give every row its final tile key; a tile above ``per_tile`` rows becomes a finer grid."""
    tiled = [tile_explode(side, size) for side in sides]
    counts = None
    for side in tiled:
        keys = side.select("tx", "ty")
        counts = keys if counts is None else counts.unionAll(keys)
    hot = materialize(
        counts.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_tile)
        .select("tx", "ty", F.least(F.lit(256), F.ceil(F.sqrt(F.col("_n") / per_tile)) * 2).cast("int").alias("_g"))
    )
    if hot.isEmpty():
        return [side.withColumns({"_g": F.lit(1), "sx": F.lit(0), "sy": F.lit(0)}) for side in tiled]
    hot = broadcast_if_small(hot)
    out = []
    for side in tiled:
        marked = side.join(hot, ["tx", "ty"], "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
        for sub, tile, low, high in (("sx", "tx", "xmin", "xmax"), ("sy", "ty", "ymin", "ymax")):
            step = size / F.col("_g")

            def slot(c: str) -> Column:
                inner = F.floor((F.col(c) - F.col(tile) * size) / step)
                return F.greatest(F.lit(0), F.least(F.col("_g") - 1, inner)).cast("int")

            marked = marked.withColumn(sub, F.explode(F.sequence(slot(low), slot(high))))
        out.append(marked)
    return out


def spatial_join(
    left: DataFrame, right: DataFrame, size: float, per_tile: int = 200_000, touching: bool = True, on: Sequence[str] = (),
) -> DataFrame:
    """Pairs whose boxes meet, each once; right columns get the prefix ``r_``.

    A pair is kept only in the tile that holds the lower-left corner of the box both
    share. ``touching=False`` asks for open overlap. Columns in ``on`` must be equal; they
    are join keys beside the tile, so rows that differ there never meet.

    Copies of one box meet as one row and are only taken apart in the result, so what is shuffled grows with
    the sides, not with the pairs.
    """
    left = left.withColumn("_", F.lit(0))
    # null keys in ``on`` never meet
    renamed = right.select(*[F.col(c) if c in BOX else F.col(c).alias(f"r_{c}") for c in right.columns], *on)
    a, b = (packed(side.dropna(subset=[*BOX, *on]), [*BOX, *on], rows) for side, rows in ((left, "_left"), (renamed, "_right")))
    a, b = _split_hot_tiles([materialize(a), materialize(b)], size, per_tile)
    b = b.select(*[F.col(c).alias(f"r_{c}") if c in BOX else F.col(c) for c in b.columns])
    # the sides are small beside the pairs: the number of tasks is told, or Spark would merge them by the size of the sides
    keys = ["tx", "ty", "_g", "sx", "sy", *on]
    pairs = salted_join(spread(a, *keys), spread(b, *keys), keys)
    cx, cy = F.greatest("xmin", "r_xmin"), F.greatest("ymin", "r_ymin")
    if touching:
        meets = (cx <= F.least("xmax", "r_xmax")) & (cy <= F.least("ymax", "r_ymax"))
    else:
        meets = (cx < F.least("xmax", "r_xmax")) & (cy < F.least("ymax", "r_ymax"))
    step = size / F.col("_g")

    def here(corner: Column, tile: str, sub: str) -> Column:
        inner = F.floor((corner - F.col(tile) * size) / step)
        owner = F.greatest(F.lit(0), F.least(F.col("_g") - 1, inner))
        return (F.floor(corner / size) == F.col(tile)) & (owner == F.col(sub))

    kept = pairs.where(meets & here(cx, "tx", "sx") & here(cy, "ty", "sy"))
    apart = kept.withColumn("_left", F.explode("_left")).withColumn("_right", F.explode("_right"))
    boxes = [*BOX, *[f"r_{c}" for c in BOX]]
    return apart.select(
        *[c if c in (*BOX, *on) else F.col(f"_left.{c}").alias(c) for c in left.columns if c != "_"],
        *[c if c in boxes else F.col(f"_right.{c}").alias(c) for c in (f"r_{c}" for c in right.columns)],
    )


# -------------------------------------------------------------- clip kernels


def _flat(polys: DataFrame) -> DataFrame:
    """Rings as three flat arrays, the cheapest form to hand to NumPy."""
    opened = F.transform("rings", lambda r: F.slice(r, F.lit(1), F.size(r) - 1))
    points = F.flatten(opened)
    return polys.withColumns(
        {
            "xs": F.transform(points, lambda p: p["x"]),
            "ys": F.transform(points, lambda p: p["y"]),
            "lens": F.transform(opened, lambda r: F.size(r)),
        }
    ).drop("rings")


def _unflat(df: DataFrame) -> DataFrame:
    """Flat arrays back to closed rings."""
    ends = F.transform("lens", lambda n, i: F.aggregate(F.slice("lens", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    points = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    ring = F.zip_with(ends, F.col("lens"), lambda e, n: F.slice(points, e - n + 1, n))
    closed = F.transform(ring, lambda r: F.concat(r, F.slice(r, F.lit(1), F.lit(1))))
    return df.withColumn("rings", closed.cast(RINGS_TYPE)).drop("xs", "ys", "lens")


def clip_to_rect(polys: DataFrame, window: Sequence[str] = ("wx0", "wy0", "wx1", "wy1")) -> DataFrame:
    """Rings cut to the rectangle each row carries; rows that become empty are dropped."""
    flat = _flat(polys)
    w0, w1, w2, w3 = window

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs_out, ys_out, lens_out = [], [], []
            for xs, ys, lens, a, b, c, d in zip(
                batch["xs"], batch["ys"], batch["lens"], batch[w0], batch[w1], batch[w2], batch[w3]
            ):
                planes, parts = rect_planes(a, b, c, d), []
                start = 0
                for n in lens:
                    parts.append(clip_ring(np.asarray(xs[start:start + n]), np.asarray(ys[start:start + n]), planes))
                    start += n
                parts = [p for p in parts if len(p[0]) > 2]
                xs_out.append(np.concatenate([p[0] for p in parts]) if parts else np.array([]))
                ys_out.append(np.concatenate([p[1] for p in parts]) if parts else np.array([]))
                lens_out.append([len(p[0]) for p in parts])
            batch["xs"], batch["ys"], batch["lens"] = xs_out, ys_out, lens_out
            yield batch[batch["lens"].map(len) > 0]

    return _unflat(flat.mapInPandas(cut, flat.schema))


def cell_windows(polys: DataFrame, size: float) -> DataFrame:
    """One row per grid square ``(ix, iy)`` a polygon's box meets, with that square as window."""
    boxed = spread(polys)
    boxed = boxed if "xmin" in polys.columns else with_bbox(boxed)
    squares = tile_explode(boxed, size, closed=False).withColumnsRenamed({"tx": "ix", "ty": "iy"})
    return squares.withColumns(
        {
            "ix": F.col("ix").cast("int"), "iy": F.col("iy").cast("int"),
            "wx0": F.col("ix") * float(size), "wy0": F.col("iy") * float(size),
            "wx1": (F.col("ix") + 1) * float(size), "wy1": (F.col("iy") + 1) * float(size),
        }
    ).drop(*BOX)


def split_large(polys: DataFrame, size: float, vertices: int = 256, factor: int = 16) -> DataFrame:
    """Cut polygons with many vertices into coarse tiles first, so squares only see nearby edges."""
    n = F.aggregate("rings", F.lit(0), lambda acc, r: acc + F.size(r))
    small, large = polys.where(n <= vertices), polys.where(n > vertices)
    if large.select(F.lit(1)).isEmpty():
        return polys
    pieces = clip_to_rect(cell_windows(large, size * factor)).select(*polys.columns)
    return small.unionByName(pieces)


def _classify(windows: DataFrame) -> DataFrame:
    """``state``: 1 the polygon covers the window, 0 it is cut by an edge; rows outside are dropped."""
    edges = F.flatten(F.transform("rings", ring_edges))

    def enters(e: Column) -> Column:
        return (
            (F.greatest(e["xa"], e["xb"]) > F.col("wx0")) & (F.least(e["xa"], e["xb"]) < F.col("wx1"))
            & (F.greatest(e["ya"], e["yb"]) > F.col("wy0")) & (F.least(e["ya"], e["yb"]) < F.col("wy1"))
        )

    centre = inside_even_odd((F.col("wx0") + F.col("wx1")) / 2, (F.col("wy0") + F.col("wy1")) / 2, F.col("rings"))
    return windows.withColumn(
        "state", F.when(F.exists(edges, enters), 0).when(centre, 1).otherwise(-1)
    ).where(F.col("state") >= 0)


def clip_to_cells(polys: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Area each polygon has inside each grid square it overlaps: ``(keys, ix, iy, area)``; copies are cut once."""
    shapes, rows = classes(polys.select(*keys, "rings"), ["rings"], "_shape")
    areas = _clip_shapes(shapes, ["_shape"], size)
    met = salted_join(rows, areas, ["_shape"]).drop("_shape")
    # several rows of one key add up
    return met.groupBy(*keys, "ix", "iy").agg(F.sum("area").alias("area"))


def _clip_shapes(polys: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    classified = _classify(cell_windows(split_large(polys, size), size))
    window = [F.col(c) for c in ("wx0", "wy0", "wx1", "wy1")]
    inside = F.when(F.col("state") == 1, float(size) * float(size)).otherwise(clipped_area(F.col("rings"), *window))
    areas = classified.select(*keys, "ix", "iy", inside.alias("area"))
    return areas.groupBy(*keys, "ix", "iy").agg(F.sum("area").alias("area")).where("area > 0")


def _window_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop what a covering polygon of the same role makes redundant, and exact repeats."""
    group = [*keys, "role", "wx0", "wy0", "wx1", "wy1"]
    covered = pieces.where("state = 1").select(*group).distinct()
    ring = F.array(rect_ring("wx0", "wy0", "wx1", "wy1"))
    blocks = covered.withColumns({"rings": ring, "state": F.lit(1)})
    cut = pieces.where("state = 0").join(covered, group, "left_anti")
    return cut.select(*group, "rings", "state").unionByName(blocks.select(*group, "rings", "state"))


def _quarters(pieces: DataFrame, parts: Column) -> DataFrame:
    """Split each window into ``parts`` × ``parts`` windows and classify again."""
    steps = F.sequence(F.lit(0), parts - 1)
    w = (F.col("wx1") - F.col("wx0")) / parts
    h = (F.col("wy1") - F.col("wy0")) / parts
    split = pieces.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    split = split.select(
        *[c for c in pieces.columns if c not in ("wx0", "wy0", "wx1", "wy1", "state")],
        (F.col("wx0") + F.col("_i") * w).alias("wx0"), (F.col("wy0") + F.col("_j") * h).alias("wy0"),
        (F.col("wx0") + (F.col("_i") + 1) * w).alias("wx1"), (F.col("wy0") + (F.col("_j") + 1) * h).alias("wy1"),
    )
    return _classify(split)


def _merge_batches(edges: DataFrame, group: Sequence[str], max_edges: int) -> DataFrame:
    """Replace the edges of a crowded window by those of its dissolved batches."""
    sized = edges.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = salted_join(edges, sized.where(F.col("_n") > max_edges), list(group), key_counts=sized)
    cool = edges.join(sized.where(F.col("_n") > max_edges).select(*group), list(group), "left_anti")
    hot = hot.withColumn("_batch", F.pmod(F.xxhash64("poly"), F.ceil(F.col("_n") / (max_edges / 2))))
    schema = edges.schema

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        window = tuple(float(head[c]) for c in ("wx0", "wy0", "wx1", "wy1"))
        codes = pd.factorize(pdf["poly"])[0]
        traps = dissolve(codes, *(pdf[c].to_numpy() for c in ("xa", "ya", "xb", "yb")), window)
        rows = []
        for i, (y0, y1, a0, b0, a1, b1) in enumerate(traps):
            token = (int(head["_batch"]) << 32) + i
            rows += [(token, a0, y0, a1, y1), (token, b0, y0, b1, y1)]
        out = pd.DataFrame(rows, columns=["poly", "xa", "ya", "xb", "yb"])
        for c in group:
            out[c] = head[c]
        return out[[f.name for f in schema.fields]]

    merged = hot.groupBy(*group, "_batch").applyInPandas(merge, schema)
    return cool.unionByName(merged)


def window_areas(
    layer: DataFrame, keys: Sequence[str], size: float, *, mask: DataFrame | None = None,
    shapes: Mapping[str, Sequence[tuple[float, float]]] | None = None, max_edges: int = 4000,
) -> DataFrame:
    """Dissolved area per ``(keys, ix, iy)`` of all polygons of ``layer`` in that square.

    ``mask`` (same ``rings`` form, no keys) limits the area to its own union. ``shapes``
    are fixed polygons in units of metres relative to the square's lower-left corner;
    each adds one column with the dissolved area inside it.
    """
    shapes = dict(shapes or {})
    group = [*keys, "ix", "iy"]
    # copies of a polygon cover the same area, so each is cut once
    pieces = _classify(cell_windows(split_large(materialize(layer.select(*keys, "rings").distinct()), size), size)).withColumn("role", F.lit(0))
    pieces = _window_pieces(pieces, group)
    if mask is not None:
        cut_mask = _classify(cell_windows(split_large(mask.select("rings").distinct(), size), size)).withColumn("role", F.lit(1))
        cut_mask = _window_pieces(cut_mask, ["ix", "iy"])
        wanted = pieces.select(*group).distinct()
        masks = salted_join(wanted, cut_mask, ["ix", "iy"])
        # squares the mask does not touch have no area at all
        pieces = pieces.join(masks.select(*group).distinct(), group, "left_semi").unionByName(
            masks.select(*pieces.columns)
        )
    window = ["wx0", "wy0", "wx1", "wy1"]
    # split crowded windows; edge counts are known before any edge is shipped
    n_edges = F.aggregate("rings", F.lit(0), lambda acc, r: acc + F.size(r) - 1)
    pieces = materialize(pieces)
    worst = math.inf
    while True:
        crowded = (
            pieces.groupBy(*group, *window).agg(F.sum(n_edges).alias("_n")).where(F.col("_n") > max_edges)
            .select(*group, *window, "_n", F.least(F.lit(16), F.ceil(F.sqrt(F.col("_n") / max_edges)) * 2).cast("int").alias("_parts"))
        )
        crowded = materialize(crowded)
        load = crowded.agg(F.sum("_n")).first()[0]
        if load is None or load > PROGRESS * worst:
            break
        worst = load
        quiet = pieces.join(crowded.select(*group, *window), [*group, *window], "left_anti")
        split = _quarters(pieces.join(crowded.drop("_n"), [*group, *window]), F.col("_parts")).drop("_parts")
        # what is cut by a window keeps only the edges inside it, so the count of a part is its own
        split = materialize(split)
        cut = clip_to_rect(split.where("state = 0")).select(*split.columns)
        pieces = materialize(quiet.unionByName(_window_pieces(cut.unionByName(split.where("state = 1")), group)))
    # without a mask or shapes a covered window needs no kernel
    area = (F.col("wx1") - F.col("wx0")) * (F.col("wy1") - F.col("wy0"))
    plain = None
    if mask is None and not shapes:
        plain = pieces.where("state = 1").select(*group, area.alias("area"))
        pieces = pieces.where("state = 0")
    e = F.col("_e")
    edges = (
        pieces.withColumn("poly", F.xxhash64("role", "rings"))
        .dropDuplicates([*group, *window, "role", "poly"])
        .withColumn("_e", F.explode(F.flatten(F.transform("rings", ring_edges))))
        .where((F.greatest(e["ya"], e["yb"]) > F.col("wy0")) & (F.least(e["ya"], e["yb"]) < F.col("wy1")))
        .where(e["ya"] != e["yb"])
        .select(*group, *window, "role", "poly", e["xa"].alias("xa"), e["ya"].alias("ya"), e["xb"].alias("xb"), e["yb"].alias("yb"))
    )
    side = [*group, *window, "role"]
    worst = math.inf
    while True:
        counts = edges.groupBy(*side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * max_edges)
        load = counts.agg(F.sum("n")).first()[0]
        if load is None:
            break
        if load > PROGRESS * worst:
            raise ValueError(f"{load} edges share windows that neither splitting nor merging makes smaller; raise max_edges above {max_edges}")
        worst = load
        edges = materialize(_merge_batches(edges, side, 4 * max_edges))
    names = ["area", *shapes]
    outlines = {n: _shape_edges(points) for n, points in shapes.items()}
    fields = [edges.schema[c] for c in group] + [T.StructField(n, T.DoubleType()) for n in names]

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf.groupby([*group, *window], sort=False)
        win = heads.ngroup().to_numpy()
        firsts = np.unique(win, return_index=True)[1]
        order = np.argsort(win, kind="stable")
        pdf, win = pdf.iloc[order], win[order]
        head = heads.head(1)
        boxes = head[window].to_numpy(dtype=float)
        poly = pd.factorize(pdf["poly"])[0]
        role = pdf["role"].to_numpy()
        coords = [pdf[c].to_numpy(dtype=float) for c in ("xa", "ya", "xb", "yb")]
        out = head[group].copy()
        out["area"] = _chunked_areas(win, poly, role, coords, boxes)
        for name, outline in outlines.items():
            corner = np.column_stack([head["ix"], head["iy"]]) * float(size)
            shape = outline[None, :, :] + np.hstack([corner, corner])[:, None, :]
            n = len(outline)
            both = [np.concatenate([v, shape[:, :, i].ravel()]) for i, v in enumerate(coords)]
            wins = np.concatenate([win, np.repeat(np.arange(len(firsts)), n)])
            ids = np.concatenate([poly, np.full(len(wins) - len(win), poly.max() + 1)])
            roles = np.concatenate([role, np.ones(len(wins) - len(win), dtype=role.dtype)])
            out[name] = _chunked_areas(wins, ids, roles, both, boxes)
        return out

    # many windows share one kernel call; a bucket holds a bounded number of bounded windows
    total = pieces.agg(F.sum(n_edges)).first()[0] or 0
    spark = edges.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, total // 200_000)
    bucketed = edges.withColumn("_bucket", F.pmod(F.xxhash64(*group, *window), F.lit(buckets)).cast("int"))
    measured = bucketed.repartition(buckets, "_bucket").groupBy("_bucket").applyInPandas(measure, T.StructType(fields))
    if plain is not None:
        measured = measured.unionByName(plain)
    return measured.groupBy(*group).agg(*[F.sum(n).alias(n) for n in names])


def _chunked_areas(win, poly, role, coords, boxes) -> np.ndarray:
    """``slab_areas`` in window ranges that bound the memory for edge pairs."""
    order = np.argsort(win, kind="stable")
    win, poly, role = win[order], poly[order], role[order]
    xa, ya, xb, yb = (v[order] for v in coords)
    out = np.zeros(len(boxes))
    for lo, hi in edge_chunks(win, xa != xb, len(boxes)):
        part = slice(np.searchsorted(win, lo), np.searchsorted(win, hi))
        out[lo:hi] = slab_areas(win[part] - lo, poly[part], role[part], xa[part], ya[part], xb[part], yb[part], boxes[lo:hi])
    return out


def _shape_edges(points: Sequence[tuple[float, float]]) -> np.ndarray:
    closed = np.asarray([*points, points[0]], dtype=float)
    return np.hstack([closed[:-1], closed[1:]])


# ----------------------------------------------------- neighbourhood context


def context_outline(size: float, distance: float, segments: int = 16) -> list[tuple[float, float]]:
    """Outward buffer of a square whose lower-left corner is the origin, arcs in fixed segments."""
    corners = [(size, size, 0.0), (0.0, size, 90.0), (0.0, 0.0, 180.0), (size, 0.0, 270.0)]
    outline = []
    for cx, cy, start in corners:
        for i in range(segments + 1):
            angle = math.radians(start + 90.0 * i / segments)
            outline.append((cx + distance * math.cos(angle), cy + distance * math.sin(angle)))
    return outline


def context_offsets(size: float, distance: float, segments: int = 16) -> tuple[list, dict[str, list]]:
    """Offsets of squares wholly in the context and, for the others, the context seen from them.

    A square at offset ``(dx, dy)`` of a cell sees that cell's context shifted by
    ``(-dx, -dy)``; both lists depend on ``size`` and ``distance`` only.
    """
    outline = context_outline(size, distance, segments)
    planes = []
    for (xa, ya), (xb, yb) in zip(outline, outline[1:] + outline[:1]):
        planes.append((-(yb - ya), xb - xa, (yb - ya) * xa - (xb - xa) * ya))
    planes = np.array(planes)
    reach = math.ceil(distance / size)
    whole, partial = [], {}
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            square = np.array([(dx, dy), (dx + 1, dy), (dx + 1, dy + 1), (dx, dy + 1)], dtype=float) * size
            cut = clip_ring(square[:, 0], square[:, 1], planes)
            inside = abs(ring_area(*cut))
            if inside >= size * size * (1 - 1e-12):
                whole.append((dx, dy))
            elif inside > 1e-9 * size * size:
                partial[f"s_{dx + reach}_{dy + reach}"] = (dx, dy, [(x - dx * size, y - dy * size) for x, y in zip(*cut)])
    return whole, partial


def context_planes(size: float, distance: float, dx: int, dy: int, segments: int = 16) -> list[tuple[float, float, float]]:
    """Half-planes ``a*x + b*y + c >= 0`` that cut the square at an offset, in that square's own metres."""
    outline = context_outline(size, distance, segments)
    kept = []
    for (xa, ya), (xb, yb) in zip(outline, outline[1:] + outline[:1]):
        a, b = -(yb - ya), xb - xa
        c = (yb - ya) * (xa - dx * size) - (xb - xa) * (ya - dy * size)
        if min(a * x + b * y + c for x in (0.0, size) for y in (0.0, size)) < 0:
            kept.append((a, b, c))
    return kept


def context_areas(
    layer: DataFrame, keys: Sequence[str], size: float, distance: float, mask: DataFrame | None = None
) -> DataFrame:
    """Dissolved area of ``layer`` inside every cell's outward buffer: ``(keys, ix, iy, area)``.

    Each square is dissolved once (whole and under the few partial outlines) and its
    areas are then sent to the cells whose context holds it, instead of dissolving
    every context again.
    """
    whole, partial = context_offsets(size, distance)
    measured = window_areas(layer, keys, size, mask=mask, shapes={n: p[2] for n, p in partial.items()})
    parts = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.col("area").alias("a")) for dx, dy in whole]
    parts += [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.col(n).alias("a")) for n, (dx, dy, _) in partial.items()]
    sent = measured.withColumn("_p", F.explode(F.array(*parts)))
    return (
        sent.select(
            *keys, (F.col("ix") - F.col("_p.dx")).alias("ix"), (F.col("iy") - F.col("_p.dy")).alias("iy"),
            F.col("_p.a").alias("area"),
        )
        .groupBy(*keys, "ix", "iy").agg(F.sum("area").alias("area")).where("area > 0")
    )


def intersects_within(
    layer: DataFrame, keys: Sequence[str], cells: DataFrame, size: float, distance: float, mask: DataFrame | None = None
) -> DataFrame:
    """Cells whose outward buffer meets any polygon, if only in a point: ``(cell_id, keys)``.

    No area is measured: a square that a polygon touches or covers makes a hit for every
    cell whose buffer holds the square; where the buffer's rim cuts the square, the edges in it are tested against
    the part inside. With a ``mask`` a hit must share area with the polygons inside the mask.
    """
    named = cells.select("cell_id", "ix", "iy")
    if mask is not None:
        shared = context_areas(layer, keys, size, distance, mask)
        return shared.select(*keys, "ix", "iy").join(named, ["ix", "iy"]).select("cell_id", *keys)
    edges = polygon_edges(layer.select(*keys, "rings").distinct(), keys)
    touched, inner = met_squares(edges, size)
    touched = materialize(touched.select(*keys, "pid", "tx", "ty", "xa", "ya", "xb", "yb"))
    covered = inner.join(edges.select("pid", *keys).distinct(), "pid").select(*keys, "tx", "ty")
    whole, partial = context_offsets(size, distance)

    def sent(squares: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
        to = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
        rows = squares.select(*keys, "tx", "ty").distinct().withColumn("_o", F.explode(to))
        return rows.select(*keys, (F.col("tx") - F.col("_o.dx")).alias("ix"), (F.col("ty") - F.col("_o.dy")).alias("iy"))

    met = sent(touched.select(*keys, "tx", "ty").unionByName(covered), whole).unionByName(sent(covered, [p[:2] for p in partial.values()]))
    rims = []
    for dx, dy, outline in partial.values():
        sides = [(-(yb - ya), xb - xa, (yb - ya) * xa - (xb - xa) * ya) for (xa, ya), (xb, yb) in zip(outline, [*outline[1:], outline[0]])]
        rims.append((dx, dy, np.array([(a / n, b / n, c / n) for a, b, c in sides if (n := math.hypot(a, b)) > 1e-9])))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            corner = batch[["tx", "ty"]].to_numpy() * float(size)
            first, last = batch[["xa", "ya"]].to_numpy() - corner, batch[["xb", "yb"]].to_numpy() - corner
            for dx, dy, planes in rims:
                hit = batch.loc[segments_meet_convex(first, last, planes), [*keys, "tx", "ty"]]
                if len(hit):
                    yield hit.assign(ix=hit["tx"] - dx, iy=hit["ty"] - dy)[[*keys, "ix", "iy"]]

    schema = T.StructType([*[touched.schema[k] for k in keys], T.StructField("ix", T.LongType()), T.StructField("iy", T.LongType())])
    met = met.unionByName(touched.mapInPandas(reach, schema))
    return met.distinct().join(named, ["ix", "iy"]).select("cell_id", *keys)


# ------------------------------------------------------------ shares and gaps


def burn_share(
    layer: DataFrame, cells: DataFrame, years: Sequence[int], size: float,
    land: DataFrame | None = None, mask: DataFrame | None = None,
) -> DataFrame:
    """Dissolved share of each cell's land per year; a year without polygons gives zero.

    ``land(ix, iy, land_area)`` is the denominator where a cell is not whole land.
    """
    area = window_areas(layer, ["year"], size, mask=mask)
    years_column = F.array(*[F.lit(int(y)) for y in years])
    rows = cells.select("cell_id", "ix", "iy").withColumn("year", F.explode(years_column))
    if land is not None:
        rows = rows.join(land, ["ix", "iy"])
    else:
        rows = rows.withColumn("land_area", F.lit(float(size) * float(size)))
    joined = rows.join(area, ["ix", "iy", "year"], "left")
    ratio = F.coalesce(F.col("area"), F.lit(0.0)) / F.col("land_area")
    return joined.select("cell_id", "year", F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)).alias("share"))


def class_share(
    layer: DataFrame, cells: DataFrame, groups: Mapping[str, Sequence[str]], size: float, distance: float | None = None,
    land: DataFrame | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Share of each cell (or of its context when ``distance`` is given) per class group."""
    from gridpanel.functions.scalars import code_group

    tagged = layer.withColumn("group", code_group(F.col("code"), groups)).where(F.col("group").isNotNull())
    by = [*keys, "group"]
    if distance is None:
        area = window_areas(tagged, by, size)
        whole = float(size) * float(size)
    else:
        area = context_areas(tagged, by, size, distance)
        outline = np.array(context_outline(size, distance))
        whole = abs(ring_area(outline[:, 0], outline[:, 1]))
    wide = area.groupBy(*keys, "ix", "iy").pivot("group", list(groups)).agg(F.sum("area"))
    rows = cells.select("cell_id", "ix", "iy")
    rows = rows.join(land, ["ix", "iy"]) if land is not None else rows.withColumn("land_area", F.lit(whole))
    joined = rows.join(wide, ["ix", "iy"], "left")
    share = lambda g: F.least(F.coalesce(F.col(g), F.lit(0.0)) / F.col("land_area"), F.lit(1.0))
    return joined.select("cell_id", *keys, *[share(g).alias(f"{g}_share") for g in groups])


def coverage_gap(layer: DataFrame, boundary: DataFrame, size: float) -> DataFrame:
    """One row: boundary area, layer area, area both share and the two gap shares."""
    def total(df: DataFrame, name: str, mask: DataFrame | None = None) -> DataFrame:
        return window_areas(df, [], size, mask=mask).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias(name))

    inside = total(boundary, "boundary_area")
    covered = total(layer, "layer_area").scalar()
    both = total(layer, "both", boundary).scalar()
    return inside.select(
        "boundary_area", covered.alias("layer_area"), both.alias("covered_area"),
        (1 - both / F.col("boundary_area")).alias("uncovered_share"),
        F.when(covered > 0, 1 - both / covered).otherwise(0.0).alias("outside_share"),
    )


def convex_parts(boundary: DataFrame, size: float) -> DataFrame:
    """Boundary cut into disjoint convex parts per square: ``(ix, iy, qx[4], qy[4])``."""
    squares = _classify(cell_windows(split_large(boundary.select("rings"), size), size))
    whole = squares.where("state = 1").select(
        "ix", "iy", F.array("wx0", "wx1", "wx1", "wx0").alias("qx"), F.array("wy0", "wy0", "wy1", "wy1").alias("qy")
    ).distinct()
    cut = _flat(squares.where("state = 0").select("ix", "iy", "wx0", "wy0", "wx1", "wy1", "rings"))

    def trapezoids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec in batch.to_dict("records"):
                e = _ring_edges(rec["xs"], rec["ys"], rec["lens"])
                box = tuple(rec[c] for c in ("wx0", "wy0", "wx1", "wy1"))
                rows += [
                    (rec["ix"], rec["iy"], *_trapezoid(t)[:2]) for t in dissolve(np.zeros(len(e), dtype=int), *e.T, box)
                ]
            yield pd.DataFrame(rows, columns=["ix", "iy", "qx", "qy"])

    return whole.unionByName(cut.mapInPandas(trapezoids, "ix int, iy int, qx array<double>, qy array<double>"))


def mask_polygons(layer: DataFrame, boundary: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Pieces of each polygon inside the boundary: ``(keys, ix, iy, rings)``.

    The boundary (non-overlapping parts) is cut once into convex parts per square;
    every polygon piece is then clipped by the parts of its own squares; copies of a polygon are clipped once.
    """
    parts = convex_parts(boundary, size)
    shapes, rows = classes(layer.select(*keys, "rings"), ["rings"], "_shape")
    pieces = _classify(cell_windows(split_large(shapes, size), size)).drop("state", "wx0", "wy0", "wx1", "wy1")
    pairs = spread(_flat(salted_join(pieces, parts, ["ix", "iy"])))
    out = T.StructType([f for f in pairs.schema.fields if f.name not in ("qx", "qy")])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs_out, ys_out, lens_out = [], [], []
            for xs, ys, lens, qx, qy in zip(batch["xs"], batch["ys"], batch["lens"], batch["qx"], batch["qy"]):
                ux, uy = np.roll(qx, -1) - qx, np.roll(qy, -1) - qy
                planes, kept, start = np.column_stack([-uy, ux, uy * qx - ux * qy]), [], 0
                for n in lens:
                    kept.append(clip_ring(np.asarray(xs[start:start + n]), np.asarray(ys[start:start + n]), planes))
                    start += n
                kept = [r for r in kept if len(r[0]) > 2]
                xs_out.append(np.concatenate([r[0] for r in kept]) if kept else np.array([]))
                ys_out.append(np.concatenate([r[1] for r in kept]) if kept else np.array([]))
                lens_out.append([len(r[0]) for r in kept])
            result = batch.drop(columns=["qx", "qy"])
            result["xs"], result["ys"], result["lens"] = xs_out, ys_out, lens_out
            yield result[result["lens"].map(len) > 0]

    cut_shapes = _unflat(pairs.mapInPandas(cut, out)).select("_shape", "ix", "iy", "rings")
    return salted_join(rows, materialize(cut_shapes), ["_shape"]).select(*keys, "ix", "iy", "rings")


def _ring_edges(xs, ys, lens) -> np.ndarray:
    """Edge rows of open rings held as flat arrays."""
    out, start = [], 0
    for n in lens:
        x, y = np.asarray(xs[start:start + n]), np.asarray(ys[start:start + n])
        out.append(np.column_stack([x, y, np.roll(x, -1), np.roll(y, -1)]))
        start += n
    return np.concatenate(out) if out else np.empty((0, 4))


def _trapezoid(t) -> list:
    y0, y1, a0, b0, a1, b1 = t
    return [[a0, b0, b1, a1], [y0, y0, y1, y1], [4]]


# ------------------------------------------------------------------- repair


def repair_polygons(polys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clean rings, resolve self-crossing by even-odd fill and log what happened.

    Adds ``status`` (accepted / repaired / rejected), ``invalid``, ``raw_area`` and
    ``area_after``, the areas of the whole polygon before and after, and ``part``. A
    self-crossing polygon comes back as one row per part, each a plain outer ring that
    every reader of polygons takes; all others are the single part 0. Rings lose repeated
    points and nulls, are closed and oriented; polygons left without area keep their log
    line with null rings. Copies of a polygon are repaired once.
    """
    shapes, rows = classes(polys.withColumn("rings", F.coalesce("rings", F.array()).cast(RINGS_TYPE)), ["rings"], "_shape")
    told = salted_join(rows, materialize(_repair_shapes(shapes)), ["_shape"])
    return told.select(*polys.columns, "raw_area", "area_after", "invalid", "part", "status")


def _repair_shapes(polys: DataFrame) -> DataFrame:
    clean_ring = lambda r: F.filter(
        r, lambda p, i: p.isNotNull() & ((i == 0) | ~p.eqNullSafe(F.element_at(r, i)))
    )
    closed = lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, F.lit(1), F.lit(1))))
    usable = lambda r: F.size(F.array_distinct(r)) >= 3
    rings = F.transform(F.filter(F.transform(F.coalesce("rings", F.array().cast(RINGS_TYPE)), clean_ring), usable), closed)
    cleaned = polys.withColumn("raw_area", F.coalesce(F.when(F.size("rings") > 0, polygon_area(F.col("rings"))), F.lit(0.0)))
    cleaned = materialize(cleaned.withColumn("rings", rings).withColumn("_poly", F.monotonically_increasing_id()))
    crossed = broadcast_if_small(materialize(self_crossing(cleaned, "_poly")))
    sound, crossing = cleaned.join(crossed, "_poly", "left_anti"), cleaned.join(crossed, "_poly", "left_semi")
    flat = spread(_flat(sound))
    schema = T.StructType([*flat.schema.fields, T.StructField("area_after", T.DoubleType())])

    def orient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [_oriented(np.asarray(x, dtype=float), np.asarray(y, dtype=float), n) for x, y, n in zip(batch["xs"], batch["ys"], batch["lens"])]
            yield batch.assign(xs=[t[0] for t in told], ys=[t[1] for t in told], area_after=[t[2] for t in told])

    plain = _unflat(flat.mapInPandas(orient, schema)).withColumns({"invalid": F.lit(False), "part": F.lit(0)})
    fixed = plain.unionByName(_filled_even_odd(crossing, "_poly")).drop("_poly")
    status = F.when(F.col("area_after") <= 0, "rejected").when(F.col("invalid"), "repaired").otherwise("accepted")
    return fixed.withColumn("status", status).withColumn("rings", F.when(F.col("status") != "rejected", F.col("rings")))


#: Edges of a polygon per window in which its self-crossings are resolved.
REPAIR_EDGES = 1000


def self_crossing(polys: DataFrame, pid: str) -> DataFrame:
    """``pid`` of the polygons two of whose edges cross properly.

    Every polygon gets a grid of its own, about a square per edge, and only edges that enter the same square are
    compared, so nothing grows with the square of a polygon's edges unless they crowd in one place.
    """
    edges = polys.select(F.col(pid).alias("pid"), F.explode(F.flatten(F.transform("rings", ring_edges))).alias("_e"))
    edges = materialize(edges.select("pid", F.monotonically_increasing_id().alias("eid"), *[F.col(f"_e.{c}").alias(c) for c in ("xa", "ya", "xb", "yb")]))
    box = edges.groupBy("pid").agg(
        F.min("xa").alias("x0"), F.min("ya").alias("y0"), (F.greatest(F.max("xa") - F.min("xa"), F.max("ya") - F.min("ya")) / F.ceil(F.sqrt(F.count(F.lit(1))))).alias("step"))
    placed = edges.join(box.where("step > 0"), "pid")
    moved = {c: (F.col(c) - F.col(f"{c[0]}0")) / F.col("step") for c in ("xa", "ya", "xb", "yb")}
    near = Tiles(1.0, shift=0.0).entered(placed.select("pid", "eid", *[v.alias(n) for n, v in moved.items()]), F.lit(0))
    # exact coordinates decide; the grid only brings edges together
    near = near.select("pid", "tx", "ty", "eid").join(edges, ["pid", "eid"])
    other = near.select("pid", "tx", "ty", *[F.col(c).alias(f"o_{c}") for c in ("eid", "xa", "ya", "xb", "yb")])

    def side(px: str, py: str, o: str) -> Column:
        a = [F.col(f"{o}{c}") for c in ("xa", "ya", "xb", "yb")]
        return (a[2] - a[0]) * (F.col(py) - a[1]) - (a[3] - a[1]) * (F.col(px) - a[0])

    apart = (side("xa", "ya", "o_") * side("xb", "yb", "o_") < 0) & (side("o_xa", "o_ya", "") * side("o_xb", "o_yb", "") < 0)
    return near.join(other, ["pid", "tx", "ty"]).where((F.col("eid") < F.col("o_eid")) & apart).select(F.col("pid").alias(pid)).distinct()


def _filled_even_odd(polys: DataFrame, pid: str) -> DataFrame:
    """Self-crossing polygons as trapezoids of their even-odd fill, window by window, numbered by ``part``.

    A polygon is cut into windows of about ``REPAIR_EDGES`` of its edges, so no step compares all edges of a large one.
    """
    boxed = with_bbox(polys)
    n_edges = F.aggregate("rings", F.lit(0), lambda acc, r: acc + F.size(r) - 1)
    side = F.ceil(F.sqrt(n_edges / REPAIR_EDGES)).cast("int")
    steps = F.sequence(F.lit(0), F.col("_k") - 1)
    split = boxed.withColumn("_k", side).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    at = lambda low, high, i: F.col(low) + (F.col(high) - F.col(low)) * i / F.col("_k")
    split = split.withColumns({
        "wx0": at("xmin", "xmax", F.col("_i")), "wx1": at("xmin", "xmax", F.col("_i") + 1),
        "wy0": at("ymin", "ymax", F.col("_j")), "wy1": at("ymin", "ymax", F.col("_j") + 1),
    }).drop(*BOX, "_k")
    flat = _flat(clip_to_rect(spread(split)))
    keep = [c for c in flat.columns if c not in ("wx0", "wx1", "wy0", "wy1")]
    schema = T.StructType([*[flat.schema[c] for c in keep], T.StructField("_n", T.IntegerType()), T.StructField("_area", T.DoubleType())])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            origin, number, area, xs_out, ys_out = [], [], [], [], []
            windows = batch[["wx0", "wy0", "wx1", "wy1"]].to_numpy(dtype=float)
            for row, (xs, ys, lens) in enumerate(zip(batch["xs"], batch["ys"], batch["lens"])):
                e = _ring_edges(xs, ys, lens)
                for i, t in enumerate(dissolve(np.zeros(len(e), dtype=int), *e.T, tuple(windows[row]))):
                    x, y, _ = _trapezoid(t)
                    origin.append(row)
                    number.append(i)
                    xs_out.append(np.array(x, dtype=float))
                    ys_out.append(np.array(y, dtype=float))
                    area.append(abs(ring_area(xs_out[-1], ys_out[-1])))
            out = batch[keep].iloc[origin].reset_index(drop=True)
            yield out.assign(xs=xs_out, ys=ys_out, lens=[[4]] * len(out), _n=np.array(number, dtype="int32"), _area=np.array(area, dtype=float))

    parts = materialize(flat.mapInPandas(fill, schema).where("_area > 0"))
    total = parts.groupBy(pid).agg(F.sum("_area").alias("area_after"))
    numbered = row_index(parts, ["_i", "_j", "_n"], [pid], "_part").withColumn("part", F.col("_part").cast("int"))
    told = _unflat(numbered.join(total, pid).drop("_i", "_j", "_n", "_area", "_part"))
    # a fill without area keeps its line
    gone = polys.join(total.select(pid), pid, "left_anti").withColumns({"area_after": F.lit(0.0), "part": F.lit(0)})
    return told.select(*gone.columns).unionByName(gone).withColumn("invalid", F.lit(True))


def _oriented(xs: np.ndarray, ys: np.ndarray, lens) -> tuple[np.ndarray, np.ndarray, float]:
    """Outer ring counter-clockwise, holes clockwise; also the net area."""
    total, start = 0.0, 0
    xs, ys = xs.copy(), ys.copy()
    for i, n in enumerate(lens):
        part = slice(start, start + n)
        area = ring_area(xs[part], ys[part])
        if (area < 0) == (i == 0):
            xs[part], ys[part] = xs[part][::-1], ys[part][::-1]
        total += abs(area) if i == 0 else -abs(area)
        start += n
    return xs, ys, total


def repair_log(repaired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, areas and repairs by relative area change; a repair of zero area counts as infinite."""
    fixed = F.col("status") == "repaired"
    change = F.abs(F.col("area_after") - F.col("raw_area")) / F.col("raw_area") * 100
    change = F.when(F.col("raw_area") == 0, F.lit(float("inf"))).otherwise(change)
    kept = F.col("status") != "rejected"
    return repaired.where("part = 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if("invalid").alias("invalid_count"),
        F.count_if(fixed).alias("repaired_count"),
        F.count_if(~kept).alias("rejected_count"),
        F.sum("raw_area").alias("input_area"),
        F.sum(F.when(kept, F.col("area_after")).otherwise(0.0)).alias("accepted_area"),
        *[F.count_if(fixed & (change > t)).alias(f"change_over_{n}") for t, n in ((0.1, "0_1"), (1.0, "1"), (5.0, "5"))],
    )
