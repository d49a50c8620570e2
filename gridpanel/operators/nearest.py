"""Nearest-source joins: containing coarse cell, k nearest, and filling from a mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpanel.operators.prefix import exact_quantiles
from gridpanel.operators.skew import packed, salted_join
from gridpanel.session import broadcast_if_small, materialize

MAX_DEPTH = 24
BROADCAST_BOUND = 200_000


def _box_levels(places: DataFrame, per_box: int) -> tuple[float, float, float, int]:
    """Root square of a quadtree and the depth at which no box holds more than ``per_box`` places."""
    ext = places.agg(F.min("sx"), F.min("sy"), F.max("sx"), F.max("sy")).first()
    x0, y0, x1, y1 = (float(v) for v in ext)
    side = max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)
    depth = 1
    while depth < MAX_DEPTH:
        step = side / 2**depth
        fullest = (
            places.groupBy(F.floor((F.col("sx") - x0) / step), F.floor((F.col("sy") - y0) / step))
            .agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        )
        if fullest <= per_box:
            break
        depth += max(1, (int(fullest / per_box) - 1).bit_length() // 2)
    return x0, y0, side, min(depth, MAX_DEPTH)


def knn(
    points: DataFrame, sources: DataFrame, k: int = 1, per_box: int = 32
) -> DataFrame:
    """``points(pid, px, py)`` to their ``k`` nearest ``sources(sid, sx, sy)``, exactly.

    All points descend one quadtree of the sources level by level. A box knows the extent
    of its sources and, at each of its four sides, a strip that holds ``k`` of them. At each
    level a point keeps the boxes that could still hold one of its ``k`` nearest: those
    whose extent is not beyond the far corner of a strip. Strips also tell boxes apart that lie side
    by side far away, so the frontier per point stays a handful of boxes however uneven the
    sources are and wherever the points lie; there is no all-pairs step and no cap. Equal
    distances take the smallest ``sid``. Coinciding points and coinciding sources are handled once.
    """
    by_id = W.partitionBy("sx", "sy").orderBy("sid")
    if k == 1:
        ranked = sources.groupBy("sx", "sy").agg(F.array(F.min("sid")).alias("sids"))
    else:
        first = sources.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k)
        ranked = first.groupBy("sx", "sy").agg(F.sort_array(F.collect_list("sid")).alias("sids"))
    places = materialize(ranked.where("sx IS NOT NULL AND sy IS NOT NULL"))
    if places.isEmpty():
        raise ValueError("nearest search needs at least one source")
    x0, y0, side, depth = _box_levels(places, per_box)
    leaf = side / 2**depth
    boxed = places.withColumns(
        {"bx": F.floor((F.col("sx") - x0) / leaf), "by": F.floor((F.col("sy") - y0) / leaf)}
    )
    few = places.limit(BROADCAST_BOUND + 1).count() <= BROADCAST_BOUND
    levels = {depth: materialize(_extents(boxed, k))}
    for level in range(depth - 1, 0, -1):
        finer = levels[level + 1]
        # a strip of a part is one of the whole
        levels[level] = finer.groupBy(F.floor(F.col("bx") / 2).alias("bx"), F.floor(F.col("by") / 2).alias("by")).agg(
            F.sum("_c").alias("_c"), *[(F.min if c in _LOWEST else F.max)(c).alias(c) for c in _LOWEST + _HIGHEST]
        )
    spots = points.groupBy("px", "py").agg(F.count(F.lit(1)).alias("_n"))
    frontier = spots.select("px", "py", F.lit(0).cast("bigint").alias("bx"), F.lit(0).cast("bigint").alias("by"))
    halves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spot = W.partitionBy("px", "py")
    px, py = F.col("px"), F.col("py")
    for level in range(1, depth + 1):
        children = frontier.withColumn("_h", F.explode(halves)).select(
            "px", "py", (F.col("bx") * 2 + F.col("_h.i")).alias("bx"), (F.col("by") * 2 + F.col("_h.j")).alias("by")
        )
        met = _meet_boxes(children, levels[level], few)
        near = _gap(px, "_x0", "_x1") + _gap(py, "_y0", "_y1")
        whole = _reach(px, "_x0", "_x1") + _reach(py, "_y0", "_y1")
        strips = [
            _reach(px, "_x0", "_west") + _reach(py, "_y0", "_y1"), _reach(px, "_east", "_x1") + _reach(py, "_y0", "_y1"),
            _reach(px, "_x0", "_x1") + _reach(py, "_y0", "_south"), _reach(px, "_x0", "_x1") + _reach(py, "_north", "_y1"),
        ]
        bounded = met.select(
            "px", "py", "bx", "by", "_x0", "_x1", "_y0", "_y1", near.alias("_near"), whole.alias("_far"),
            F.least(F.when(F.col("_c") >= k, whole), F.when(F.col("_west").isNotNull(), F.least(*strips))).alias("_enough"),
        )
        if k == 1:
            limit = F.coalesce(F.min("_enough").over(spot), F.max("_far").over(spot))
        else:
            # each side touches a source, so k boxes have k sources no farther than their nearest sides reach
            sides = [_reach(px, c, c) + _reach(py, "_y0", "_y1") for c in ("_x0", "_x1")] + [_reach(px, "_x0", "_x1") + _reach(py, c, c) for c in ("_y0", "_y1")]
            bounded = bounded.withColumn("_one", F.least(*sides))
            ordered = spot.orderBy("_one").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            enough = F.least(F.min("_enough").over(ordered), F.nth_value("_one", k).over(ordered))
            limit = F.coalesce(enough, F.max("_far").over(ordered))
        frontier = bounded.withColumn("_limit", limit).where(
            F.col("_near") <= F.col("_limit") * (1 + 1e-9)
        ).select("px", "py", "bx", "by")
        if level % 12 == 0:
            frontier = materialize(frontier)
    # the places of a box travel as one row, and only its k best go on
    met = _meet_boxes(frontier, packed(boxed, ["bx", "by"], "_places"), few)

    def told(p: Column) -> Column:
        dx, dy = px - p["sx"], py - p["sy"]
        return F.struct((dx * dx + dy * dy).alias("_d2"), p["sids"].alias("sids"), p["sx"].alias("sx"), p["sy"].alias("sy"))

    nearest = F.transform("_places", told)
    if k == 1:
        best = met.select("px", "py", F.array_min(nearest).alias("_b")).groupBy("px", "py").agg(F.min("_b").alias("_b")).select(
            "px", "py", F.col("_b.sids")[0].alias("sid"), "_b.sx", "_b.sy", "_b._d2", F.lit(1).alias("rank")
        )
    else:
        # of the k best sources each lies in one of the k best places
        few_best = met.select("px", "py", F.explode(F.slice(F.sort_array(nearest), 1, k)).alias("_b"))
        kept = few_best.withColumn("_r", F.row_number().over(spot.orderBy("_b"))).where(F.col("_r") <= k)
        one_each = kept.select("px", "py", F.explode("_b.sids").alias("sid"), "_b.sx", "_b.sy", "_b._d2")
        best = one_each.withColumn("rank", F.row_number().over(spot.orderBy("_d2", "sid"))).where(F.col("rank") <= k)
    back = salted_join(points, best, ["px", "py"], key_counts=spots)
    return back.withColumn("distance", F.sqrt("_d2")).drop("_d2")


#: Extent of a box's sources, and the inner edges of the strips at its sides.
_LOWEST, _HIGHEST = ["_x0", "_y0", "_west", "_south"], ["_x1", "_y1", "_east", "_north"]


def _extents(boxed: DataFrame, k: int) -> DataFrame:
    """Per box the number of its sources (``k`` of a place at most), their extent, and how far from each side ``k`` of them reach (null with fewer)."""
    box = W.partitionBy("bx", "by")
    edges = {"_west": F.col("sx").asc(), "_east": F.col("sx").desc(), "_south": F.col("sy").asc(), "_north": F.col("sy").desc()}
    counted = boxed.withColumn("_w", F.size("sids"))
    for name, order in edges.items():
        counted = counted.withColumn(name, F.sum("_w").over(box.orderBy(order)) >= k)
    return counted.groupBy("bx", "by").agg(
        F.sum("_w").alias("_c"), F.min("sx").alias("_x0"), F.max("sx").alias("_x1"), F.min("sy").alias("_y0"), F.max("sy").alias("_y1"),
        F.min(F.when(F.col("_west"), F.col("sx"))).alias("_west"), F.max(F.when(F.col("_east"), F.col("sx"))).alias("_east"),
        F.min(F.when(F.col("_south"), F.col("sy"))).alias("_south"), F.max(F.when(F.col("_north"), F.col("sy"))).alias("_north"),
    )


def _meet_boxes(frontier: DataFrame, boxes: DataFrame, few: bool) -> DataFrame:
    """Join on the box; few boxes mean many points per box, so boxes of few places are broadcast."""
    return frontier.join(F.broadcast(boxes), ["bx", "by"]) if few else salted_join(frontier, boxes, ["bx", "by"])


def _gap(p: Column, low: str, high: str) -> Column:
    """Squared distance along one axis from ``p`` to an interval."""
    near = F.greatest(F.col(low) - p, p - F.col(high), F.lit(0.0))
    return near * near


def _reach(p: Column, low: str, high: str) -> Column:
    """Squared distance along one axis from ``p`` to the farther end of an interval."""
    far = F.greatest(F.abs(p - F.col(low)), F.abs(p - F.col(high)))
    return far * far


def nearest_on_axis(values: DataFrame, value: str, axis: DataFrame, index: str, coordinate: str, out: str) -> DataFrame:
    """Index of the axis coordinate nearest to each distinct ``value``; ties take the first index."""
    spots = values.select(value).distinct().select(F.col(value).alias("pid"), F.col(value).alias("px"), F.lit(0.0).alias("py"))
    ticks = axis.select(F.col(index).alias("sid"), F.col(coordinate).alias("sx"), F.lit(0.0).alias("sy")).distinct()
    return knn(spots, ticks).select(F.col("pid").alias(value), F.col("sid").alias(out))


def nearest_axis_join(
    cells: DataFrame, lats: DataFrame, lons: DataFrame, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Containing coarse cell by the nearest coordinate on each axis separately.

    ``lats(lat_idx, lat)`` and ``lons(lon_idx, lon)`` keep the source index, since the
    first index wins a tie whichever way the axis runs.
    """
    by_lat = nearest_on_axis(cells, lat, lats, "lat_idx", "lat", "lat_idx")
    by_lon = nearest_on_axis(cells, lon, lons, "lon_idx", "lon", "lon_idx")
    return salted_join(salted_join(cells, by_lat, [lat]), by_lon, [lon])


def fallback_mapping(
    cells: DataFrame, sources: DataFrame, axis: Sequence[str] = ("lat_idx", "lon_idx")
) -> DataFrame:
    """Nearest valid source for every cell whose containing source is masked.

    ``cells(cell_id, cx, cy, lat_idx, lon_idx)``; ``sources(lat_idx, lon_idx, sid, sx, sy, valid)``.
    """
    masked = sources.where(~F.col("valid")).select(*axis)
    affected = cells.join(masked, list(axis), "left_semi")
    points = affected.select(F.col("cell_id").alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = knn(points, sources.where("valid").select("sid", "sx", "sy"))
    return near.select(
        F.col("pid").alias("cell_id"), F.col("sid").alias("fallback_sid"), "sx", "sy",
        (F.col("distance") / 1000.0).alias("distance_km"), F.lit("nearest_valid_source").alias("assignment_method"),
    )


def fill_from_mapping(
    cell_years: DataFrame, climate: DataFrame, mapping: DataFrame, variables: Sequence[str], by: Sequence[str] = ("year",)
) -> DataFrame:
    """Own source value where valid, otherwise all variables of the mapped source together.

    ``cell_years`` carry ``cell_id, sid``; ``climate`` is one row per ``(sid, by…)``. Only masked
    rows with a mapping meet the second source, so no row is dealt by a null key. A source
    masked in some of the variables only is an error, and so is a mapped source without values.
    """
    own = cell_years.join(climate, ["sid", *by], "left")
    nulls = sum((F.col(v).isNull().cast("int") for v in variables), F.lit(0))
    partial = F.when((nulls > 0) & (nulls < len(variables)), F.raise_error(F.concat(F.lit("source masked in part: "), F.col("sid").cast("string"))))
    masked = F.coalesce(partial.cast("boolean"), nulls > 0)
    mapped = mapping.select("cell_id", "fallback_sid")
    second = climate.select(
        F.col("sid").alias("fallback_sid"), *by, *[F.col(v).alias(f"_f_{v}") for v in variables]
    )
    columns = own.columns
    whole = own.where(~masked).withColumn("assignment_method", F.lit("containing_source"))
    open_ = own.where(masked).join(mapped, "cell_id", "left")
    alone = open_.where("fallback_sid IS NULL").select(*columns, F.lit("unassigned").alias("assignment_method"))
    met = open_.where("fallback_sid IS NOT NULL").join(second, ["fallback_sid", *by], "left")
    filled = {
        v: F.coalesce(F.col(f"_f_{v}"), F.raise_error(F.lit("mapped source has no value")).cast("double")) for v in variables
    }
    met = met.withColumns(filled).select(*columns, F.lit("nearest_valid_source").alias("assignment_method"))
    return whole.unionByName(alone).unionByName(met)


def local_consistency(
    mapping: DataFrame, points: DataFrame, sources: DataFrame, climate: DataFrame, variables: Sequence[str], k: int = 5
) -> DataFrame:
    """Largest gap, over the years, between the fallback value and the median of the k nearest sources."""
    near = knn(points, sources.select("sid", "sx", "sy"), k=k).select(F.col("pid").alias("cell_id"), "sid")
    values = near.join(climate, "sid").groupBy("cell_id", "year")
    # k values per group, so the built-in percentile holds a fixed handful
    medians = values.agg(*[F.percentile(v, 0.5).alias(f"_m_{v}") for v in variables])
    chosen = mapping.select("cell_id", F.col("fallback_sid").alias("sid")).join(climate, "sid")
    gaps = chosen.join(medians, ["cell_id", "year"])
    return gaps.groupBy("cell_id").agg(*[F.max(F.abs(F.col(v) - F.col(f"_m_{v}"))).alias(f"max_gap_{v}") for v in variables])


def distance_summary(mapping: DataFrame, col: str = "distance_km") -> DataFrame:
    probs = {"median": 0.5, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    ends = mapping.select(F.lit(col).alias("column"), F.col(col).alias("v")).groupBy("column").agg(
        F.min("v").alias("minimum"), F.avg("v").alias("mean"), F.max("v").alias("maximum")
    )
    return exact_quantiles(mapping, [col], probs).join(ends, "column")


def source_extent(sources: DataFrame, mapping: DataFrame, limit_km: float = 20.0) -> DataFrame:
    """Extent and shape of the source grid, valid and masked counts and the acceptance flag."""
    grid = sources.agg(
        F.max("lat_idx").alias("last_lat"), F.max("lon_idx").alias("last_lon"), F.min("lat_idx").alias("first_lat"),
        F.min("lon_idx").alias("first_lon"), F.count_if("valid").alias("valid_sources"),
        F.count_if(~F.col("valid")).alias("masked_sources"), F.min("sx").alias("west"), F.max("sx").alias("east"),
        F.min("sy").alias("south"), F.max("sy").alias("north"),
    )
    edge = grid.select(F.struct("first_lat", "last_lat", "first_lon", "last_lon").alias("e")).scalar()
    on_edge = (
        (F.col("lat_idx") == edge["first_lat"]) | (F.col("lat_idx") == edge["last_lat"])
        | (F.col("lon_idx") == edge["first_lon"]) | (F.col("lon_idx") == edge["last_lon"])
    )
    chosen = mapping.join(sources.select(F.col("sid").alias("fallback_sid"), "lat_idx", "lon_idx"), "fallback_sid")
    picked = chosen.agg(
        F.count_if(on_edge).alias("on_boundary"), F.max("distance_km").alias("max_km"), F.count(F.lit(1)).alias("affected")
    )
    s = picked.select(F.struct("on_boundary", "max_km", "affected").alias("s")).scalar()
    return grid.withColumns(
        {
            "affected": s["affected"], "on_boundary": s["on_boundary"],
            "accepted": (s["on_boundary"] == 0) & (s["max_km"] < limit_km),
        }
    )
