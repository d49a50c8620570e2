"""Coordinate lookup as joins: containing cell, area-weighted context, response rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.functions.scalars import band3, parse_radii
from gridpanel.operators.skew import salted_join
from gridpanel.session import materialize, spread

SEGMENTS = 64
#: Radius of the circle inside the 64-gon, as a share of the outer radius.
INSCRIBED = math.cos(math.pi / SEGMENTS) * (1 - 1e-12)
#: Rows of the kernel's arrays held at once, so that they stay in the processor's cache.
KERNEL_ROWS = 512


@F.pandas_udf(T.DoubleType())
def _disc_rect_area(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Area of a regular 64-gon of radius ``r`` around ``(px, py)`` inside a rectangle.

    Green's formula with the abscissa clamped to the rectangle, for a whole Arrow
    batch at once: every polygon edge adds the integral of its clamped x over y.
    """
    angle = 2 * math.pi * np.arange(SEGMENTS + 1) / SEGMENTS
    ux, uy = np.cos(angle), np.sin(angle)

    def areas(*columns: np.ndarray) -> np.ndarray:
        p, q, rad, a, b, c, d = (v[:, None] for v in columns)
        vx, vy = p + rad * ux - a, q + rad * uy
        xa, xb, ya, yb = vx[:, :-1], vx[:, 1:], vy[:, :-1], vy[:, 1:]
        width = c - a
        low, high = np.clip(ya, b, d), np.clip(yb, b, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(yb != ya, (xb - xa) / (yb - ya), 0.0)
        ul, uh = xa + (low - ya) * slope, xa + (high - ya) * slope

        def primitive(u):
            return np.where(u <= 0, 0.0, np.where(u < width, u * u / 2, width * u - width * width / 2))

        inside = (ul >= 0) & (uh >= 0) & (ul <= width) & (uh <= width)
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = np.where(uh != ul, (primitive(uh) - primitive(ul)) / (uh - ul), np.clip(ul, 0, width))
        mean = np.where(inside, (ul + uh) / 2, np.where((ul <= 0) & (uh <= 0), 0.0, np.where((ul >= width) & (uh >= width), width, mixed)))
        return np.maximum(np.sum(mean * (high - low), axis=1), 0.0)

    for batch in batches:
        columns = [v.to_numpy() for v in batch]
        parts = [areas(*[v[i : i + KERNEL_ROWS] for v in columns]) for i in range(0, len(columns[0]), KERNEL_ROWS)]
        yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))


def containing_cell(points: DataFrame, cells: DataFrame, size: float, key: str | Sequence[str] = "event_id") -> DataFrame:
    """Covering cell of each point, known by one or more columns; on a shared edge the smallest ``cell_id``."""
    fx, fy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    xs = F.when(F.col("x") == fx * size, F.array(fx - 1, fx)).otherwise(F.array(fx))
    ys = F.when(F.col("y") == fy * size, F.array(fy - 1, fy)).otherwise(F.array(fy))
    candidates = points.withColumn("ix", F.explode(xs)).withColumn("iy", F.explode(ys))
    grid = cells.select(F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "cell_id")
    hit = salted_join(candidates, grid, ["ix", "iy"])
    return hit.groupBy(*([key] if isinstance(key, str) else key)).agg(F.min("cell_id").alias("cell_id"))


def context_summary(
    points: DataFrame, cells: DataFrame, size: float, *, square: bool = False, higher: float = 0.80
) -> DataFrame:
    """Area-weighted context per ``(x, y, radius_km)``.

    ``cells(cell_id, ix, iy, estimate, rank_pct, history)``. The context is a 64-gon
    around the point, or with ``square`` the square of half-width ``radius``. Each
    distinct point and radius is computed once.
    """
    r = F.col("radius_km") * 1000.0
    # a pre-aggregation, then an even spread: the weights are the expensive part
    spots = spread(points.select("x", "y", "radius_km").distinct())
    span = lambda c: F.sequence(F.floor((F.col(c) - r) / size), F.floor((F.col(c) + r) / size))
    squares = spots.withColumn("ix", F.explode(span("x"))).withColumn("iy", F.explode(span("y")))
    x0, y0 = F.col("ix") * float(size), F.col("iy") * float(size)
    x1, y1 = x0 + size, y0 + size
    if square:
        w = F.greatest(F.least(F.col("x") + r, x1) - F.greatest(F.col("x") - r, x0), F.lit(0.0))
        h = F.greatest(F.least(F.col("y") + r, y1) - F.greatest(F.col("y") - r, y0), F.lit(0.0))
        weighted = squares.withColumn("w", w * h)
    else:
        # squares within the inscribed circle count whole, those beyond the outer one not at all; the rest reach the kernel
        far = lambda p, a, b: F.greatest(F.abs(F.col(p) - a), F.abs(F.col(p) - b))
        near = lambda p, a, b: F.greatest(a - F.col(p), F.col(p) - b, F.lit(0.0))
        squared = lambda side: side("x", x0, x1) * side("x", x0, x1) + side("y", y0, y1) * side("y", y0, y1)
        whole = squared(far) <= r * r * INSCRIBED**2
        rim = squares.where(~whole & (squared(near) < r * r))
        # declared so that the filter below is not pushed under it, which would run it twice
        kernel = _disc_rect_area.asNondeterministic()(F.col("x"), F.col("y"), r, x0, y0, x1, y1)
        weighted = squares.where(whole).withColumn("w", F.lit(float(size * size))).unionByName(rim.withColumn("w", kernel))
    # contact without area leaves rounding dust, far below a square millimetre per square metre
    weighted = weighted.where(F.col("w") > 1e-9 * size * size)
    values = cells.select(
        F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "cell_id", "estimate", "rank_pct", "history"
    )
    # squares are counted before the kernel, which would run once more for the count
    met = salted_join(weighted, values, ["ix", "iy"], key_counts=squares.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("_n")))
    w = F.col("w")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    # at most (2r/size + 2)^2 cells per point, so the id list is bounded by the largest legal radius
    return met.groupBy("x", "y", "radius_km").agg(
        F.count(F.lit(1)).alias("intersecting_cell_count"),
        (F.sum(w) / 1_000_000.0).alias("intersected_area_sq_km"),
        mean("estimate").alias("mean_estimate"),
        mean("rank_pct").alias("mean_rank_pct"),
        (F.sum(F.when(F.col("rank_pct") > higher, w).otherwise(0.0)) / F.sum(w)).alias("higher_area_share"),
        mean("history").alias("mean_history"),
        F.sort_array(F.collect_list("cell_id")).alias("cell_ids"),
    )


def model_inputs_join(located: DataFrame, inputs: DataFrame) -> DataFrame:
    """Recorded inputs of the containing cell; a cell without inputs is an error."""
    joined = salted_join(located, inputs.withColumn("_has", F.lit(True)), ["cell_id"], "left")
    return joined.where(
        F.when(F.col("_has"), True).otherwise(F.raise_error(F.lit("published inputs are missing for a cell")))
    ).drop("_has")


def lookup_job(
    requests: DataFrame, cells: DataFrame, size: float, key: str = "event_id", square: bool = False
) -> DataFrame:
    """Status 200, 404 or 422 and the response of every request row.

    ``requests(key, x, y, buffers_km)``; the contexts of a request arrive as one array
    in radius order (a request names a few radii only). A response hangs on the place and
    the radii alone: each distinct pair is answered once, and its requests meet the answer in one join.
    """
    radii, error = parse_radii(F.col("buffers_km"))
    parsed = requests.withColumns({"radii": radii, "error": error})
    ask = ["x", "y", "radii"]
    asked = materialize(parsed.where(F.col("error").isNull()).groupBy(*ask).agg(F.count(F.lit(1)).alias("_n")))
    located = containing_cell(asked.select("x", "y").distinct(), cells, size, ["x", "y"])
    scored = salted_join(located, cells.select("cell_id", "estimate", "rank_pct", "history"), ["cell_id"])
    found = materialize(asked.select(*ask).join(scored, ["x", "y"]))
    spots = found.select("x", "y", F.explode("radii").alias("radius_km"), "radii")
    context = context_summary(spots, cells, size, square=square)
    packed = spots.join(context, ["x", "y", "radius_km"]).groupBy(*ask).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "radius_km", "intersecting_cell_count", "intersected_area_sq_km", "mean_estimate", "mean_rank_pct",
                    "higher_area_share", "mean_history", "cell_ids",
                )
            )
        ).alias("contexts")
    )
    body = found.withColumn("band", band3(F.col("rank_pct"))["label"])
    rows = salted_join(parsed, body.join(packed, ask, "left"), ask, "left", key_counts=asked)
    status = F.when(F.col("error").isNotNull(), 422).when(F.col("cell_id").isNull(), 404).otherwise(200)
    return rows.select(
        key, "x", "y", status.alias("status"), "error", "cell_id", "estimate", "rank_pct", "band", "history", "contexts"
    )


def responses_json(rows: DataFrame, key: str = "event_id") -> DataFrame:
    body = F.struct(*[F.col(c) for c in rows.columns if c not in (key, "status")])
    return rows.select(key, "status", F.to_json(body).alias("body"))
