"""Geometry as Column algebra over rings ``array<array<struct<x,y>>>``; no UDF."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rect_ring(xmin: str, ymin: str, xmax: str, ymax: str) -> Column:
    """Closed counter-clockwise ring of an axis-aligned rectangle."""
    a, b, c, d = F.col(xmin), F.col(ymin), F.col(xmax), F.col(ymax)
    return F.array(point(a, b), point(c, b), point(c, d), point(a, d), point(a, b))


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring."""
    return F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct(a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"), b["y"].alias("yb")),
    )


def signed_ring_area(ring: Column) -> Column:
    """Shoelace area, positive when counter-clockwise; taken relative to the first point."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    doubled = F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc + (e["xa"] - x0) * (e["yb"] - y0) - (e["xb"] - x0) * (e["ya"] - y0),
    )
    return doubled / 2


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring minus its holes (first ring is the outer one)."""
    areas = F.transform(rings, lambda r: F.abs(signed_ring_area(r)))
    return F.aggregate(F.slice(areas, F.lit(2), F.greatest(F.size(areas) - 1, F.lit(0))), areas[0], lambda acc, a: acc - a)


def bbox(rings: Column) -> Column:
    xs = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def on_boundary(x: Column, y: Column, rings: Column) -> Column:
    def touches(e: Column) -> Column:
        cross = (e["xb"] - e["xa"]) * (y - e["ya"]) - (e["yb"] - e["ya"]) * (x - e["xa"])
        return (
            (cross == 0)
            & (x >= F.least(e["xa"], e["xb"])) & (x <= F.greatest(e["xa"], e["xb"]))
            & (y >= F.least(e["ya"], e["yb"])) & (y <= F.greatest(e["ya"], e["yb"]))
        )

    return F.exists(F.flatten(F.transform(rings, ring_edges)), touches)


def inside_even_odd(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd crossing parity of a ray to the left; holes fall out by parity."""
    def crossing(acc: Column, e: Column) -> Column:
        spans = (e["ya"] > y) != (e["yb"] > y)
        at = e["xa"] + (y - e["ya"]) / (e["yb"] - e["ya"]) * (e["xb"] - e["xa"])
        return F.when(spans & (x < at), ~acc).otherwise(acc)

    return F.aggregate(F.flatten(F.transform(rings, ring_edges)), F.lit(False), crossing)


def polygon_contains(x: Column, y: Column, rings: Column, boundary: bool = False) -> Column:
    """``boundary=True`` is *covers* (lookup), ``False`` is *contains* (grid selection)."""
    edge = on_boundary(x, y, rings)
    return (edge | inside_even_odd(x, y, rings)) if boundary else (~edge & inside_even_odd(x, y, rings))


def _clamped_integral(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Integral over y of one edge's abscissa clamped to ``[x0, x1]``, y limited to ``[y0, y1]``."""
    width = x1 - x0
    clamp = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    primitive = lambda u: F.when(u <= 0, 0.0).when(u < width, u * u / 2).otherwise(width * u - width * width / 2)

    def ends(v: Column) -> Column:
        slope = F.when(e["yb"] != e["ya"], (e["xb"] - e["xa"]) / (e["yb"] - e["ya"])).otherwise(0.0)
        at = lambda y: e["xa"] + (y - e["ya"]) * slope - x0
        return F.struct(at(v["lo"]).alias("a"), at(v["hi"]).alias("b"), (v["hi"] - v["lo"]).alias("h"))

    def mean(v: Column) -> Column:
        a, b = v["a"], v["b"]
        low, high = F.least(a, b), F.greatest(a, b)
        return v["h"] * (
            F.when(high <= 0, 0.0).when(low >= width, width).when((low >= 0) & (high <= width), (a + b) / 2)
            .otherwise((primitive(b) - primitive(a)) / (b - a))
        )

    limits = F.struct(clamp(e["ya"], y0, y1).alias("lo"), clamp(e["yb"], y0, y1).alias("hi"))
    return _let(_let(limits, ends), mean)


def clipped_area(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a simple polygon inside a rectangle by Green's formula; no clipped ring is built."""
    def ring(r: Column) -> Column:
        edges = F.filter(
            ring_edges(r),
            lambda e: (e["ya"] != e["yb"]) & (F.greatest(e["ya"], e["yb"]) > y0) & (F.least(e["ya"], e["yb"]) < y1),
        )
        return F.abs(F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + _clamped_integral(e, x0, y0, x1, y1)))

    areas = F.transform(rings, ring)
    return F.aggregate(F.slice(areas, F.lit(2), F.greatest(F.size(areas) - 1, F.lit(0))), areas[0], lambda acc, a: acc - a)


def plain_number(value: Column) -> Column:
    """A double as text with all its digits; below 1e16 without the exponent Spark writes from 1e7 on."""
    text = value.cast("string")
    # nine decimals hold the at most 17 digits of a double that large
    digits = F.regexp_replace(text.cast("decimal(25,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16), digits).otherwise(text)


def to_wkt(rings: Column) -> Column:
    """``POLYGON`` text, for sinks that want a geometry column."""
    ring = lambda r: F.concat(
        F.lit("("),
        F.array_join(F.transform(r, lambda p: F.concat_ws(" ", plain_number(p["x"]), plain_number(p["y"]))), ", "),
        F.lit(")"),
    )
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


# ---------------------------------------------------------------- projections


@dataclass(frozen=True)
class TransverseMercator:
    """Fixed values of a transverse Mercator grid on an ellipsoid."""

    lat0: float
    lon0: float
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    a: float = 6378137.0
    rf: float = 298.257222101


@dataclass(frozen=True)
class EqualAreaLaea:
    lat0: float
    lon0: float
    fe: float
    fn: float
    a: float = 6378137.0
    rf: float = 298.257222101


# The national metric grid and the European equal-area grid (GRS80).
NATIONAL_TM = TransverseMercator(lat0=39.66825833333333, lon0=-8.133108333333334)
EUROPE_LAEA = EqualAreaLaea(lat0=52.0, lon0=10.0, fe=4321000.0, fn=3210000.0)


def _ellipsoid(rf: float) -> tuple[float, float]:
    f = 1 / rf
    return math.sqrt(f * (2 - f)), f / (2 - f)


def _alpha(n: float) -> list[float]:
    """Forward Krueger coefficients to fourth order in the third flattening."""
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def _beta(n: float) -> list[float]:
    """Inverse Krueger coefficients."""
    return [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]


def _conformal_tan(phi: Column, e: float) -> Column:
    """Tangent of the conformal latitude."""
    tau = F.tan(phi)
    sigma = F.sinh(e * F.atanh(e * tau / F.sqrt(1 + tau * tau)))
    return tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)


def _tm_origin(crs: TransverseMercator) -> tuple[float, float]:
    e, n = _ellipsoid(crs.rf)
    radius = crs.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    phi = math.radians(crs.lat0)
    tau = math.tan(phi)
    sigma = math.sinh(e * math.atanh(e * tau / math.sqrt(1 + tau * tau)))
    xi = math.atan(tau * math.sqrt(1 + sigma**2) - sigma * math.sqrt(1 + tau**2))
    xi += sum(a * math.sin(2 * j * xi) for j, a in enumerate(_alpha(n), start=1))
    return radius, radius * crs.k0 * xi


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps nested formulas from repeating."""
    return F.transform(F.array(value), body)[0]


def tm_forward(lon: Column, lat: Column, crs: TransverseMercator = NATIONAL_TM) -> Column:
    """Degrees to metres as ``struct<x,y>``."""
    e, n = _ellipsoid(crs.rf)
    radius, m0 = _tm_origin(crs)
    scale = crs.k0 * radius

    def sphere(v: Column) -> Column:
        xi0 = F.atan2(v["t"], F.cos(v["d"]))
        eta0 = F.asinh(F.sin(v["d"]) / F.sqrt(v["t"] * v["t"] + F.cos(v["d"]) * F.cos(v["d"])))
        return F.struct(xi0.alias("xi"), eta0.alias("eta"))

    def series(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        for j, a in enumerate(_alpha(n), start=1):
            xi = xi + a * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta + a * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct((eta * scale + crs.fe).alias("x"), (xi * scale - m0 + crs.fn).alias("y"))

    tangent = _let(F.radians(lat), lambda phi: _conformal_tan(phi, e))
    start = F.struct(tangent.alias("t"), F.radians(lon - crs.lon0).alias("d"))
    return _let(_let(start, sphere), series)


def tm_inverse(x: Column, y: Column, crs: TransverseMercator = NATIONAL_TM) -> Column:
    """Metres to degrees as ``struct<lon,lat>``; the latitude takes fixed Newton steps."""
    e, n = _ellipsoid(crs.rf)
    radius, m0 = _tm_origin(crs)
    scale = crs.k0 * radius

    def series(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        for j, b in enumerate(_beta(n), start=1):
            xi = xi - b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def degrees(v: Column) -> Column:
        s, c = F.sinh(v["eta"]), F.cos(v["xi"])
        lon = F.degrees(F.atan2(s, c)) + crs.lon0
        lat = _let(F.sin(v["xi"]) / F.sqrt(s * s + c * c), latitude)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    def latitude(target: Column) -> Column:
        def newton(tau: Column, _: Column) -> Column:
            def step(root: Column) -> Column:
                sigma = F.sinh(e * F.atanh(e * tau / root))
                t = tau * F.sqrt(1 + sigma * sigma) - sigma * root
                return tau + (target - t) / F.sqrt(1 + t * t) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * root)

            return _let(F.sqrt(1 + tau * tau), step)

        return F.degrees(F.atan(F.aggregate(F.sequence(F.lit(1), F.lit(3)), target, newton)))

    start = F.struct(((y - crs.fn + m0) / scale).alias("xi"), ((x - crs.fe) / scale).alias("eta"))
    return _let(_let(start, series), degrees)


def laea_forward(lon: Column, lat: Column, crs: EqualAreaLaea = EUROPE_LAEA) -> Column:
    """Degrees to equal-area metres as ``struct<x,y>``."""
    e, _ = _ellipsoid(crs.rf)

    def q_num(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)

    qp = q_num(math.pi / 2)
    rq = crs.a * math.sqrt(qp / 2)
    phi1 = math.radians(crs.lat0)
    b1 = math.asin(q_num(phi1) / qp)
    m1 = math.cos(phi1) / math.sqrt(1 - (e * math.sin(phi1)) ** 2)
    d = crs.a * m1 / (rq * math.cos(b1))
    def authalic(s: Column) -> Column:
        q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
        return F.asin(q / qp)

    def project(v: Column) -> Column:
        beta, dlon = v["beta"], v["d"]
        b = rq * F.sqrt(2 / (1 + math.sin(b1) * F.sin(beta) + math.cos(b1) * F.cos(beta) * F.cos(dlon)))
        x = b * d * F.cos(beta) * F.sin(dlon) + crs.fe
        y = b / d * (math.cos(b1) * F.sin(beta) - math.sin(b1) * F.cos(beta) * F.cos(dlon)) + crs.fn
        return F.struct(x.alias("x"), y.alias("y"))

    beta = _let(F.sin(F.radians(lat)), authalic)
    return _let(F.struct(beta.alias("beta"), F.radians(lon - crs.lon0).alias("d")), project)
