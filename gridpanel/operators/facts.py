"""Facts of source layers as typed rows, and a gate that compares them with registered ones.

A layer is read once: one aggregate gives all its numbers and texts, which become rows
``(layer, fact, number, text)``. Registered facts have the same form, with a tolerance for numbers.
What the rows themselves cannot tell (reference system, units, declared no-data code) is handed in and
compared like the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.geometry import polygon_area

#: Numbers agree within this difference unless a registered fact says otherwise.
TOLERANCE = 1e-9
FACT = "struct<fact:string,number:double,text:string>"


def _fact(name: str, value: Column, text: bool) -> Column:
    number, words = (F.lit(None), value) if text else (value, F.lit(None))
    return F.struct(F.lit(name).alias("fact"), number.cast("double").alias("number"), words.cast("string").alias("text"))


def _listed(values: Column) -> Column:
    """Distinct values as sorted text; there are few of them by their nature (codes, years, types)."""
    return F.array_join(F.array_sort(F.collect_set(values.cast("string"))), ",")


def _tidy(wide: DataFrame, layer: str, numbers: Sequence[str], texts: Sequence[str], given: Mapping[str, str]) -> DataFrame:
    facts = [_fact(n, F.col(f"`{n}`"), False) for n in numbers] + [_fact(t, F.col(f"`{t}`"), True) for t in texts]
    facts += [_fact(name, F.lit(value), True) for name, value in given.items()]
    return wide.select(F.col(layer).cast("string").alias("layer"), F.inline(F.array(*facts)))


def vector_facts(
    layer: DataFrame, by: str, *, code: str | None = None, year: str | None = None, crs: str, kind: str | None = None,
    invalid: Column | None = None, rings: str = "rings",
) -> DataFrame:
    """Features, null, empty and invalid geometries, types, fields, codes, years, extent and reference system per layer.

    ``invalid`` judges a row; without it an invalid geometry is one with an open ring or without area.
    ``kind`` names a column with the geometry type; without it null rings have none and all others are polygons.
    """
    shape = F.col(rings)
    empty = shape.isNotNull() & (F.size(F.flatten(shape)) == 0)
    solid = shape.isNotNull() & ~empty
    if invalid is None:
        invalid = F.exists(shape, lambda r: r[0] != F.element_at(r, -1)) | (polygon_area(shape) <= 0)
    types = F.col(kind) if kind else F.when(shape.isNotNull(), "Polygon").otherwise("None")
    points = F.flatten(shape)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    ends = {"xmin": F.min(F.array_min(xs)), "ymin": F.min(F.array_min(ys)), "xmax": F.max(F.array_max(xs)), "ymax": F.max(F.array_max(ys))}
    counts = {
        "features": F.count(F.lit(1)), "null_geometry": F.count_if(shape.isNull()), "empty_geometry": F.count_if(empty),
        "invalid_geometry": F.count_if(solid & invalid),
    }
    texts = {"types": _listed(types)} | ({"codes": _listed(F.col(code))} if code else {}) | ({"years": _listed(F.col(year))} if year else {})
    wide = layer.groupBy(by).agg(*[c.alias(n) for n, c in (counts | ends | texts).items()])
    fields = ",".join(c for c in layer.columns if c not in (rings, kind))
    return _tidy(wide, by, [*counts, *ends], list(texts), {"fields": fields, "crs": crs})


def axis_facts(long: DataFrame, by: str, axis: str, name: str) -> DataFrame:
    """Length, ends and smallest and largest step of a coordinate axis per layer."""
    values = long.select(by, F.col(axis).cast("double").alias("_v")).distinct()
    # an axis has few values; the list is sorted once per layer
    sorted_ = values.groupBy(by).agg(F.array_sort(F.collect_list("_v")).alias("_a"))
    steps = F.zip_with(F.slice("_a", F.lit(1), F.size("_a") - 1), F.slice("_a", F.lit(2), F.size("_a") - 1), lambda a, b: b - a)
    wide = sorted_.select(
        by, F.size("_a").alias(f"{name}_count"), F.element_at("_a", 1).alias(f"{name}_first"), F.element_at("_a", -1).alias(f"{name}_last"),
        F.array_min(steps).alias(f"{name}_step_min"), F.array_max(steps).alias(f"{name}_step_max"),
    )
    return _tidy(wide, by, [c for c in wide.columns if c != by], [], {})


def climate_facts(long: DataFrame, by: str, lat: str, lon: str, month: str, variables: Mapping[str, str]) -> DataFrame:
    """Months, rows, grid axes, missing values and types per layer, and the unit of each variable (name to unit)."""
    typed = dict(long.dtypes)
    nulls = {f"missing_{v}": F.count_if(F.col(v).isNull() | F.isnan(F.col(v).cast("double"))) for v in variables}
    wide = long.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), _listed(F.format_string("%02d", F.col(month).cast("int"))).alias("months"), *[c.alias(n) for n, c in nulls.items()])
    given = {f"unit_{v}": unit for v, unit in variables.items()} | {f"type_{v}": typed[v] for v in variables} | {"variables": ",".join(variables)}
    facts = _tidy(wide, by, ["rows", *nulls], ["months"], given)
    return facts.unionByName(axis_facts(long, by, lat, "lat")).unionByName(axis_facts(long, by, lon, "lon"))


def raster_facts(pixels: DataFrame, by: str, *, crs: str, resolution: float, nodata: float | None, value: str = "value") -> DataFrame:
    """Size, pixel and no-data counts, value range and type per raster, with its reference system, resolution and no-data code."""
    v = F.col(value)
    gone = v.isNull() if nodata is None else v.isNull() | (v == nodata)
    kept = F.when(~gone, v)
    wide = pixels.groupBy(by).agg(
        (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), F.count(F.lit(1)).alias("pixels"),
        F.count_if(gone).alias("nodata_pixels"), F.min(kept).alias("least"), F.max(kept).alias("most"),
    )
    given = {"crs": crs, "dtype": dict(pixels.dtypes)[value], "resolution": f"{resolution:g}", "nodata": "none" if nodata is None else f"{nodata:g}"}
    return _tidy(wide, by, [c for c in wide.columns if c != by], [], given)


def registered(df: DataFrame, layer: str, columns: Sequence[str]) -> DataFrame:
    """A wide table of registered values as facts; null values register nothing."""
    typed = dict(df.dtypes)
    facts = [_fact(c, F.col(c), typed[c] == "string") for c in columns]
    tidy = df.select(F.col(layer).cast("string").alias("layer"), F.inline(F.array(*facts)))
    return tidy.where("number IS NOT NULL OR text IS NOT NULL")


def facts_gate(observed: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """State of every registered fact: agrees, differs, absent (the layer has no such fact) or no layer.

    ``expected`` may carry a ``tolerance`` of its own per fact.
    """
    own = F.coalesce("tolerance", F.lit(tolerance)) if "tolerance" in expected.columns else F.lit(tolerance)
    wanted = expected.select("layer", "fact", F.col("number").alias("expected_number"), F.col("text").alias("expected_text"), own.alias("_t"))
    there = observed.select("layer").distinct().withColumn("_layer", F.lit(True))
    joined = wanted.join(observed.withColumn("_seen", F.lit(True)), ["layer", "fact"], "left").join(there, "layer", "left")
    near = F.when(F.col("expected_number").isNotNull(), F.abs(F.col("number") - F.col("expected_number")) <= F.col("_t")).otherwise(
        F.col("text") == F.col("expected_text"))
    state = (
        F.when(F.col("_layer").isNull(), "no layer").when(F.col("_seen").isNull(), "absent")
        .when(F.coalesce(near, F.lit(False)), "agrees").otherwise("differs")
    )
    return joined.select("layer", "fact", "number", "text", "expected_number", "expected_text", state.alias("state"))


def gate_summary(states: DataFrame) -> DataFrame:
    """Per layer the number of facts, of those that agree, and whether all do."""
    agrees = F.col("state") == "agrees"
    return states.groupBy("layer").agg(F.count(F.lit(1)).alias("facts"), F.count_if(agrees).alias("agree"), F.bool_and(agrees).alias("ready"))
