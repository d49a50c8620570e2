"""Contract gates: every gate returns violation rows ``(gate, key, detail)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.contract import PanelContract, TimeDesign
from gridpanel.functions.years import cell_year_id, interval_lookup
from gridpanel.operators.compare import duplicate_keys, key_differences, schema_gate


def run_gates(df: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """All row rules in one aggregate over one scan: first key and count per broken rule.

    A rule is a boolean column that is true for a violating row; null counts as clean.
    """
    aggregates = []
    for i, rule in enumerate(rules.values()):
        aggregates += [F.count_if(rule).alias(f"n{i}"), F.min(F.when(rule, F.col(key).cast("string"))).alias(f"k{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("gate"), F.col(f"k{i}").alias("key"), F.concat(F.col(f"n{i}").cast("string"), F.lit(" rows")).alias("detail"), F.col(f"n{i}").alias("n"))
            for i, name in enumerate(rules)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows)).where("n > 0").drop("n")


def run_gates_by(df: DataFrame, rules: Mapping[str, Column], key: str, by: str) -> DataFrame:
    """:func:`run_gates` per value of ``by``, still in one aggregate over one scan; keys read ``by|key``."""
    aggregates, rows = [], []
    for i, (name, rule) in enumerate(rules.items()):
        aggregates += [F.count_if(rule).alias(f"n{i}"), F.min(F.when(rule, F.col(key).cast("string"))).alias(f"k{i}")]
        at = F.concat_ws("|", F.col(by).cast("string"), F.col(f"k{i}"))
        rows.append(F.struct(F.lit(name).alias("gate"), at.alias("key"), F.concat(F.col(f"n{i}").cast("string"), F.lit(" rows")).alias("detail"), F.col(f"n{i}").alias("n")))
    return df.groupBy(by).agg(*aggregates).select(F.inline(F.array(*rows))).where("n > 0").drop("n")


def ordering_gate(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows that do not follow the row stored before them, across partitions too; one row per first column of ``order``."""
    from gridpanel.operators.prefix import order_violations

    keyed = df.select(*order, F.struct(*order).alias("_order"))
    broken = order_violations(keyed, "_order").groupBy(order[0]).agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws("|", *[F.col(c).cast("string") for c in order])).alias("key"))
    return broken.select(F.lit("ordering").alias("gate"), "key", F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def count_gate(df: DataFrame, expected: int, name: str = "row_count") -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return counted.select(F.lit(name).alias("gate"), F.lit("table").alias("key"), F.concat(F.col("n").cast("string"), F.lit(f" instead of {expected}")).alias("detail"))


def unique_gate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    repeated = duplicate_keys(df, keys)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return repeated.select(F.lit("duplicate_key").alias("gate"), key.alias("key"), F.concat(F.col("copies").cast("string"), F.lit(" copies")).alias("detail"))


def key_set_gate(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return key_differences(expected, observed, keys).select(F.lit("key_set").alias("gate"), key.alias("key"), F.col("side").alias("detail"))


def all_violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def enforce(violations: DataFrame) -> None:
    """Raise with the first violations; at most ten rows reach the driver."""
    found = violations.limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r['gate']} {r['key']}: {r['detail']}" for r in found))


def _range_rules(contract: PanelContract, names: Sequence[str], tolerance: float) -> dict[str, Column]:
    rules: dict[str, Column] = {}
    every = {r.name: r for r in (*contract.features, contract.target)}
    for name in names:
        rule, c = every[name], F.col(name).cast("double")
        rules[f"null_{name}"] = F.col(name).isNull()
        rules[f"finite_{name}"] = F.isnan(c) | (F.abs(c) == float("inf"))
        if rule.minimum is not None:
            rules[f"below_{name}"] = c < rule.minimum - tolerance
        if rule.maximum is not None:
            rules[f"above_{name}"] = c > rule.maximum + tolerance
        if rule.integral:
            rules[f"integral_{name}"] = c != F.floor(c)
    return rules


def _time_rules(year: str, design: TimeDesign, metadata: bool = True) -> dict[str, Column]:
    t = F.col(year)
    rules = {"outcome_year": ~F.col("outcome_year").eqNullSafe(t + 1)}
    if metadata:
        rules |= {
            "history_start": ~F.col("historical_fire_start_year").eqNullSafe(t - design.history_length),
            "history_end": ~F.col("historical_fire_end_year").eqNullSafe(t - 1),
            "climate_year": ~F.col("climate_reference_year").eqNullSafe(t),
            "land_cover_year": ~F.col("land_cover_reference_year").eqNullSafe(interval_lookup(t, design.references)),
        }
    return rules


def joint_null_rule(cols: Sequence[str]) -> Column:
    """Some but not all of the columns are null."""
    nulls = [F.col(c).isNull().cast("int") for c in cols]
    total = reduce(lambda a, b: a + b, nulls)
    return (total > 0) & (total < len(cols))


def gate_panel(df: DataFrame, contract: PanelContract, design: TimeDesign, expected: DataFrame) -> DataFrame:
    """Schema, key, ids, time alignment, nulls, ranges and the joint climate mask."""
    names = [r.name for r in contract.features] + [contract.target.name]
    missing = [c for c in contract.columns if c not in df.columns]
    extra = [c for c in df.columns if c not in contract.columns]
    if missing or extra:
        rows = [("schema", c, "missing") for c in missing] + [("schema", c, "extra") for c in extra]
        return df.sparkSession.createDataFrame(rows, "gate string, key string, detail string")
    rules = _range_rules(contract, names, contract.tolerance) | _time_rules(contract.year, design)
    rules["cell_year_id"] = ~F.col("cell_year_id").eqNullSafe(cell_year_id(contract.cell, contract.year))
    climate = contract.joint_null_columns()
    if len(climate) > 1:
        rules["joint_climate_mask"] = joint_null_rule(climate)
    return all_violations(
        [run_gates(df, rules, "cell_year_id"), unique_gate(df, contract.key), key_set_gate(expected, df, contract.key)]
    )


def gate_model_frame(df: DataFrame, contract: PanelContract, design: TimeDesign, years: Sequence[int]) -> DataFrame:
    """Exactly the declared years, strict ranges, unique keys and aligned source years."""
    names = [r.name for r in contract.features] + [contract.target.name]
    rules = _range_rules(contract, names, 0.0) | _time_rules(contract.year, design)
    rules["undeclared_year"] = ~F.col(contract.year).isin([int(y) for y in years])
    return all_violations([run_gates(df, rules, contract.cell), unique_gate(df, contract.key), year_set_gate(df, contract.year, years)])


def year_set_gate(df: DataFrame, year: str, years: Sequence[int]) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(int(y),) for y in years], f"{year} int")
    return key_set_gate(wanted, df.select(F.col(year).cast("int").alias(year)), [year]).withColumn("gate", F.lit("year_set"))


def gate_scoring(df: DataFrame, contract: PanelContract, design: TimeDesign, forecast_year: int, cells: DataFrame) -> DataFrame:
    """One row per cell, no target, temporal fields of ``forecast_year - 1`` and legal features."""
    rules = _range_rules(contract, contract.feature_names, 0.0) | _time_rules(contract.year, design)
    rules["predictor_year"] = ~F.col(contract.year).eqNullSafe(F.lit(forecast_year - 1))
    parts = [run_gates(df, rules, contract.cell), unique_gate(df, [contract.cell]), key_set_gate(cells, df, [contract.cell])]
    if contract.target.name in df.columns:
        parts.append(
            df.sparkSession.createDataFrame([("target_present", contract.target.name, "must be absent")], "gate string, key string, detail string")
        )
    return all_violations(parts)


def forbidden_fields(df: DataFrame, names: Sequence[str] = (), tokens: Sequence[str] = ()) -> DataFrame:
    """Columns that are listed or whose name contains a token, whatever the case."""
    banned = {n.lower() for n in names}
    rows = [
        ("forbidden_field", c, "listed" if c.lower() in banned else "token")
        for c in df.columns
        if c.lower() in banned or any(t.lower() in c.lower() for t in tokens)
    ]
    return df.sparkSession.createDataFrame(rows, "gate string, key string, detail string")


def gate_forecast(
    scores: DataFrame, cells: DataFrame, repeated: DataFrame, forecast_year: int, schema: Sequence[tuple[str, str]],
    estimate: str = "estimate", rank: str = "rank_pct",
) -> DataFrame:
    """Score schema, identity, ranges and equality with a repeated prediction."""
    rules = {
        "forecast_year": ~F.col("forecast_year").eqNullSafe(F.lit(forecast_year)),
        "input_year": ~F.col("prediction_input_year").eqNullSafe(F.lit(forecast_year - 1)),
        "estimate_null": F.col(estimate).isNull() | F.isnan(estimate),
        "estimate_range": (F.col(estimate) < 0) | (F.col(estimate) > 1),
        "rank_range": (F.col(rank) <= 0) | (F.col(rank) > 1),
    }
    again = scores.select("cell_id", estimate).join(repeated.select("cell_id", F.col(estimate).alias("_again")), "cell_id", "left")
    changed = again.where(~F.col(estimate).eqNullSafe(F.col("_again"))).select(
        F.lit("prediction_changed").alias("gate"), F.col("cell_id").alias("key"), F.col("_again").cast("string").alias("detail")
    )
    return all_violations(
        [schema_gate(scores, schema), run_gates(scores, rules, "cell_id"), unique_gate(scores, ["cell_id"]),
         key_set_gate(cells, scores, ["cell_id"]), changed]
    )


# Fields a descriptive table must not carry, and tokens that mark a prediction.
PREDICTIVE_NAMES = ("burned_share_next_year", "score_status", "model_sha256")
PREDICTIVE_TOKENS = ("predict", "forecast", "probability", "percentile", "model")


def gate_screening(table: DataFrame, cells: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """No predictive fields, one row per cell, legal bands and shares, attributes equal to the source."""
    rules = {
        "band": ~F.col("historical_exposure_band").isin("lower", "moderate", "higher"),
        "band_null": F.col("historical_exposure_band").isNull(),
        "coverage": (F.col("coverage_share") < 0) | (F.col("coverage_share") > 1),
        "modal_share": (F.col("modal_share") < 0) | (F.col("modal_share") > 1),
        "unmatched_code": (F.col("hazard_class") == "unmatched") & (F.col("modal_code") != -1),
    }
    parts = [
        forbidden_fields(table, PREDICTIVE_NAMES, PREDICTIVE_TOKENS), run_gates(table, rules, "cell_id"),
        unique_gate(table, ["cell_id"]), key_set_gate(cells, table, ["cell_id"]),
    ]
    if original is not None:
        from gridpanel.operators.compare import frame_differences

        parts.append(
            frame_differences(original, table).select(
                F.lit("attributes").alias("gate"), F.col("cell_id").alias("key"), F.col("side").alias("detail")
            )
        )
    return all_violations(parts)


def gate_scores_layer(df: DataFrame, required: Sequence[str], forecast_year: int, statuses: Sequence[str]) -> DataFrame:
    """Required columns, aligned years, known status and ranges of a published score layer."""
    missing = [(("required_column"), c, "missing") for c in required if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame(missing, "gate string, key string, detail string")
    return run_gates(
        df,
        {
            "forecast_year": F.col("forecast_year") != forecast_year,
            "input_year": F.col("prediction_input_year") != forecast_year - 1,
            "status": ~F.col("score_status").isin(list(statuses)),
            "estimate": (F.col("estimate") < 0) | (F.col("estimate") > 1),
            "rank": (F.col("rank_pct") <= 0) | (F.col("rank_pct") > 1),
        },
        "cell_id",
    )


def gate_screening_layer(df: DataFrame, first: int, last: int) -> DataFrame:
    return run_gates(
        df,
        {
            "window_start": F.col("history_start_year") != first,
            "window_end": F.col("history_end_year") != last,
            "window_length": F.col("history_end_year") - F.col("history_start_year") != last - first,
        },
        "cell_id",
    )


def gate_national(
    df: DataFrame, climate: Sequence[str], others: Sequence[str], cell: str, year: str, mask_by: Column | None = None
) -> DataFrame:
    """Climate is null for all columns or none, for the same cells every year; nothing else is null.

    ``mask_by`` is the id whose mask must not move, ``cell`` itself if it is not given.
    """
    rules = {"joint_climate_mask": joint_null_rule(climate)}
    rules |= {f"null_{c}": F.col(c).isNull() for c in others}
    masked = F.col(climate[0]).isNull()
    # a cell masked in some of its years only is unstable
    place = (F.col(cell) if mask_by is None else mask_by).cast("string")
    moving = df.groupBy(place.alias("key")).agg(F.count_if(masked).alias("m"), F.count(F.lit(1)).alias("n")).where("m > 0 AND m < n")
    unstable = moving.select(
        F.lit("moving_mask").alias("gate"), "key",
        F.concat_ws(" of ", F.col("m").cast("string"), F.col("n").cast("string")).alias("detail"),
    )
    return all_violations([run_gates(df, rules, cell), unstable, unique_gate(df, [cell, year])])


def gate_national_panel(
    df: DataFrame, contract: PanelContract, design: TimeDesign, expected: DataFrame, mask_by: Column | None = None
) -> DataFrame:
    """The panel gate per year, the stored order by year and cell, and the same climate mask in every year.

    All row rules of all years are one aggregate; schema, keys and the expected set are as in :func:`gate_panel`.
    """
    missing = [c for c in contract.columns if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([("schema", c, "missing") for c in missing], "gate string, key string, detail string")
    climate = contract.joint_null_columns()
    names = [r.name for r in contract.features if r.name not in climate] + [contract.target.name]
    rules = _range_rules(contract, names, contract.tolerance) | _time_rules(contract.year, design)
    # null climate is a mask, not a fault, as long as it is joint
    rules |= {n: r for n, r in _range_rules(contract, climate, contract.tolerance).items() if not n.startswith("null_")}
    parts = [run_gates_by(df, rules, contract.cell, contract.year), ordering_gate(df, [contract.year, contract.cell]), key_set_gate(expected, df, contract.key)]
    if climate:
        parts.append(gate_national(df, climate, [], contract.cell, contract.year, mask_by))
    return all_violations(parts)


def gate_artefacts(spark, folder: str, expected: Sequence[str]) -> DataFrame:
    """A published folder against the names it must hold: missing, half-written, extra and altered artefacts.

    Names are metadata of a bounded set; contents are compared with their manifests by distributed checksums.
    """
    from gridpanel.sinks.publish import listed, verify_published

    there = set(listed(spark, folder))
    rows, parts = [], []
    for name in expected:
        data, manifest = name in there, f"{name}.manifest.json" in there
        if data and manifest:
            broken = verify_published(spark, f"{folder}/{name}")
            parts.append(broken.select(F.lit("altered_artefact").alias("gate"), F.lit(name).alias("key"), F.lit("content differs from its manifest").alias("detail")))
        elif data or manifest:
            rows.append(("half_written", name, "no manifest" if data else "no data"))
        else:
            rows.append(("missing_artefact", name, "absent"))
    known = {*expected, *[f"{n}.manifest.json" for n in expected]}
    rows += [("extra_artefact", n, "not expected") for n in sorted(there - known)]
    return all_violations([spark.createDataFrame(rows, "gate string, key string, detail string"), *parts])


def gate_forecast_set(spark, folder: str, contract: PanelContract, design: TimeDesign, forecast_year: int, cells: DataFrame, matrix: str = "matrix", scores: str = "scores", others: Sequence[str] = ()) -> DataFrame:
    """The whole published forecast: its artefacts, the scoring matrix, and one score for every row of the matrix."""
    found = gate_artefacts(spark, folder, [matrix, scores, *others])
    if not found.isEmpty():
        return found
    rows, told = spark.read.parquet(f"{folder}/{matrix}"), spark.read.parquet(f"{folder}/{scores}")
    return all_violations([gate_scoring(rows, contract, design, forecast_year, cells), key_set_gate(rows.select("cell_id"), told, ["cell_id"]), unique_gate(told, ["cell_id"])])


def gate_source_matrix(df: DataFrame, required: Sequence[str], year: str, years: Sequence[int]) -> DataFrame:
    missing = [("required_column", c, "missing") for c in required if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame(missing, "gate string, key string, detail string")
    return year_set_gate(df, year, years)


def gate_grid(cells: DataFrame, expected: int, size: float) -> DataFrame:
    """Expected count, unique ids and positions, and squares snapped to the cell size."""
    rules = {
        "snapped_x": F.col("x0") % int(size) != 0, "snapped_y": F.col("y0") % int(size) != 0,
        "null_id": F.col("cell_id").isNull(),
    }
    return all_violations(
        [count_gate(cells, expected), run_gates(cells, rules, "cell_id"), unique_gate(cells, ["cell_id"]), unique_gate(cells, ["ix", "iy"])]
    )


def gate_reference(regions: DataFrame, expected: int, key: str = "region_id") -> DataFrame:
    """Expected number of unique regions with a usable ring each."""
    ring = F.col("rings")
    rules = {"empty": ring.isNull() | (F.size(ring) == 0), "open_ring": F.exists(ring, lambda r: r[0] != F.element_at(r, -1))}
    return all_violations([count_gate(regions, expected), run_gates(regions, rules, key), unique_gate(regions, [key])])


def gate_predictions(df: DataFrame, columns: Sequence[str], year: str, held_out: Sequence[int] = ()) -> DataFrame:
    """Exact prediction columns, T+1 rule and no held-out rows."""
    if list(df.columns) != list(columns):
        rows = [("columns", ",".join(df.columns), ",".join(columns))]
        return df.sparkSession.createDataFrame(rows, "gate string, key string, detail string")
    rules = {"outcome_year": F.col("outcome_year") != F.col(year) + 1}
    if held_out:
        rules["held_out_row"] = F.col(year).isin([int(y) for y in held_out])
    return run_gates(df, rules, "cell_id")


def gate_mapping(mapping: DataFrame, affected: DataFrame) -> DataFrame:
    """The fallback mapping holds exactly the affected cells, each once."""
    return all_violations([unique_gate(mapping, ["cell_id"]), key_set_gate(affected, mapping, ["cell_id"])])
