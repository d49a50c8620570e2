"""Descriptive statistics of a panel: tidy, exact and one pass per table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.prefix import exact_quantiles

DESCRIBE_PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _long(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(
        [F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in cols], "column", "value"
    )


def moments(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, missing, extremes, mean, sample deviation and zeros per group and column."""
    v = F.col("value")
    return _long(df, by, cols).groupBy(*by, "column").agg(
        F.count(v).alias("count"),
        F.count_if(v.isNull()).alias("missing"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("standard_deviation"),
        F.count_if(v == 0).alias("zero_count"),
    )


def describe(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    quantiles = exact_quantiles(df, cols, DESCRIBE_PROBS, by).drop("n")
    return moments(df, by, cols).join(quantiles, [*by, "column"], "left")


def year_metrics(df: DataFrame, year: str, cell: str, cols: Sequence[str], target: str) -> DataFrame:
    """One wide row per year: rows, nulls and range per column, positives and target quantiles."""
    t = F.col(target)
    ranges: list[Column] = []
    for c in [*cols, target]:
        ranges += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    base = df.groupBy(year).agg(
        F.count(F.lit(1)).alias("row_count"), *ranges,
        F.count_if(t > 0).alias("positive_rows"),
        F.avg((t == 0).cast("double")).alias("zero_share"),
        F.avg(t).alias("target_mean"),
    )
    cells = (
        df.where(t > 0).groupBy(year, cell).agg(F.lit(1).alias("one"))
        .groupBy(year).agg(F.count("one").alias("positive_cells"))
    )
    probs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    quantiles = exact_quantiles(df, [target], probs, [year]).drop("column", "n")
    return base.join(cells, year, "left").join(quantiles, year, "left").withColumn(
        "positive_cells", F.coalesce("positive_cells", F.lit(0))
    )


def target_by_year(df: DataFrame, year: str, target: str) -> DataFrame:
    t = F.col(target)
    base = df.groupBy(year).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg((t == 0).cast("double")).alias("zero_share"),
        F.count_if(t > 0).alias("positive_count"),
        F.avg(t).alias("mean"),
        F.max(t).alias("maximum"),
    )
    every = exact_quantiles(df, [target], {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, [year])
    positive = exact_quantiles(df.where(t > 0), [target], {"positive_median": 0.5, "positive_p90": 0.9}, [year])
    return base.join(every.drop("column", "n"), year, "left").join(positive.drop("column", "n"), year, "left")


def means_by_year(df: DataFrame, year: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(year).agg(*[F.avg(c).alias(c) for c in cols])


def standardized_difference(df: DataFrame, split: str, cols: Sequence[str], base: str = "train") -> DataFrame:
    """Shift of each split's mean in units of the base split's sample deviation."""
    per = moments(df, [split], cols).select(split, "column", "mean", "standard_deviation")
    reference = per.where(F.col(split) == base).select(
        "column", F.col("mean").alias("_m"), F.col("standard_deviation").alias("_s")
    )
    return per.where(F.col(split) != base).join(reference, "column").select(
        split, "column", ((F.col("mean") - F.col("_m")) / F.col("_s")).alias("smd")
    )


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair as rows, from one aggregate."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.inline(rows))


def redundant_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    return correlations(df, cols).where(F.abs("correlation") >= threshold)


def iqr_outliers(df: DataFrame, split: str, cols: Sequence[str], base: str = "train", k: float = 3.0) -> DataFrame:
    """Rows strictly outside the base split's quartile fences, per split and column."""
    q = exact_quantiles(df.where(F.col(split) == base), cols, {"q1": 0.25, "q3": 0.75}).select(
        "column", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"),
    )
    # one row per column name: bounded by the schema
    long = _long(df, [split], cols).join(F.broadcast(q), "column")
    return long.groupBy(split, "column").agg(
        F.first("lower").alias("lower"), F.first("upper").alias("upper"),
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("outliers"),
    )


def split_counts(df: DataFrame, split: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("row_count"))


def distribution(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Count and share of every class of a fixed list, absent classes with zero."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    wanted = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(order)], f"position int, {col} string")
    n = F.coalesce(F.col("n"), F.lit(0))
    return wanted.join(counts, col, "left").select("position", col, n.alias("cell_count"), (n / total).alias("share_of_cells"))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Pair counts with their share of all rows and of the row class."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("cell_count"))
    within = counts.groupBy(row).agg(F.sum("cell_count").alias("_row"))
    total = counts.agg(F.sum("cell_count")).scalar()
    return counts.join(within, row).select(
        row, col, "cell_count",
        (F.col("cell_count") / total).alias("share_of_all_cells"),
        (F.col("cell_count") / F.col("_row")).alias("share_within_row"),
    )


def crosstab_matrix(df: DataFrame, row: str, col: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, list(order)).count().fillna(0, list(order))


def agreement_share(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows where two broad levels agree, among rows that have both."""
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    same = both & (F.col(left) == F.col(right))
    return df.agg(
        F.count_if(both).alias("matched"), F.count_if(same).alias("agreeing"),
        F.try_divide(F.count_if(same), F.count_if(both)).alias("agreement_share"),
    )


def residual_quartiles(df: DataFrame, year: str, target: str, score: str) -> DataFrame:
    residual = df.withColumn("residual", F.col(score) - F.col(target))
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return exact_quantiles(residual, ["residual"], probs, [year]).drop("column")


def bin_counts(df: DataFrame, x: str, y: str, bins: int = 55) -> DataFrame:
    """Square 2-D bins of two shares with their log count."""
    slot = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(slot(x).alias("bx"), slot(y).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("log10_n", F.log10("n"))


def coverage_counts(tables: dict[str, DataFrame], count: str, expected: int | Column) -> DataFrame:
    """Sum of each summary table beside the size of the grid it must add up to."""
    parts = None
    for name, df in tables.items():
        row = df.groupBy(F.lit(name).alias("table")).agg(F.sum(count).alias("total"))
        parts = row if parts is None else parts.unionByName(row)
    size = expected if isinstance(expected, Column) else F.lit(expected)
    return parts.withColumn("complete", F.col("total") == size)
