"""Global order without a one-task window: prefix sums, ranks, exact quantiles.

Every operator first aggregates to one row per distinct order key (map-side
combine takes care of ties that hold a large part of the rows), range-partitions
those keys, and adds the totals of earlier partitions to a partition-local window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpanel.operators.skew import salted_join
from gridpanel.session import materialize


def _order(keys: Sequence[str]) -> list[Column]:
    """``"-name"`` means descending."""
    return [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]


def prefix_sum(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Exclusive running sums over a total order, optionally restarted per ``by`` group.

    ``order`` must be unique within ``by``; callers aggregate ties first. The range
    partition id is stored in a reliable checkpoint, so a lost executor cannot move
    rows between partitions after the offsets were taken.
    """
    by = list(by)
    valued = df
    for name, value in sums.items():
        valued = valued.withColumn(f"_v_{name}", value)
    ranged = materialize(
        valued.repartitionByRange(*[F.col(c) for c in by], *_order(order)).withColumn(
            "_pid", F.spark_partition_id()
        )
    )
    totals = ranged.groupBy(*by, "_pid").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    # one row per range partition and group, never one row per input row
    earlier = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_pid", *[F.sum(f"_t_{name}").over(earlier).alias(f"_o_{name}") for name in sums]
    )
    local = W.partitionBy(*by, "_pid").orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, -1)
    result = ranged.select(
        "*", *[F.sum(f"_v_{name}").over(local).alias(f"_l_{name}") for name in sums]
    ).join(offsets, [*by, "_pid"])
    for name in sums:
        total = F.coalesce(F.col(f"_o_{name}"), F.lit(0)) + F.coalesce(F.col(f"_l_{name}"), F.lit(0))
        result = result.withColumn(name, total)
    return result.select(*df.columns, *sums)


def row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Zero-based position in a total order (``order`` unique within ``by``)."""
    return prefix_sum(df, order, {name: F.lit(1).cast("bigint")}, by)


def rank_pct(df: DataFrame, col: str, out: str = "rank_pct") -> DataFrame:
    """Average rank of ties divided by the number of non-null values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    ranks = prefix_sum(counts, [col], {"_before": F.col("_n")}).select(
        col, ((F.col("_before") + (F.col("_n") + 1) / 2.0) / total).alias(out)
    )
    return salted_join(df, ranks, [col], "left", key_counts=counts).select(*df.columns, out)


def value_histogram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long histogram ``(by…, column, value, n)`` of the non-null values."""
    long = df.unpivot(
        [F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in cols], "column", "value"
    ).where(F.col("value").isNotNull())
    return long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _picked(ranked: DataFrame, keys: Sequence[str], positions: Mapping[str, Column]) -> DataFrame:
    """Value found at each zero-based position, one conditional aggregate per position."""
    def at(position: Column) -> Column:
        return (F.col("_before") <= position) & (position < F.col("_before") + F.col("n"))

    return ranked.groupBy(*keys).agg(
        F.first("_total").alias("n"),
        *[F.max(F.when(at(p), F.col("value"))).alias(name) for name, p in positions.items()],
    )


def _ranked_histogram(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = [*by, "column"]
    histogram = value_histogram(df, cols, by)
    totals = histogram.groupBy(*keys).agg(F.sum("n").alias("_total"))
    ranked = prefix_sum(histogram, ["value"], {"_before": F.col("n")}, keys)
    return ranked.join(totals, keys), keys


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per group and column, exact at any group size."""
    ranked, keys = _ranked_histogram(df, cols, by)
    positions = {}
    for name, q in probs.items():
        exact = F.lit(float(q)) * (F.col("_total") - 1)
        positions[f"_lo_{name}"] = F.floor(exact)
        positions[f"_hi_{name}"] = F.ceil(exact)
    picked = _picked(ranked, keys, positions)
    out = []
    for name, q in probs.items():
        exact = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return picked.select(*keys, "n", *out)


def nearest_rank_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles picked at the half-even rounded index ``q * (n - 1)``."""
    ranked, keys = _ranked_histogram(df, cols, by)
    positions = {name: F.rint(F.lit(float(q)) * (F.col("_total") - 1)) for name, q in probs.items()}
    return _picked(ranked, keys, positions)


def top_k(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The k first rows; ``order`` must include the key as tie-break."""
    return df.orderBy(*_order(order)).limit(k)


def order_picks(df: DataFrame, order: Sequence[str], tail: int = 5) -> DataFrame:
    """Rows at positions 0, n/4, n/2, 3n/4, n-1 and the last ``tail`` of the order."""
    total = df.agg(F.count(F.lit(1))).scalar()
    indexed = row_index(df, order)
    position = F.col("row_index")
    marks = [F.lit(0), F.floor(total / 4), F.floor(total / 2), F.floor(total * 3 / 4), total - 1]
    wanted = position >= total - F.lit(tail)
    for mark in marks:
        wanted = wanted | (position == mark)
    return indexed.where(wanted)


def even_sample(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Rows at the truncated positions of ``size`` evenly spaced points of the order."""
    if size < 2:
        raise ValueError("an even sample needs at least two positions")
    total = df.agg(F.count(F.lit(1))).scalar()
    indexed = row_index(df, order)
    step = F.when(total > size, total - 1).otherwise(F.lit(size - 1))
    # smallest i whose position could reach this row; keep the row when it does
    i = F.ceil(F.col("row_index") * (size - 1) / step)
    return indexed.where(F.floor(i * step / (size - 1)) == F.col("row_index"))


def stratified_sample(
    df: DataFrame, stratum: str, n: int, key: Sequence[str], seed: int = 0
) -> DataFrame:
    """``n`` rows per stratum chosen by a seeded hash of the key, in key order."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in key]))
    picked = row_index(hashed, ["_h", *key], [stratum]).where(F.col("row_index") < n)
    return picked.select(*df.columns)


def canonical_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partitioned and sorted within partitions: a total order without one task."""
    return df.repartitionByRange(*_order(order)).sortWithinPartitions(*_order(order))


def order_violations(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is not greater than the key stored before it, also across partitions.

    Within a partition the rows are compared in stored order; of every partition the first
    row is compared with the last row of the partitions before it.
    """
    stored = materialize(df.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    before = F.lag(key).over(W.partitionBy("_pid", *by).orderBy("_pos"))
    inside = stored.withColumn("_prev", before).where(F.col("_prev") >= F.col(key))
    # one row per partition and group
    ends = stored.groupBy("_pid", *by).agg(F.min("_pos").alias("_pos"), F.max_by(key, "_pos").alias("_last"))
    ends = ends.withColumn("_prev", F.lag("_last").over(W.partitionBy(*by).orderBy("_pid"))).select("_pos", "_prev")
    across = stored.join(ends, "_pos").where(F.col("_prev") >= F.col(key))
    return inside.select(*df.columns).unionByName(across.select(*df.columns))
