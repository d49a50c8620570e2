"""Joins that survive keys holding a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.session import broadcast_if_small, materialize

ROWS_PER_SPLIT = 2_000_000


def hot_keys(counts: DataFrame, on: Sequence[str], n_col: str, rows_per_split: int) -> DataFrame:
    """Keys above ``rows_per_split`` rows with the number of splits each needs."""
    return counts.where(F.col(n_col) > rows_per_split).select(
        *on, F.ceil(F.col(n_col) / F.lit(rows_per_split)).cast("int").alias("_splits")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    key_counts: DataFrame | None = None,
    n_col: str = "_n",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Equi-join whose hot left keys are split over several tasks.

    Only keys above ``rows_per_split`` are salted: their right rows are copied once
    per split and their left rows are spread by a hash of the whole row, so a retry
    puts every row back in the same split. The number of hot keys is at most
    ``rows / rows_per_split``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot split the right side of a {how} join")
    on = list(on)
    if key_counts is None:
        key_counts, n_col = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "_n"
    hot = materialize(hot_keys(key_counts, on, n_col, rows_per_split))
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = broadcast_if_small(hot)
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    columns = left.columns
    salted_left = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*columns), splits).cast("int"))
        .drop("_splits")
    )
    salted_right = (
        right.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


#: Rows of one packed group.
ROWS_PER_PACK = 1000


def packed(df: DataFrame, by: Sequence[str], rows: str, per_pack: int = ROWS_PER_PACK) -> DataFrame:
    """Rows that agree in ``by`` as one row with the array ``rows`` of their other columns.

    A join then meets the copies of one value once and explodes them where they met, without another shuffle.
    A value with more than ``per_pack`` copies becomes several rows.
    """
    by = list(by)
    others = [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(hot_keys(counts, by, "_n", per_pack))
    split = df.withColumn("_pack", F.lit(0))
    if not hot.isEmpty():
        split = df.join(broadcast_if_small(hot), by, "left").withColumn(
            "_pack", F.pmod(F.xxhash64(*others), F.coalesce("_splits", F.lit(1))).cast("int")
        )
    return split.groupBy(*by, "_pack").agg(F.collect_list(F.struct(*others)).alias(rows)).drop("_pack")


def classes(df: DataFrame, by: Sequence[str], number: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values of ``by`` with a ``number``, and all rows with the number instead of ``by``; rows with a null there are left out."""
    by = list(by)
    counts = df.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    values = materialize(counts.withColumn(number, F.monotonically_increasing_id()))
    others = [c for c in df.columns if c not in by]
    # the join sorts by a hash, as comparing whole values is slow; equal hashes are then compared in full
    hashed = values.select(F.xxhash64(*by).alias("_hash"), number, "_n", *[F.col(c).alias(f"_v_{c}") for c in by])
    sizes = hashed.groupBy("_hash").agg(F.sum("_n").alias("_n"))
    met = salted_join(df.withColumn("_hash", F.xxhash64(*by)), hashed.drop("_n"), ["_hash"], key_counts=sizes)
    rows = met.where(reduce(and_, [F.col(c) == F.col(f"_v_{c}") for c in by])).select(*others, number)
    return values.drop("_n"), materialize(rows)
