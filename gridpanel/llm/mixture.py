"""A time-varying curriculum: which documents of each source train when, and how often.

Each source's weight is a schedule over training time ``t`` in [0, 1],
``w(t) = target * (1 + slope * (2t - 1))``, whose integral over the whole run is the source's
target. Documents of a source stand in a fixed random order; a copy that begins after ``u``
words of the source's stream trains at the time when the integrated demand reaches ``u``. The
stream starts over until the target is met. Only built-in DataFrame functions are used.

Null texts have size 0 and are never taken. Rows with one ``doc_id`` are separate documents.
A null source is a source of its own, ordered last. Empty tables give no rows. Extra columns
pass through :func:`schedule`; columns it adds replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpanel.operators.prefix import prefix_sum, row_index
from gridpanel.session import materialize

#: Rows of one source that one window task orders.
ROWS_PER_BUCKET = 10_000
WORD = r"[^\x20\x09-\x0D]+"
#: Slopes of the weight schedules, repeated over the sources like their weights.
SLOPES = (0.5, 0.0, -0.5)

_KEY = ["_null", "_source"]


def words(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, weights: Sequence[float], slopes: Sequence[float], cap: float) -> DataFrame:
    """Add ``target`` and ``slope`` to one row per source with its ``_key`` columns and ``source_size``.

    Sources that reach ``cap`` times their size stop there and the rest is shared again by
    weight. In order of ``cap * size / weight`` the stopped sources come first, so one pass of
    prefix sums finds the level at which sharing ends.
    """
    ordered = row_index(totals, _KEY, name="_rank")
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("_rank") % len(values) + 1).cast("int"))
    weighed = ordered.select(
        *totals.columns, "_rank", cycle([float(w) for w in weights]).alias("_w"), cycle([float(s) for s in slopes]).alias("slope")
    ).withColumn("_full", F.col("source_size") * F.lit(float(cap)))
    weighed = materialize(weighed.withColumn("_ratio", F.col("_full") / F.col("_w")))
    whole = weighed.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("_w").alias("_weights"))
    sums = prefix_sum(weighed, ["_ratio", "_rank"], {"_before": F.col("_full"), "_spent": F.col("_w")})
    level = (F.col("_all") - F.col("_before")) / (F.col("_weights") - F.col("_spent"))
    found = (
        sums.join(F.broadcast(whole))  # one row
        .withColumn("_level", level)
        .where(F.col("_ratio") >= F.col("_level"))
        .agg(F.min(F.struct("_ratio", "_rank", "_level"))["_level"].alias("_level"))
    )
    target = F.least("_full", F.coalesce(F.col("_w") * F.col("_level"), F.col("_full")))
    return weighed.join(F.broadcast(found)).select(*totals.columns, target.alias("target"), "slope")


def schedule(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    slopes: Sequence[float] = SLOPES,
    cap: float = 3.0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``size, source_size, target, taken`` (words), and ``starts``, the copies with their time and words.

    A source's order is that of ``md5(doc_id)``; buckets of its leading digits bound how many
    rows one task orders, however large the source. Only the last copy of a source may be
    taken in part, so a source's taken words equal its target rounded down.
    """
    key = [F.col(source).isNull().alias("_null"), F.coalesce(F.col(source), F.lit("")).alias("_source")]
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    sized = docs.drop("size", "source_size", "target", "taken", "starts").withColumns({"size": words(F.col(text)), "_order": order})
    sized = sized.withColumns({"_null": key[0], "_source": key[1]})
    narrow = materialize(sized.select("_order", "size", *_KEY))
    rows = narrow.count()
    digits = max(1, min(12, math.ceil(math.log(max(rows / rows_per_bucket, 1), 16))))
    bucket = F.substring("_order", 1, digits).alias("_bucket")
    totals = narrow.groupBy(*_KEY, bucket).agg(F.sum("size").alias("_size"))
    totals = materialize(totals)
    sources = materialize(targets(totals.groupBy(*_KEY).agg(F.sum("_size").alias("source_size")), weights, slopes, cap))
    earlier = W.partitionBy(*_KEY).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*_KEY, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")).join(sources, _KEY)

    inside = W.partitionBy(*_KEY, "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_bucket", F.substring("_order", 1, digits)).join(offsets, [*_KEY, "_bucket"])
    placed = placed.withColumn("_begin", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    want = F.floor("target")
    rounds = F.when(
        (F.col("size") > 0) & (want > F.col("_begin")),
        F.sequence(F.lit(0).cast("long"), F.floor((want - F.col("_begin") - 1) / F.col("source_size"))),
    ).otherwise(F.array().cast("array<bigint>"))

    def copy(n: Column) -> Column:
        begin = n * F.col("source_size") + F.col("_begin")
        return F.struct(
            _time(begin / F.col("target"), F.col("slope")).alias("time"), F.least(F.col("size"), want - begin).alias("words")
        )

    placed = placed.withColumn("starts", F.transform(rounds, copy))
    taken = F.aggregate("starts", F.lit(0).cast("long"), lambda held, x: held + x["words"])
    return placed.withColumn("taken", taken).drop(*_KEY, "_bucket", "_order", "_offset", "_begin", "slope")


def _time(share: Column, slope: Column) -> Column:
    """The time at which the integrated weight, ``t + slope * (t^2 - t)``, reaches ``share``."""
    up = 1 - slope
    curved = (F.sqrt(up * up + 4 * slope * share) - up) / (2 * slope)
    return F.when(slope == 0, share).otherwise(curved)


def curriculum(docs: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents as they train: one row per copy, in order of training time.

    A source's last copy counts if at least half of its words are taken. The columns are
    those of ``docs``.
    """
    packed = docs.select("doc_id", F.col(source).alias("_from"), F.col(text).alias("_words"), F.struct(*docs.columns).alias("_row"))
    copies = schedule(packed, "_from", "_words", **options).withColumn("_copy", F.explode("starts"))
    copies = copies.where(2 * F.col("_copy.words") >= F.col("size"))
    return copies.orderBy("_copy.time", F.md5(F.col("doc_id").cast("string")), "doc_id").select("_row.*")
