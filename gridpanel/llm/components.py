"""Connected components by repeated hooking and pointer jumping, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.session import written

#: Sides are never gathered on the driver: the many small broadcasts of a loop would fill its memory.
JOIN = "merge"


def kept(df: DataFrame) -> DataFrame:
    """Write and read again: unlike a checkpoint, the table read carries no constraints of its origin.

    In a loop these would multiply from round to round, and planning with them.
    """
    return written(df, "components")


def _up(table: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace every ``parent`` of ``table`` by its own parent, if it has one."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up")).hint(JOIN)
    return table.join(above, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges`` ``(a, b)``; a component is its smallest node.

    Each round hooks every root with an edge to a smaller root under the smallest of these,
    shortens the chains to a fourth, and draws the edges anew between the roots that remain, so
    the edge table shrinks. What a chain still has above its shortened end stays as an edge. No
    group is collected: hubs meet in partial aggregates. Loops and repeated edges do no harm;
    edges with a null end are ignored.
    """
    every = kept(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = every.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    open_, turn = every.where("a <> b"), 0
    while not open_.isEmpty():
        first = kept(open_.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        parents = kept(_up(_up(first, first), _up(first, first)))
        root = parents.select(F.col("node").alias("component"), F.col("parent").alias("_root")).hint(JOIN)
        labels = labels.join(root, "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
        ends = open_
        for end in ("a", "b"):
            to = parents.select(F.col("node").alias(end), F.col("parent").alias(f"_{end}")).hint(JOIN)
            ends = ends.join(to, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        above = parents.select(F.col("parent").alias("node")).distinct().join(parents.hint(JOIN), "node").select(F.col("node").alias("a"), F.col("parent").alias("b"))
        ends = ends.select("a", "b").unionByName(above)
        open_ = kept(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        turn += 1
        if turn % 4 == 0:
            labels = kept(labels)
    return kept(labels)
