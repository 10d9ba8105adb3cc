"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import drop, lookup, materialize

#: Edges are two longs: this many fit one task with room to spare, so hubs are treated as hot only beyond.
SMALL_EDGES = 1_000_000


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """The named pairs of columns of each row, as rows."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))))


def _shape(e: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep ``e`` from being stars around each component's smallest node."""
    ends = e.select(F.col("hi").alias("u"), F.lit(1).alias("up")).unionByName(e.select(F.col("lo").alias("u"), F.lit(0).alias("up")))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("up"))
    n, crossed = nodes.agg(F.sum("ups"), F.count_if(F.expr("ups > 1 OR (ups = 1 AND up = 0)"))).first()
    return n or 0, crossed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the component's smallest node.

    Edges are two long columns; direction, repeats and loops don't matter, nulls are ignored.
    Each round is written to the shared folder, where it replaces the one before. Nothing but two numbers comes to the driver.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    e = materialize(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges")
    while True:
        n, crossed = _shape(e)
        if not crossed:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        both = _each(e, ("hi", "lo"), ("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # Repeats are few and go with the small star.
        linked = lookup(both, least, "u", "n", 2 * n, SMALL_EDGES).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(linked.where("hi != lo"), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        star = lookup(large, least, "hi", "n", 2 * n, SMALL_EDGES)
        small = _each(star, ("lo", "m"), ("hi", "m")).toDF("hi", "lo").where("hi != lo")
        new = materialize(small.distinct(), "small")
        drop(e, large)
        e = new
