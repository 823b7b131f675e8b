"""Connected components by alternating large-star and small-star steps.

Edges are tables; nothing about the whole graph is ever held in one place. Each
step links nodes to the smallest neighbour, so a hub's neighbours are folded
into a minimum (an aggregate) and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlattice.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b: each end is linked to the smallest around it."""
    back = F.struct(F.col("b").alias("x"), F.col("a").alias("y"))
    forth = F.struct(F.col("a").alias("x"), F.col("b").alias("y"))
    both = edges.select(F.explode(F.array(forth, back)).alias("_e")).select("_e.*") if large else edges.select(
        F.col("a").alias("x"), F.col("b").alias("y")
    )
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    linked = both.join(least, "x")
    if large:
        # Larger neighbours of x now hang on the smallest around x.
        out = linked.filter(F.col("y") > F.col("x")).select(F.col("y").alias("a"), F.col("m").alias("b"))
    else:
        # x and its smaller neighbours hang on the smallest of them.
        out = linked.select(
            F.explode(
                F.array(F.struct(F.col("y").alias("a"), F.col("m").alias("b")), F.struct(F.col("x").alias("a"), F.col("m").alias("b")))
            ).alias("_e")
        ).select("_e.*")
    return out.filter("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has a link and the smallest node it can reach.

    Links with a null end and loops are left out; repeated links count once. An
    empty table gives no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    links = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    links = cut_lineage(links.distinct())
    state = _state(links)
    while state[0]:
        links = cut_lineage(_star(_star(links, large=True), large=False))
        after = _state(links)
        if after == state:
            break
        state = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
