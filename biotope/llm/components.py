"""Connected components of an edge table by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.session import materialize


def _step(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: link the neighbours of a node to the smallest of them.

    ``larger`` links only neighbours above the node, else those below it. The minimum is a partial
    aggregate joined back to the edges, so a node with very many neighbours is never gathered.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps; each round is written to the shared folder. It ends
    when a round changes nothing, after a number of rounds that grows with the logarithm of the
    component sizes. Self-links and repeated edges are allowed; an empty table gives an empty table.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    while seen[0]:
        now = materialize(_step(_step(now, True), False), "edges")
        new = print_of(now)
        if new == seen:
            break
        seen = new
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
