"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import discard
from .session import passing_shuffles, settled


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest id that links reach.

    Alternating star contraction: every node tells its larger neighbours the smallest
    id around it, then its smaller ones, until nothing changes.  Each round is a
    grouped minimum, combined before the shuffle, and a join that splits skewed nodes;
    its links are written, so lineage stays short.  The driver sees two numbers a round.
    """
    edges = settled(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, settled(_down(small.unionByName(down.withColumnRenamed("m", "v"))), "links")
        discard(last)
        with passing_shuffles(edges.sparkSession):
            state = edges.agg(F.count(F.lit(1)), F.expr("sum(CAST(xxhash64(u, v) AS DECIMAL(38, 0)))")).first()
        if state == before:
            break
        before = state
    # All links are stars now; their centres are components of their own names.
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def _down(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller id."""
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
