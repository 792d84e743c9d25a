"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `edges` (a, b): root is the smallest node they are connected with.

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour, until nothing changes. A node's edges needn't meet in one task: its smallest neighbour
    is found by partial sums, and the join that brings it back to them can be split, as the smallest
    neighbours are dealt anew before it.
    """

    def dealt(least: DataFrame) -> DataFrame:
        return least.repartition(F.xxhash64("u"))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
            tied = both.where("b > a").join(dealt(least), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # edges have a > b here
            least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
            ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
            tied = e.join(dealt(least), F.col("a") == F.col("u")).select(ends).select("x.a", "x.b")
        return tied.where("a > b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before, now = None, state(e)
    while now != before:
        e = cut(star(star(e, True), False), now[0])  # stars don't add edges
        before, now = now, state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
