"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` is connected with.

    Loops, repeated and reversed edges do no harm; an edge with a null end is
    ignored; no edges, no rows.  Each round moves every node's larger neighbours, then its
    smaller ones, to the smallest it knows; minima are aggregated before the
    shuffle and joined back (one row a node), so a hub is split like any skewed join side.
    Rounds go on until one changes nothing (about the logarithm of the longest path); each replaces the table before it.
    """
    now = written(
        edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where((F.col(a) != F.col(b))).distinct()
    )  # every edge leads from u to a smaller v
    nodes = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(a, b)).alias("node")).distinct()
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u != v").distinct(), instead_of=now)
        fresh = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if fresh == mark:
            break
        mark = fresh
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
