"""Connected components by alternating large-star and small-star steps, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, join_hot, keep_until_exit, stored


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of u."""
    return join_hot(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (two long columns); component is the smallest node of its own.

    Every round is one job that writes its edges; links, stars and labels never reach the driver, only a count and a
    checksum. A star's centre is joined, not gathered, and centres with over a thousandth of all edges are broadcast (there
    are 2,000 at most), so no component has to fit into one task.

    Edges with a null end are no edges; repeated edges and both directions are one; an edge from a node to itself names no
    node. Without edges there are no rows.
    """
    a, b = edges.columns
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), keep=False)
    before = None
    while True:
        check = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if check == before or not check[0]:
            break
        before = check
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, check[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = _with_least(large, check[0])
        new = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        new = stored(new, keep=False)
        drop_stored(now)
        now = new
    keep_until_exit(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
