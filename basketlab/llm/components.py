"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.session import materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node in ``edges``; the component is its
    smallest node. Edges with a null end are ignored, loops only name a node.

    Each round joins the edges with one minimum per node, so a node with very
    many links meets a one-row side (Spark splits such a partition) and no
    neighbourhood is gathered. Each round is a written table; one row with
    its count and checksum reaches the driver."""
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(
        F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    cur, before = materialize(e, "edges"), None
    nodes = cur.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    cur = cur.where("u <> v")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        cur = materialize(small, "edges")
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots).unionByName(nodes)
            .groupBy("node").agg(F.min("component").alias("component")))
