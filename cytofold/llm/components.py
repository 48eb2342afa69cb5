"""Connected components of a graph given as edges, by alternating stars.

Each round links every node's larger neighbours to its smallest one (large star), then its smaller neighbours and
itself to its smallest one (small star). Edges never grow in number; rounds grow as the logarithm of the graph's
width. Each round is written to the shared folder; only two numbers of a round come to the driver.

Null ends and loops are dropped; an empty table of edges gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that an edge touches and that isn't its component's smallest; root is the smallest."""
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    print_ = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    before = e.select(print_.alias("x")).first().x
    while before[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = cut(small, "edges")
        now = e.select(print_.alias("x")).first().x
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
