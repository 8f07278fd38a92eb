"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round moves edges to the smallest neighbour known; minima are aggregated
before they are shuffled, the joins have one row a vertex on one side, so a hot
vertex is split by adaptive skew joins. Rounds end when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, reread

#: Edges that one file of a round holds about.
EDGES = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, root: for each vertex of the edges the smallest vertex it is linked with. Loops and repeats are allowed."""
    spark = edges.sparkSession
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    path = keep(pair, "edges")
    pair, before = reread(pair, path), None
    while True:
        # Large star: each vertex hands its larger neighbours to its smallest neighbour or itself.
        both = pair.select("u", "v").union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each vertex hands its smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        # Few edges go to few files.
        edges_now = before[0] if before else None
        after = keep(small if edges_now is None else small.coalesce(max(1, -(-edges_now // EDGES))), "edges")
        drop(spark, path)
        path, pair = after, reread(small, after)
        now = tuple(pair.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = pair.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return out.union(out.select(F.col("root").alias("vertex"), "root").distinct())
