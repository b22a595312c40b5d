"""Connected components of an undirected edge table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., 2014) link every node to the least node it knows of;
the edge set shrinks to one star a component in about log(n) rounds, whatever the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.session import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges``.

    Loops and repeated edges are allowed; edges with a null end are ignored. A node that only has a loop
    is its own component. Each round is written to the shared checkpoint folder.
    """
    # It is read twice, and what it comes from may be costly.
    given = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna())
    e = cut(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        e = cut(_small_star(_large_star(e)))
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = given.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(roots.withColumn("component", F.col("node")))
