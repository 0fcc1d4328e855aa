"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import staged


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, root)``, root the smallest node of the component.

    Every node of an edge is listed, roots too. Rounds are logarithmic in the longest path;
    each is two grouped minima, combined map-side so that a node of any degree is no hot key,
    joined back to the edges (one row a node on one side, so that skewed joins can be split).
    Not done after ``most_rounds`` is an error.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or sign["n"] == 0:
            break
        before = sign
        # large star: the neighbours above a node hang on the least of it and its neighbours
        ends = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = ends.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = staged(now.join(least, now["u"] == least["x"]).select("v", F.col("m").alias("u")).where("v <> u").distinct())
        # small star: a node and its neighbours below hang on the least of these
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        below = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        now = staged(below.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    members = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return members.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
