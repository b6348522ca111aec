"""Connected components of a graph given by its edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.staging import stage


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node reachable.

    Alternates between hanging all larger neighbours of a node, and then all smaller
    ones, to its least neighbour, until only stars are left.  Every round is written
    to the shared folder.  Keys with many edges are split by adaptive skew joins.
    """
    stars = stage(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.selectExpr("v AS u", "u AS v"))
        large = both.join(_least_neighbours(both), "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        large = stage(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").filter("u <> v").distinct()
        stars = stage(small, "small_star")
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = stars.select("v").distinct().selectExpr("v AS node", "v AS root")
    return stars.selectExpr("u AS node", "v AS root").unionByName(roots)
