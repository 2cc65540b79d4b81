"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorepix.llm.store import staged


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): each vertex of ``edges`` (a, b; longs) with the smallest vertex it is connected to.

    Alternates two steps until nothing changes, each an aggregate that combines before the shuffle and a join: every
    neighbour above a vertex is linked to the smallest neighbour (large star), then every neighbour below likewise
    (small star). Edges are written to the shared folder after each round. No task needs all neighbours of a vertex.
    """
    def normal(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def mark(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.lit(0))).first())

    now = staged(normal(edges))
    vertices = staged(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct())
    before = None
    while (state := mark(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        now = normal(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        now = staged(normal(now.join(least, "a").select("b", "m").toDF("a", "b").union(least.toDF("a", "b"))))
    return vertices.join(now.toDF("v", "comp"), "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))
