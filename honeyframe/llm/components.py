"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import materialise


def _stars(pairs: DataFrame) -> DataFrame:
    """Of (u, v): each v with the least of u and its neighbours. Minima are taken before rows meet, and a hot u is one that Spark may split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _step(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _stars(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    small = _stars(large)
    out = small.select(F.col("v").alias("x"), "m").union(small.select(F.col("u").alias("x"), "m"))
    return out.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node with an edge.

    ``edges`` has two columns of bigints; repeated, reversed and self edges are allowed, none may be null.
    """
    a, b = edges.columns
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    now, seen, turn = materialise(now, "edges"), None, 0
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == seen or not found[0]:
            break
        seen, turn = found, turn + 1
        now = materialise(_step(now), f"edges{turn}")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
