"""Connected components of an edge table, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m") % 1_000_000_007)).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge between two nodes.

    Alternating large-star and small-star steps: each turns the edges of a node towards its smallest neighbour, so
    the number of edges never grows and long paths halve. Every step is an aggregate with map-side combine and an
    equi-join that adaptive execution can split where a node has very many neighbours. A step's edges are written to
    the shared folder, so a lost executor costs one step. Null ends and self loops say nothing; repeats do no harm.
    """
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = settle(pairs, "edges")
    last = None
    while (mark := _mark(now)) != last and mark[0]:
        last = mark
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("w > u").join(least, "u").where("w != least").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()
        large = settle(large, "large-star")
        least = large.groupBy(F.col("v").alias("v")).agg(F.min("m").alias("least"))
        turned = large.join(least, "v").select(F.when(F.col("m") == F.col("least"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("least").alias("m"))
        before, now = now, settle(turned.where("v != m").distinct(), "small-star")
        discard(before, large)
    members = now.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return members.union(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
