"""Connected components of a graph of links, in DataFrame operations only.

Rounds of large-star and small-star steps (each node hands its smallest neighbour to the others) until every
component is a star around its smallest node. A step groups and joins by node; a hub's edges are minima that
combine before the shuffle, and its side of the join can be split by adaptive execution. Each round is cut by
a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    passed = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return passed.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    inner = edges.join(edges.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi")
    if not inner.isEmpty():
        return False
    n, heads = edges.agg(F.count("*"), F.count_distinct("hi")).first()
    return n == heads


def components(links: DataFrame, purpose: str) -> DataFrame:
    """node, root (the smallest node of its component) of every node in ``links`` (a, b) but the roots.

    Links to itself, repeated links and links in both directions are fine; a link with a null end is none.
    No links: no rows. Node values of any one ordered type.
    """
    edges = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = written(edges.where("hi <> lo").distinct(), purpose)
    if edges.isEmpty():
        return edges.toDF("node", "root")
    while not _is_star(edges):
        before, edges = edges, written(_small_star(_large_star(edges)), purpose)
        removed(before)
    return edges.toDF("node", "root")
