"""Connected components over an edge table: distributed union-find by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.shared import discard, stored


def _smaller(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, each once; loops and nulls go."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of itself and its neighbours. No more rows than e; some may be equal."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of those."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each node has one edge to a lesser node, or is such a lesser node and has none; one shuffle of the ends."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    counted = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return counted.where("ups > 1 or ups > 0 and ups < n").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge that isn't the least of its component, that least node.

    Nodes may be of any ordered type. Edges with a null end and loops count for nothing; without edges the result is
    empty. Every round stores its edges, so lineage stays short. Minima are combined before each shuffle, and a hub's
    edges meet one row in a join, which adaptive execution can split. Stops when all edges are stars, or raises.
    """
    e = stored(_smaller(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    for _ in range(max_rounds):
        last, e = e, stored(_small_star(_large_star(e)), "edges")
        discard(last)
        if _are_stars(e):
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            stars.stored_path = e.stored_path
            return stars
    raise RuntimeError(f"edges are not stars after {max_rounds} rounds")
