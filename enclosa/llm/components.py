"""Connected components of a table of links, by alternating star contractions.

Large-star and small-star rounds (Kiveris et al., 2014) on a table of edges:
each round is two groupings, every intermediate table lies in the shared
folder, and only counts come to the driver.  A hub's neighbours are never
gathered in one row: the least neighbour is an aggregate and comes back by a
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enclosa.llm.common import Shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, shared: Shared, rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for every id that has a link to another.

    ``links`` has two columns of ids.  Empty links give an empty table.  Raises
    if ``rounds`` rounds do not settle it; rounds grow with the logarithm of the
    longest chain.
    """
    a, b = links.columns
    edges = shared.keep(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        # Settled: every edge ends at a least id that is on no edge's other side, so that the edges are stars.
        if edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and edges.where("a < b").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        small = shared.keep(_small_star(_large_star(edges)), "small")
        shared.drop(edges)
        edges = small
    raise RuntimeError(f"components did not settle in {rounds} rounds")
