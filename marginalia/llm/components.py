"""Connected components of an edge table by alternating large and small stars, all in DataFrame joins.

Each round every node links its larger neighbours to the smallest node it knows, then its smaller ones.
Rounds are written to the shared folder, so lineage stays short and a lost executor costs one round.
Hubs are aggregated with map-side minima and joined by joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import stored


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_minimum(down)
    return linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        linked.select("u", F.col("m").alias("v"))
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); the component is its smallest node.

    An empty table gives an empty one; loops and repeated edges change nothing.
    """
    edges = stored(edges.select("u", "v").filter("u != v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
