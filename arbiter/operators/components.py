"""Connected components of an edge table with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.storage import materialise


def components(edges: DataFrame, max_rounds: int = 100, finish: Callable[[DataFrame], DataFrame] | None = None, finish_rows: int = 0) -> DataFrame:
    """(node, root) for every node of the edges (u, v), roots too; root is the smallest node reachable.

    Each round hangs every node's neighbours on the smallest of them (large
    star, then small star), so path lengths fall geometrically. The smallest
    neighbour is a partial aggregate joined back as a table, which lets a node
    with most of the edges be split. Rounds end when the edge set stays, or
    when `finish_rows` edges or fewer are left for `finish` to make into stars.
    A run that reaches neither in `max_rounds` is an error, not a result.
    """
    edges = materialise(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        if finish is not None and now[0] <= finish_rows:
            edges = materialise(finish(edges), "finished")
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = materialise(both.join(least, "u").filter("v > u and m <> v").select(F.col("m").alias("u"), "v").distinct(), "large")
        least = materialise(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        hung = large.join(least, "v").select(F.explode(F.array(F.struct("m", "v"), F.struct("m", F.col("u").alias("v")))).alias("e")).select(F.col("e.m").alias("u"), F.col("e.v").alias("v"))
        edges = materialise(hung.filter("u <> v").distinct(), "small")
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
