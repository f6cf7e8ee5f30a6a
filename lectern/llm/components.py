"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Stash


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, stash: Stash, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` with component the smallest node reachable.

    Each round replaces every node's edges by edges to its smallest neighbour, first for larger
    neighbours (large star), then for smaller ones (small star); the edge count never grows beyond the
    input's, and the number of rounds is logarithmic. Hub nodes are reduced by partial aggregation, and
    the minima are written out, so the join back is a plain one whose skew AQE can split. Edges with a
    null end and loops are ignored; an empty input gives an empty result.
    """
    e = stash.put(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash.put(large)
        low2 = stash.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .where("u > v")
            .distinct()
        )
        new = stash.put(small)
        for old in (low, large, low2, e):
            stash.drop(old)
        e, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
