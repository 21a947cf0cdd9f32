"""Connected components by randomised contraction.

Each round every node moves to the node of least random rank among itself and its neighbours; edges are renamed and
loops and repeats go. The expected number of nodes falls by a constant factor whatever the shape of the graph, so the
rounds grow with the logarithm of its size, and no node's neighbours are ever gathered: a hot node is a partial minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), one root for each component; loops, repeats and nulls are ignored.

    An empty table gives an empty one. Nodes without an edge to another node do not come back.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c, n=len(steps): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("v"))
        both = live.union(live.select("b", "a"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        moved = cut(best.select(F.col("a").alias("node"), F.least(rank("a"), "m")["v"].alias("root")))
        steps.append(moved)
        end = lambda c: moved.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        live = cut(
            live.join(end("a"), "a")
            .join(end("b"), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = cut(step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    return out
