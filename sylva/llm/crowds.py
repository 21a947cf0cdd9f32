"""Likely links within crowded groups: a few for each member, not all of its pairs.

A group is dealt to blocks, and each block gives the least spanning trees of what its sketches leave possible between
different components. A tree has fewer pairs than its block has members and takes the nearest ones, so nearly all are
links once they are verified, and a dense group is one component after a few rounds, each of which deals it anew. Trees
leave out no pair for good: whatever stays apart is still to be met by the rest of its group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of so many members get trees, in blocks of about BLOCK members, for at most TURNS rounds.
CROWD, BLOCK, TURNS = 16, 128, 4


def tree(sketches: np.ndarray, sizes: np.ndarray, comps: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """The pairs (places) of the least spanning trees between components; sets that cannot be similar are not tied.

    sketches: a row of uint64 for each set, parities of its elements by bit. A pair's length is the least difference that
    sketches and sizes prove, as a share of what the similarity allows; within a component all is tied at no cost.
    """
    n, out = len(sizes), []
    sizes = sizes.astype(np.float64)
    left, best, before = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, np.int64)
    at = 0
    for _ in range(n):
        left[at] = False
        differ = np.maximum(np.bitwise_count(sketches ^ sketches[at]).sum(axis=1), np.abs(sizes - sizes[at]))
        length = differ * (1 + similarity) / np.maximum((sizes + sizes[at]) * (1 - similarity), 1e-6)
        length = np.where(comps == comps[at], -1, np.where(length <= 1 + 1e-6, length, np.inf))
        nearer = length < best
        best[nearer], before[nearer] = length[nearer], at
        at = int(np.where(left, best, np.inf).argmin())
        if not left[at]:
            if not left.any():
                break
            at = int(left.argmax())  # the next tree
        elif best[at] >= 0:
            out.append((int(before[at]), at))
    return out


def trees(members: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b), a < b: the distinct pairs of the trees of members (key, size, node, comp, n, sketch), dealt anew each turn.

    size: how many members key has; n and sketch (array<long>): size and parities of the node's set.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flat = np.array(group.column("sketch").to_pylist(), np.int64).view(np.uint64)
        node, n, comp = (group.column(c).to_numpy() for c in ("node", "n", "comp"))
        ends = np.array(tree(flat, n, comp, similarity), np.int64).reshape(-1, 2)
        x, y = node[ends[:, 0]], node[ends[:, 1]]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("size") / BLOCK) + min(turn, 1)))
    return dealt.select("key", "block", "node", "comp", "n", "sketch").groupBy("key", "block").applyInArrow(run, "a long, b long").distinct()
