"""Small pieces of a graph, whose cycles a task finds by itself.

A graph of many small pieces (rings, folders that import within themselves) would take all its rows through every round of
a method for large components. Here edges are looked at in chunks of rows, as they come: what hangs together in a chunk is a
piece. A piece of few edges that shares no node with another one is whole, and its cycles stand at once; the edges of all
others are left to the rounds. Which edges stand near each other tells only how much is left to them, not what comes out.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Edges of a piece at most, and rows and bytes of a chunk; names of cycles that are given out together.
SMALL, CHUNK, CHUNK_BYTES, GIVEN = 1024, 1 << 17, 32 << 20, 1 << 18
SCHEMA = "piece long, whole boolean, source string, target string, cycle array<string>"


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes, the least that it hangs together with by edges (a, b)."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            return least
        low = np.minimum(x, y)
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        while ((up := least[least]) != least).any():
            least = up


def _strong(after: dict[int, list[int]]) -> Iterator[list[int]]:
    """The strong components of more than a node or with a loop, by Tarjan's method without recursion."""
    number, low, held, stack = {}, {}, set(), []
    for start in after:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        stack.append(start)
        held.add(start)
        path = [(start, iter(after[start]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    held.add(w)
                    path.append((w, iter(after.get(w, ()))))
                    break
                if w in held:
                    low[v] = min(low[v], number[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == number[v]:
                    at = stack.index(v)
                    own, stack[at:] = stack[at:], []
                    held.difference_update(own)
                    if len(own) > 1 or v in after.get(v, ()):
                        yield own


def _cycles(edges: list[tuple[int, int]]) -> Iterator[list[int]]:
    """As graph.cycles, of distinct edges in order, whose numbers are in the order of the names."""
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    if len(after) == len(edges):
        # One edge from each node: from the first, the way either comes back by all of them or the graph is no mere ring.
        first = edges[0][0]
        way, v = [first], after[first][0]
        while v != first and v in after and len(way) < len(edges):
            way.append(v)
            v = after[v][0]
        if v == first and len(way) == len(edges):
            yield [*way, first]
            return
    for own in _strong(after):
        members, root = set(own), min(own)
        before, order = {root: None}, [root]
        for v in order:
            for w in after[v]:
                if w in members and w not in before:
                    before[w] = v
                    order.append(w)
        for v in order:
            ends = {w for w in after[v] if w in members}
            way, x = [], v
            while x is not None and ends:
                way.append(x)
                if x in ends:
                    ends.discard(x)
                    yield [*reversed(way), x]
                x = before[x]


def _given(pieces: list[int], flat: list[int], sizes: list[int], names: pa.Array) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    cycles = pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(flat, pa.int64())))
    none = pa.nulls(len(pieces), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array([True] * len(pieces)), none, none, cycles], ["piece", "whole", "source", "target", "cycle"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (source, target): those without nulls with their pieces, and the cycles of small ones."""
    first = 0

    def chunk(held: list[pa.RecordBatch], last: bool) -> Generator[pa.RecordBatch, None, list[pa.RecordBatch]]:
        """Gives what goes out and returns the rows of the last edge's piece, which go on: what hangs together often stands together."""
        nonlocal first
        rows = pa.Table.from_batches(held).combine_chunks()
        both = pa.concat_arrays([rows["source"].combine_chunks(), rows["target"].combine_chunks()]).dictionary_encode()
        names, codes = both.dictionary, both.indices.to_numpy()
        sort = pa.compute.array_sort_indices(names).to_numpy()
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        names, codes = names.take(pa.array(sort)), rank[codes]
        a, b = codes[: len(rows)], codes[len(rows) :]
        own = _joined(a, b, len(names))[a]
        on = []
        if not last:
            mine = own == own[-1]
            if 0 < mine.sum() <= SMALL and not mine.all():
                on = rows.filter(pa.array(mine)).to_batches()
                rows, a, b, own = rows.filter(pa.array(~mine)), a[~mine], b[~mine], own[~mine]
        order = np.lexsort((b, a, own))
        a, b, own = a[order], b[order], own[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rows, a, b, own = rows.take(pa.array(order[fresh])), a[fresh], b[fresh], own[fresh]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(own)]]))
        labels = first + np.arange(len(starts))
        first += len(starts)
        out = pa.Table.from_arrays([pa.array(np.repeat(labels, counts)), pa.array(np.repeat(counts <= SMALL, counts)), rows["source"], rows["target"], pa.nulls(len(rows), pa.list_(pa.string()))], ["piece", "whole", "source", "target", "cycle"])
        out = out.combine_chunks().to_batches()
        x, y = a.tolist(), b.tolist()
        pieces, flat, sizes = [], [], []
        for label, start, n in zip(labels.tolist(), starts.tolist(), counts.tolist(), strict=True):
            if n > SMALL:
                continue
            for way in _cycles(list(zip(x[start : start + n], y[start : start + n], strict=True))):
                pieces.append(label)
                flat += way
                sizes.append(len(way))
                if len(flat) > GIVEN:
                    yield _given(pieces, flat, sizes, names)
                    pieces, flat, sizes = [], [], []
        if pieces:
            yield _given(pieces, flat, sizes, names)
        yield from out
        return on

    held, n, size = [], 0, 0
    for batch in batches:
        if (batch := batch.drop_null()).num_rows:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n >= CHUNK or size >= CHUNK_BYTES:
            held = yield from chunk(held, False)
            n, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if held:
        yield from chunk(held, True)


def settled(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycle: those of the small whole pieces of imports, the other edges: source, target)."""
    edges = imports.select("source", "target")
    label = F.shiftleft(F.spark_partition_id().cast("long"), 40).bitwiseOR(F.col("piece"))
    held = cut(edges.mapInArrow(_found, SCHEMA).withColumn("piece", label))
    own = held.where("source is not null")
    ends = own.select("piece", F.explode(F.array(F.xxhash64("source"), F.xxhash64("target"))).alias("v"))
    # Should two names share a hash, their pieces go to the rounds.
    torn = cut(ends.groupBy("v").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high").select("v"))
    cycles = held.where("cycle is not null").select("piece", "cycle")
    parts = own.where("not whole").select("piece")
    if not torn.isEmpty():
        parts = parts.union(ends.join(torn, "v", "left_semi").select("piece"))
    parts = cut(parts.distinct())
    return cycles.join(parts, "piece", "left_anti").select("cycle"), own.join(parts, "piece", "left_semi").select("source", "target")
