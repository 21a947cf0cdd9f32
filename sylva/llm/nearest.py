"""Nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Rows are dealt to cells around coarse centres, and what a row differs from its centre is cut into pairs of components, each
pair quantised to one of 16 centres (four bits). Codes and centres minimise a loss in which the part of the residual that
is parallel to the vector weighs more than the rest, since that part moves the inner products of the queries that matter.
A query adds up table entries for all vectors of a block, and those that look best are measured exactly.

Two bounds see to it that no neighbour is missed, whatever the rows are like. A cell is left out if even its rim is further
away than k rows of another cell are for certain; and how far a row is from its code bounds how far the scan can err, so
all rows of a block that may be nearer than those measured first are measured too. Where vectors have no structure that
bounds can use, most are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read

#: Vectors the centres are fitted on (the bound of the sample, in the order of a hash), rows and queries of a block, the
#: vectors of a block that a query measures first, and components of a block's rows or queries at most.
SAMPLE, ROWS, QUERIES, RERANK, BLOCK = 20_000, 8_192, 4_096, 128, 1 << 22
#: Rows of a cell on average, cells at most, and the share of the sample's neighbours that the cells visited hold if asked.
CELL, CELLS, HELD = 4_096, 1_024, 0.99
PARALLEL = 0.2  # the cosine from which on inner products matter; it sets the weight of the parallel residual


def _weight(d: int) -> float:
    return max(1.0, (d - 1) * PARALLEL**2 / (1 - PARALLEL**2))


def _pairs(x: np.ndarray) -> np.ndarray:
    """rows x components, padded by zeros to a multiple of 4, as rows x subspaces x 2."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)


def encode(x: np.ndarray, centres: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes (rows x subspaces, 0 to 15) by coordinate descent on the anisotropic loss; blocks of rows bound memory."""
    out = np.empty((len(x), len(centres)), np.uint8)
    extra = _weight(x.shape[1]) - 1
    for at in range(0, len(x), 4_096):
        v = _pairs(x[at : at + 4_096])
        square = np.maximum((v**2).sum((1, 2)), 1e-30)
        gap = v[:, :, None, :] - centres[None]
        size, along = (gap**2).sum(3), (gap * v[:, :, None, :]).sum(3)
        code = size.argmin(2)
        rows = np.arange(len(v))
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for s in range(len(centres)):
                rest = total - along[rows, s, code[:, s]]
                code[:, s] = (size[:, s] + extra * (rest[:, None] + along[:, s]) ** 2 / square[:, None]).argmin(1)
                total = rest + along[rows, s, code[:, s]]
        out[at : at + 4_096] = code
    return out


def fit(x: np.ndarray, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres (subspaces x 16 x 2) for the vectors x."""
    v, rng = _pairs(x), np.random.default_rng(seed)
    extra, square = _weight(x.shape[1]) - 1, np.maximum((x**2).sum(1), 1e-30)
    centres = np.stack([v[rng.choice(len(v), 16, replace=len(v) < 16), s] for s in range(v.shape[1])])
    for _ in range(rounds):
        code = encode(x, centres)
        chosen = np.stack([centres[s][code[:, s]] for s in range(len(centres))], 1)
        along = ((v - chosen) * v).sum(2)
        total = along.sum(1)
        for s in range(len(centres)):
            own = v[:, s]
            lift = extra / square
            left = np.eye(2)[None] + lift[:, None, None] * own[:, :, None] * own[:, None, :]
            right = own * (1 + lift * (total - along[:, s] + (own**2).sum(1)))[:, None]
            for c in range(16):
                at = code[:, s] == c
                if at.any():
                    centres[s, c] = np.linalg.solve(left[at].sum(0), right[at].sum(0))
    return centres


def _valid(c: Column) -> Column:
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~odd & F.exists(c, lambda v: v != 0)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all y."""
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None]


def cells(x: np.ndarray, n: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """n centres of the vectors x by Lloyd's rounds; an empty cell takes a vector at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=len(x) < n)].copy()
    for _ in range(rounds if n > 1 else 0):
        own = np.concatenate([_far(x[i : i + 2_048], centres).argmin(1) for i in range(0, len(x), 2_048)])
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), n)])
    return centres


def probes(x: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many cells, the nearest first, hold the share HELD of the k neighbours of 300 of the vectors x among x."""
    if len(centres) == 1 or len(x) <= k:
        return len(centres)
    order = _far(x[:300], centres).argsort(1)
    place = order.argsort(1)  # of each cell in a query's order
    far = _far(x[:300], x)
    far[np.arange(len(order)), np.arange(len(order))] = np.inf
    near = np.argpartition(far, k, axis=1)[:, :k]
    own = np.concatenate([_far(x[i : i + 2_048], centres).argmin(1) for i in range(0, len(x), 2_048)])
    return int(np.quantile(np.take_along_axis(place, own[near], 1), HELD, method="higher")) + 1


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows x components."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far rounding can move the squared distance of vectors as long as x and y, and more."""
    return 4e-16 * (x + y) ** 2 + 1e-300


def _measure(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of x to the rows j of y, component by component."""
    total = np.zeros(len(i))
    for c in range(x.shape[1]):
        total += (x[i, c] - y[j, c]) ** 2
    return np.sqrt(total)


def _best(k: int, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the k nearest different ids of each i, nearest first and ties by id."""
    at = np.lexsort((score, ids, i))
    at = at[np.append(True, (i[at][1:] != i[at][:-1]) | (ids[at][1:] != ids[at][:-1]))] if len(at) else at
    at = at[np.lexsort((ids[at], score[at], i[at]))]
    own, n = i[at], np.arange(len(at))
    return at[n - np.searchsorted(own, own) < k]


def _of_length(data: DataFrame, asked: DataFrame, k: int, sample: int, rerank: int, partly: bool) -> DataFrame:
    """(q, query_id, rank, vec_id, score) of rows (id, same, x) and queries (q, id, x) of one length."""
    shape = data.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.max(F.size("x")).alias("d")).first()
    rows = data.orderBy(F.xxhash64("id"), "id", "same").limit(sample).select("id", "x").collect()
    d, power = shape["d"], -math.frexp(shape["most"])[1]
    small = lambda v: np.ldexp(v, power)  # noqa: E731  # so that no square overflows; distances are measured as given
    x = small(np.array([r["x"] for r in rows]))
    coarse = cells(x, max(1, min(CELLS, round(shape["n"] / CELL), len(x) // 20)))
    at = np.concatenate([_far(x[i : i + 2_048], coarse).argmin(1) for i in range(0, len(x), 2_048)])
    centres, visited = fit(x - coarse[at]), probes(x, coarse, k) if partly else len(coarse)
    # In each cell, a distance from the centre within which k different ids stand besides a query's own.
    apart, full = np.sqrt(((x - coarse[at]) ** 2).sum(1)), np.full(len(coarse), np.inf)
    last = _best(k + 1, at, np.array([r["id"] for r in rows]), apart)
    held, first, many = np.unique(at[last], return_index=True, return_counts=True)
    full[held[many > k]] = apart[last][first[many > k] + k]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = small(_matrix(b.column("x")))
                own = _far(v, coarse).argmin(1)
                v = v - coarse[own]
                c = encode(v, centres)
                packed = (c[:, 0::2] | (c[:, 1::2] << 4)).astype(np.uint8)
                far = np.sqrt((v**2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("same"), b.column("x"), pa.array(own, pa.int32()), pa.array(far), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "same", "x", "cell", "far", "code"])

    # Of equal vectors only the k + 1 smallest ids can be among the nearest of anything.
    codes = data.select("id", "same", "x").mapInArrow(coded, "id long, same long, x array<double>, cell int, far double, code binary")
    codes = codes.withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    codes = cut(codes)
    blocks = F.ceil(F.count("*") / max(256, min(ROWS, BLOCK // d))).cast("int").alias("blocks")
    sizes = cut(codes.groupBy("cell").agg(blocks, F.max("far").alias("rim")))  # a row for each cell, at most CELLS
    rim = np.full(len(coarse), -np.inf)
    for r in sizes.select("cell", "rim").collect():
        rim[r["cell"]] = r["rim"] * (1 + 1e-12)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = small(_matrix(b.column("x")))
                square = _far(v, coarse)
                slack = (d + 16) * _slack(np.sqrt((v**2).sum(1))[:, None], np.sqrt((coarse**2).sum(1))[None])
                within = (np.sqrt(np.maximum(square, 0) + slack) + full).min(1) * (1 + 1e-12)
                go = ~(np.sqrt(np.maximum(square - slack, 0)) - rim > within[:, None])
                if visited < len(coarse):
                    go &= square.argsort(1).argsort(1) < visited
                i, cell = np.nonzero(go)
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column("q").take(i), b.column("id").take(i), b.column("x").take(i), pa.array(cell, pa.int32())], ["q", "qid", "x", "cell"])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            centre = coarse[left.column("cell")[0].as_py()]
            ids, x = left.column("id").to_numpy(), _matrix(left.column("x"))
            packed = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            y, code = small(x) - centre, np.stack([packed & 15, packed >> 4], 2).reshape(len(ids), -1)
            like = centres[np.arange(len(centres)), code].reshape(len(ids), -1)[:, :d]
            long, near, off = (np.sqrt((v**2).sum(1)) for v in (y, like, y - like))
            columns, low, high = np.ascontiguousarray(packed.T), np.arange(256) & 15, np.arange(256) >> 4
            q, qid, qx = right.column("q").to_numpy(), right.column("qid").to_numpy(), _matrix(right.column("x"))
            for start in range(0, len(q), 64):
                part = slice(start, start + 64)
                p, v = small(qx[part]) - centre, qx[part]
                table = np.einsum("qsk,sck->qsc", _pairs(p), centres)
                both = table[:, 0::2][:, :, low] + table[:, 1::2][:, :, high]
                product = np.zeros((len(p), len(ids)))
                for j, c in enumerate(columns):
                    product += both[:, j][:, c]
                size, own = np.sqrt((p**2).sum(1))[:, None], ids[None] == qid[part][:, None]
                guess = np.where(own, np.inf, long**2 - 2 * product)
                first = np.argpartition(guess, rerank, 1)[:, :rerank] if len(ids) > rerank else np.tile(np.arange(len(ids)), (len(p), 1))
                i, j = np.repeat(np.arange(len(p)), first.shape[1]), first.ravel()
                i, j = i[~own[i, j]], j[~own[i, j]]
                score = _measure(x, v, j, i)
                best = _best(k, i, ids[j], score)
                bound = np.full(len(p), np.inf)
                whole, ends = np.unique(i[best], return_index=True)
                many = np.diff(np.append(ends, len(best)))
                bound[whole[many == k]] = score[best][(ends + many - 1)[many == k]]
                bound = small(bound)[:, None] * (1 + 1e-12)
                # What is nearer than the bound is neither nearer than its code allows nor than the product of vectors tells.
                coded_ = np.sqrt(np.maximum(size**2 + near**2 - 2 * product - (d + 16) * _slack(size, near), 0))
                open_ = ~(coded_ - off * (1 + 1e-12) > bound) & ~own
                some = np.flatnonzero(open_.any(0))
                square = size**2 + long[some] ** 2 - 2 * p @ y[some].T - (d + 16) * _slack(size, long[some])
                i, j = np.nonzero(open_[:, some] & ~(square > bound**2))
                j = some[j]
                score = _measure(x, v, j, i)
                best = _best(k, i, ids[j], score)
                out.append((q[part][i[best]], qid[part][i[best]], ids[j[best]], score[best]))
        q, q_id, v_id, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return pa.table({"q": q, "query_id": q_id, "vec_id": v_id, "score": score})

    routed = cut(asked.select("q", "id", "x").mapInArrow(sent, "q long, qid long, x array<double>, cell int"))
    busy = routed.groupBy("cell").agg(F.ceil(F.count("*") / max(256, min(QUERIES, BLOCK // d))).cast("int").alias("groups"))
    shape = F.broadcast(cut(sizes.join(busy, "cell").select("cell", "blocks", "groups")))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = codes.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int")).withColumn("group", number("groups"))
    two = routed.join(shape, "cell").withColumn("group", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int")).withColumn("block", number("blocks"))
    key = ["cell", "block", "group"]
    pick = lambda df, *c: df.select(*key, *c).groupBy(*key)
    found = pick(one, "id", "x", "code").cogroup(pick(two, "q", "qid", "x")).applyInArrow(scan, "q long, query_id long, vec_id long, score double")
    each = found.groupBy("q", "query_id", "vec_id").agg(F.min("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, sample: int = SAMPLE, rerank: int = RERANK, partly: bool = False) -> DataFrame:
    """(query_id, rank from 1, vec_id, score: Euclidean distance) of the k nearest, ties to the smaller vec_id.

    vectors and queries share their columns; a row is no candidate of a query of its own id. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part on either side; null ids take none either. Vectors
    of different lengths are not compared: each length is searched by itself. Repeated rows of vectors and of queries
    count once. An id that stands on several vectors is one neighbour, at its nearest; as a query each of its vectors is
    searched and has its own ranks. Very long vectors are only larger. Other columns are not read, whatever their names.
    With partly, queries visit only as many cells as hold 99 % of the sample's neighbours, and may miss some.
    """
    read_ = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x")).where(F.col(vec_id).isNotNull() & _valid(F.col("x")))
    once = lambda df: df.withColumn("same", F.xxhash64(F.transform("x", lambda v: v + 0.0))).groupBy("id", "same").agg(F.first("x").alias("x"))
    data, asked = cut(once(read_(vectors))), cut(once(read_(queries)))
    asked = cut(asked.withColumn("q", F.xxhash64("id", "same")))
    lengths = [r["d"] for r in asked.select(F.size("x").alias("d")).distinct().join(data.select(F.size("x").alias("d")).distinct(), "d", "left_semi").orderBy("d").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_of_length(data.where(F.size("x") == d), asked.where(F.size("x") == d), k, sample, rerank, partly) for d in lengths]
    return reduce(DataFrame.union, found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
