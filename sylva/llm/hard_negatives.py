"""Hard negatives by a two-dimensional block matrix product.

Anchors and rows are dealt to blocks, and their integer vectors are cut into chunks of dimensions. Each anchor block meets
each row block once a chunk and gives a tile of partial scores; tiles of the same two blocks are added up after a shuffle,
in slabs of a few anchors, and only the best of a tile goes on. First come the positives: rows lie in blocks by label, so
anchors meet only the blocks that hold their label. Their scores set each anchor's windows, and a second product over all
blocks finds the negatives in them. No score is kept, and what a task holds is bounded by the sizes of block and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import cut, read

#: Dimensions of a chunk; anchors and rows of a block, and anchors of a slab; components of a block at most.
CHUNK, ANCHORS, ROWS, SLAB, VALUES = 32, 512, 4_096, 64, 1 << 22


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The exact int64 inner products of two integer matrices' rows; by floating point where that is exact."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    most = int(max(-int(x.min()), int(x.max()))) * int(max(-int(y.min()), int(y.max()))) * x.shape[1]
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the least width that holds them all."""
    low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    """A matrix from its first byte, the width of an integer, and its integers."""
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(rows, -1)


def _raw(m: np.ndarray) -> bytes:
    m = narrow(m)
    return bytes([m.itemsize]) + np.ascontiguousarray(m).tobytes()


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def integers(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if the vector is, or if a component is null or not finite."""
    x = embedding.cast("array<double>")
    return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.transform(x, lambda v: F.floor(v * scale)))


def _blocks(rows: DataFrame, most: int, by_label: bool) -> DataFrame:
    """rows (row, id, label, d, bin, x) with split: blocks (d, bin, split) of about most rows, or fewer where d is large."""
    size = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(VALUES) / F.greatest("d", F.lit(1)))))
    keys = ["d", "bin"] if by_label else ["d"]
    shape = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("splits", F.ceil(F.col("n") / size).cast("int")).drop("n"))
    return rows.join(shape, keys).withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int")).drop("splits")


def _panels(rows: DataFrame, extra: str | None = None) -> DataFrame:
    """(d, bin, split, chunk, n, m: the block's matrix of that chunk, then of chunk 0: row, id, label as longs, extra)."""

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, block = key[0].as_py(), [k.as_py() for k in key]
        held: dict[str, list] = {"row": [], "id": [], "label": [], "x": [], "extra": []}
        for b in batches:
            for c in ("row", "id", "label"):
                held[c].append(b.column(c).to_numpy())
            held["x"].append(narrow(pc.list_flatten(b.column("x")).to_numpy(zero_copy_only=False).reshape(b.num_rows, d)))
            if extra:
                held["extra"] += b.column(extra).to_pylist()
        x = np.concatenate(held["x"])
        order = np.argsort(np.concatenate(held["row"]), kind="stable")
        whole = {c: np.concatenate(held[c])[order].tobytes() for c in ("row", "id", "label")}
        for chunk, at in enumerate(range(0, max(d, 1), CHUNK)):
            own = list(whole.values()) if chunk == 0 else [None] * 3
            more = [held["extra"][i] for i in order] if extra and chunk == 0 else None
            values = [*block, chunk, len(x), _raw(x[order, at : at + CHUNK]), *own] + ([more] if extra else [])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    names = ["d", "bin", "split", "chunk", "n", "m", "row", "id", "label"] + ([extra] if extra else [])
    wins = pa.list_(pa.struct([("positive", pa.int64()), ("pid", pa.int64()), ("score", pa.int64())]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4] + ([pa.list_(wins)] if extra else [])
    schema = "d int, bin int, split int, chunk int, n int, m binary, row binary, id binary, label binary"
    schema += f", {extra} array<array<struct<positive: long, pid: long, score: long>>>" if extra else ""
    return rows.groupBy("d", "bin", "split").applyInArrow(pack, schema)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties to the first place."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _product(anchors: DataFrame, rows: DataFrame, by_label: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """Of every anchor, the k best rows of its label in each tile; or with windows those of other labels in each window.

    anchors and rows (row, id, label, d, bin, x) as of negatives(); anchors may have wins. Result: (anchor, anchor_id, row,
    id, score) of each, and positive, pid, pscore of its window.
    """
    windows = "wins" if "wins" in anchors.columns else None
    left, right = cut(_panels(_blocks(anchors, ANCHORS, by_label), windows)), cut(_panels(_blocks(rows, ROWS, True)))
    # Few bytes for each pair of blocks; the matrices of anchors, the smaller ones, are what is sent to all their partners.
    keys = ["d", "bin"] if by_label else ["d"]
    one = left.where("chunk = 0").select(*keys, *([] if by_label else [F.col("bin").alias("abin")]), F.col("split").alias("group"))
    pairs = one.join(right.where("chunk = 0").select("d", "bin", "split"), keys)
    pairs = pairs.withColumn("abin", F.col("bin")) if by_label else pairs
    sent = left.withColumnsRenamed({"bin": "abin", "split": "group", "n": "an", "m": "am", "row": "anchor", "id": "anchor_id", "label": "alabel"})
    met = sent.join(pairs, ["d", "abin", "group"]).join(right, ["d", "bin", "split", "chunk"])
    tile = ["d", "abin", "group", "bin", "split", "slab"]
    held = ["anchor", "anchor_id", "alabel", "row", "id", "label"]
    wins_kind = "array<array<struct<positive: long, pid: long, score: long>>>"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                g = {c: b.column(c)[r].as_py() for c in b.schema.names if c != "wins"}
                x, y = _matrix(g["am"], g["an"]), _matrix(g["m"], g["n"])
                wins = b.column("wins")[r].as_py() if windows and g["chunk"] == 0 else None
                for slab, at in enumerate(range(0, g["an"], SLAB)):
                    size = min(SLAB, g["an"] - at)
                    part = lambda c, at=at, size=size: _longs(g[c])[at : at + size].tobytes() if g["chunk"] == 0 else None  # noqa: B023, E731
                    values = [g["d"], g["abin"], g["group"], g["bin"], g["split"], slab, size, g["n"], _raw(product(x[at : at + size], y))]
                    values += [part("anchor"), part("anchor_id"), part("alabel"), g["row"], g["id"], g["label"]]
                    made = [pa.array([v], t) for v, t in zip(values, [pa.int32()] * 8 + [pa.binary()] * 7, strict=True)]
                    if windows:
                        made.append(pa.array([wins[at : at + size] if wins else None], b.column("wins").type))
                    yield pa.RecordBatch.from_arrays(made, [*tile, "an", "n", "scores", *held] + (["wins"] if windows else []))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own, wins = None, None, None
        for b in batches:
            for r in range(b.num_rows):
                scores = _matrix(b.column("scores")[r].as_py(), b.column("an")[r].as_py()).reshape(-1, b.column("n")[r].as_py()).astype(np.int64)
                total = scores if total is None else total + scores
                if b.column("anchor")[r].is_valid:
                    own = {c: _longs(b.column(c)[r].as_py()) for c in held}
                    wins = b.column("wins")[r].as_py() if windows else None
        order = np.lexsort((own["row"], own["id"]))
        row, ids, label = (own[c][order] for c in ("row", "id", "label"))
        out: list[tuple] = []
        for i in range(len(total)):
            s, head = total[i][order], (own["anchor"][i], own["anchor_id"][i])
            if not windows:
                at = np.flatnonzero((label == own["alabel"][i]) & (ids != own["anchor_id"][i]))
                at = at[_best(s[at], k)]
                out += [(*head, row[j], ids[j], s[j], None, None, None) for j in at]
                continue
            other = np.flatnonzero((label != own["alabel"][i]) & (ids != own["anchor_id"][i]))
            for w in wins[i]:
                least, most = -(-low * w["score"] // 100), high * w["score"] // 100
                at = other[(s[other] >= least) & (s[other] <= most)]
                out += [(*head, row[j], ids[j], s[j], w["positive"], w["pid"], w["score"]) for j in at[_best(s[at], k)]]
        columns = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], result)

    result = ["anchor", "anchor_id", "row", "id", "score", "positive", "pid", "pscore"]
    binary = ", ".join(f"{c} binary" for c in held)
    schema = ", ".join(f"{c} int" for c in [*tile, "an", "n"]) + f", scores binary, {binary}" + (f", wins {wins_kind}" if windows else "")
    parts = met.select("d", "abin", "group", "bin", "split", "chunk", "an", "am", "n", "m", *held, *(["wins"] if windows else [])).mapInArrow(multiply, schema)
    return parts.groupBy(*tile).applyInArrow(reduce, ", ".join(f"{c} long" for c in result))


def hard_negatives(vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score) for the anchors among vectors.

    Scores are inner products of floor(scale * x), exact below 2^63. An anchor's positives are the best rows of its label,
    and each has the best rows of other labels whose score is low to high per cent of its own; ties go to the smaller id.
    anchors is a condition on the columns of vectors.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Repeated rows (id, label and
    vector) count once; rows that share an id but not the rest are rows of their own, none of which is a partner of
    another of its id. Rows of different lengths are not compared; empty vectors have score 0 to each other. Labels of
    another type than integers are compared by a hash of 64 bits. Negative positive scores have empty windows. Long
    vectors have smaller blocks. An empty table gives an empty one; other columns are read by anchors alone.
    """
    same = F.col(label).cast("long") if isinstance(vectors.schema[label].dataType, IntegralType) else F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label)))
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), same.alias("label"), integers(F.col(embedding), scale).alias("x"), anchors.alias("asks")).dropna(subset=["id", "label", "x"])
    own = own.withColumn("row", F.xxhash64("id", "label", "x")).groupBy("row", "id", "label").agg(F.first("x").alias("x"), F.max("asks").alias("asks")).withColumn("d", F.size("x"))
    own = cut(own)
    # Bins of whole labels; rarer labels share one, so that blocks fill, and those of a frequent one are split.
    bins = own.groupBy("d").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ROWS)).cast("int").alias("bins"))
    rows = cut(own.join(bins, "d").withColumn("bin", F.pmod(F.xxhash64("label"), F.col("bins")).cast("int")).drop("bins"))
    asked = rows.where("asks").drop("asks")
    rows = rows.drop("asks")
    found = _product(asked, rows, True, positives).select("anchor", "anchor_id", "row", "id", "score")
    by = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("score"), "id", "row")
    best = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives)
    wins = F.collect_list(F.struct(F.col("row").alias("positive"), F.col("id").alias("pid"), "score")).alias("wins")
    windowed = cut(asked.join(best.groupBy(F.col("anchor").alias("row"), F.col("anchor_id").alias("id")).agg(wins), ["row", "id"]))
    met = _product(windowed, rows, False, negatives, low, high)
    by = Window.partitionBy("anchor", "anchor_id", "positive", "pid").orderBy(F.desc("score"), "id", "row")
    out = met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", F.col("pid").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of every seventh id is moved by one; every hundredth id is an anchor."""
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
  coalesce(list_sum([z[1] * z[2] for z in list_zip(a.x, b.x)]), 0)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INTEGER AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM r WHERE rank <= 5
"""
