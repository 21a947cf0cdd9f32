"""Near-duplicates by one-permutation MinHash, bands and star-shaped candidate edges.

Each text's set of shingles is hashed once. The range of the hash is cut into bins, the least hash of a bin is its value,
and an empty bin takes that of another bin, drawn for the bin alone until one is full, so that two sets agree on a bin
with the probability of their similarity however small they are. Bins in groups are bands, and texts meet in the buckets
of equal bands: a pair of similarity s with probability 1 - (1 - s^ROWS)^BANDS.

A bucket gives a star, not its pairs: its centre is the text of least rank, and a text has at most one candidate, the
least centre among those of its buckets. Further rounds have a few stars a bucket, for what is not yet in their components.
Candidates that sizes and sketches of the sets do not rule out are compared by whole sets, and similar ones joined before
the next round. Buckets of one component are done. Centres may all be far from a dense part of a crowded bucket, so such
buckets then get rounds of trees (crowds.py). When rounds join little, what is not in the component of its bucket's
centre meets the rest of the bucket once, dealt to splits, so that no link that a bucket holds is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import measured
from .common import byte_slices, cut, read
from .components import components
from .crowds import CROWD, TURNS, trees

#: Bands and bins in each: a pair at 0.85 is met with probability 1 - 8e-6, one at 0.5 with 0.47.
BANDS, ROWS = 20, 5
#: Rounds of stars go on while one of WORTH candidates is a link; from the second on a bucket has so many centres. After
#: them a task meets SPLIT members of a bucket at once. Bits of a sketch.
WORTH, ROUNDS, CENTRES, SPLIT, SKETCH = 8, 2, 4, 512, 1_024
#: Bytes of a text that are words at the same time, and what draws another order of the nodes each round.
PIECE, DRAW = 1 << 20, 0x1B873593CC9E2D51 >> 5

_DRAWN = np.random.default_rng(13).integers(1, 1 << 63, 64, np.int64).astype(np.uint64) | np.uint64(1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _DRAWN[60]
    return h ^ (h >> np.uint64(29))


def shingle_set(raw: bytes | None, k: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of k words; with fewer words the whole sequence is one, without none.

    A-Z is lowered and ASCII white space parts words. A shingle's hash is made of its words' XXH64 by position.
    """
    raw, at, parts = raw or b"", 0, []
    while at < len(raw):
        end = at + PIECE
        stop = _SPACE.search(raw, end) if end < len(raw) else None
        end = stop.start() if stop else len(raw)
        words = raw[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = min(k, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        total += _mixed(words[i : len(words) - n + 1 + i] * _DRAWN[i % 48]) * _DRAWN[(i + 7) % 48]
    return np.unique(_mixed(total))


@lru_cache(4)
def _donors(turn: int, bins: int) -> np.ndarray:
    """256 further tries of each bin for a full one; the same for every text."""
    return np.random.default_rng([turn, bins, 13]).integers(0, bins, (256, bins))


def _edges(bins: int) -> np.ndarray:
    return np.array([-(-(i << 64) // bins) for i in range(1, bins)], np.uint64)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each of the bins, empty ones filled by densification; hashes are sorted and not none."""
    starts = np.append(0, np.searchsorted(hashes, _edges(bins)))
    full = np.append(starts[1:], len(hashes)) > starts
    out = hashes[np.minimum(starts, len(hashes) - 1)].copy()
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        tries = _donors(turn, bins)[:, empty]
        good = full[tries]
        first = good.argmax(axis=0)
        done = good[first, np.arange(len(empty))]
        out[empty[done]] = out[tries[first, np.arange(len(empty))][done]]
        empty, turn = empty[~done], turn + 1
    return out


def bands(hashes: np.ndarray, n: int = BANDS, rows: int = ROWS) -> list[int]:
    """The buckets of a set: a signed value for each band; none for an empty set."""
    if not len(hashes):
        return []
    own = (signature(hashes, n * rows).reshape(n, rows) * _DRAWN[48 : 48 + rows][None]).sum(axis=1, dtype=np.uint64)
    return _mixed(own + np.arange(1, n + 1, dtype=np.uint64) * _DRAWN[59]).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """Parities of how many hashes fall on each of SKETCH bits, in longs: sets differ in at least as many as these do."""
    at = (_mixed(hashes * _DRAWN[57]) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH) & 1).view(np.int64).tolist()


def _print(hashes: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(id, h1, h2: 128 bits of the set, n: its size, bands, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in byte_slices(batches, "text"):
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            one, two = zip(*map(_print, sets), strict=True)
            columns = [pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], longs), pa.array([sketch(s) for s in sets], longs)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "h1", "h2", "n", "bands", "sketch"])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    return own.mapInArrow(run, f"id {docs.schema[doc_id].dataType.simpleString()}, h1 long, h2 long, n long, bands array<long>, sketch array<long>")


def _distinct(held: DataFrame) -> DataFrame:
    """(node: a long of its own for each set, h1, h2, n, bands, sketch, rep: the least id that has it)."""
    sets = cut(held.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    # Of two sets that share their first 64 bits one keeps them.
    clash = cut(sets.groupBy("h1").agg(F.min("h2").alias("least"), F.max("h2").alias("most")).where("least <> most").select("h1", "least"))
    if clash.isEmpty():
        return sets.withColumn("node", F.col("h1"))
    own = sets.join(clash, "h1", "left")
    return cut(own.withColumn("node", F.when(F.coalesce("least", "h2") == F.col("h2"), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))).drop("least"))


class Sets:
    """The sets of some nodes, made of the whole texts of their representatives, and whether two are similar."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, k: int, percent: int):
        """nodes: (node, h1, h2, n, sketch, rep) of all that may be asked for."""
        self.docs = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
        self.nodes, self.k, self.percent = nodes, k, percent

    def of(self, pairs: DataFrame) -> DataFrame:
        """(node, s: sorted hashes) of all that is in pairs (a, b)."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in byte_slices(batches, "text"):
                sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
                one, two = zip(*map(_print, sets), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "s"])

        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = cut(self.nodes.join(wanted, "node", "left_semi").select("node", "h1", "h2", "rep"))
        texts = self.docs.join(known.select("rep").distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        made = texts.mapInArrow(run, "h1 long, h2 long, s binary").join(known.drop("rep"), ["h1", "h2"])
        return cut(made.select("node", "s").dropDuplicates(["node"]))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches do not prove to be too different."""
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
        fits = self.sized(F.col("na"), F.col("nb")) & self.may("ka", "kb", "na", "nb")
        return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b")

    def sized(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * self.percent

    def may(self, x: str, y: str, n: str, m: str) -> Column:
        differ = sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH // 64))
        return differ * (100 + self.percent) <= (F.col(n) + F.col(m)) * (100 - self.percent)

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (a, b), by their whole sets."""
        percent, held = self.percent, self.of(pairs)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        keep.append(False)
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda c: held.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(node, root) of the nodes of docs that similar ones connect; nodes without a link do not come back."""
    entries = nodes.select("node", F.explode("bands").alias("key"))
    star = cut(entries.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1").select("key", "centre"))
    live = cut(entries.join(star, "key"))
    known = cut(nodes.drop("bands").join(live.select("node").distinct(), "node", "left_semi"))
    sets = Sets(docs, known, doc_id, text, k, percent)
    pairs = live.where("node <> centre").groupBy("node").agg(F.min("centre").alias("c"))
    live, turn, sure = live.select("key", "node"), 0, None
    while True:
        pairs, asked = measured(sets.possible(pairs.select(*_pair(F.col("node"), F.col("c"))).distinct()), n=F.count("*"))
        found = sets.similar(pairs)
        sure = found if sure is None else sure.union(found)
        roots = cut(components(sure))
        live = live.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        turn += 1
        if turn == ROUNDS or found.count() * WORTH < max(1, asked["n"]):
            break
        # Several centres a bucket: a member of a group that is no link of one of them is one of another.
        drawn = [lambda c, d=turn * CENTRES + i: F.col(c).bitwiseXOR(F.lit(d * DRAW)) for i in range(CENTRES)]
        centres = [x for i, f in enumerate(drawn) for x in (F.min(f("node")).alias(f"c{i}"), F.min_by("comp", f("node")).alias(f"o{i}"))]
        star = cut(live.groupBy("key").agg(*centres, F.min("comp").alias("low"), F.max("comp").alias("top")).where("low <> top").drop("low", "top"))
        live = cut(live.join(star, "key"))
        nearest = live.groupBy("node").agg(*[F.min(F.when(F.col("comp") != F.col(f"o{i}"), F.col(f"c{i}"))).alias(f"c{i}") for i in range(CENTRES)])
        pairs = nearest.select("node", F.explode(F.array_compact(F.array(*[f(f"c{i}") for i, f in enumerate(drawn)]))).alias("c"))
    live = live.select("key", "node", "comp")
    for turn in range(TURNS):
        mixed = live.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("top")).where(F.col("size") >= CROWD).where("low <> top").drop("low", "top")
        pairs, asked = measured(trees(live.join(cut(mixed), "key").join(known.select("node", "n", "sketch"), "node"), percent / 100, turn), n=F.count("*"))
        if not asked["n"]:
            break
        found = sets.similar(pairs)
        sure = sure.union(found)
        roots = cut(components(sure))
        live = cut(live.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")))
        if found.count() * WORTH < asked["n"]:
            break
    star = live.groupBy("key").agg(F.min_by("comp", F.xxhash64("node")).alias("head"), F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("top"))
    left = cut(live.join(cut(star.where("low <> top").drop("low", "top")), "key").withColumn("apart", F.col("comp") != F.col("head")))
    if left.isEmpty():
        return roots
    marked = left.join(known.select("node", "n", "sketch"), "node").withColumn("splits", F.ceil(F.col("size") / SPLIT).cast("int"))
    one = marked.where("apart").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).select("key", "split", "node", "n", "comp", "sketch")
    two = marked.withColumn("split", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int")).select("key", "split", F.col("node").alias("y"), F.col("n").alias("m"), F.col("comp").alias("ycomp"), F.col("sketch").alias("ysketch"), "apart")
    fits = (F.col("comp") != F.col("ycomp")) & ((F.col("node") < F.col("y")) | ~F.col("apart")) & sets.sized(F.col("n"), F.col("m")) & sets.may("sketch", "ysketch", "n", "m")
    pairs = cut(one.join(two, ["key", "split"]).where(fits).select(*_pair(F.col("node"), F.col("y"))).distinct())
    return components(sure.union(sets.similar(pairs)))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n: size of its set of shingles, component_id: the smallest id reachable, kept) of each row.

    Rows are linked if their sets of k-word shingles have a Jaccard similarity of at least percent; similarities are those
    of whole sets, in whole numbers. Rows with equal sets, copies among them, are one node throughout. Rows without a word
    (null, empty and blank texts) are linked with nothing. kept: whether the id is the smallest of its component, so rows
    that repeat an id are kept or not alike; null ids are larger than all others, and rows of a component without another
    id have null as its id and are kept. Very long texts are read in pieces and compared whole. An empty table gives an
    empty one; other columns are not read. A link below 0.85 is found with the probability that the bands give.
    """
    held = cut(signatures(docs, doc_id, text, k))
    nodes = _distinct(held)
    roots = cut(link(nodes, docs, doc_id, text, k, percent))
    named = nodes.select("node", "h1", "h2", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "root").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id")
    worded = held.where("n > 0").join(of, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("id", "n", "component_id")
    out = worded.union(held.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of three words, a similarity of 0.85."""
    found = near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")
