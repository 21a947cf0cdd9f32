"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are cut into parts that hold correlated bits together. If thresholds t_i >= -1 of the parts add up to
tau - parts + 1, two fingerprints within tau bits agree within t_i on some part i, whichever thresholds one of the two
chooses. So each fingerprint chooses its own by dynamic programming on the candidates it expects: it probes every value
within t_i of its own on part i and skips parts with -1. Candidates are verified on the whole fingerprint.

A crowded value does not expand into its pairs. First everything that meets it is compared with a few leaders drawn
from it, and components are formed; then only what is not in the component of the value's first leader meets the rest.
No pair of different components is left out, so components are exact.

Where links are verified on sets of shingles, every node has a sketch of its set: the parities of how many shingles fall
on each of SKETCH bits. Two sketches differ in no more bits than the sets have elements of their own, so a pair whose
sketches differ in more than the similarity allows is no link, nor is one whose sizes do. What came within reach of a
leader carries its sketch to the join of a crowded value, which passes over such pairs, and so do all comparisons before
their sets are made. The leaders may be far from a part of a large group of near copies, so crowded bands get rounds of
trees of likely links (crowds.py) between the two.

A fingerprint of words says little of how many shingles two texts share if an edit brings new words in one block or the
texts are short. Where links are verified, texts therefore also meet by bands: BANDS values, each of the least hashes of the
set of shingles under ROWS functions. A pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, whatever
the edit and the length. Bands are values like those of the parts, but for the distance that they do not ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import measured
from .common import ascii_lower, byte_slices, cut, read, unused
from .components import components
from .crowds import CROWD, TURNS, trees

#: Values that at least so many fingerprints share are compared with LEADERS of them first; of what then remains of a value
#: a task takes SPLIT fingerprints to be met.
CROWDED, LEADERS, SPLIT = 12, 3, 512
#: Crowded values whose leaders are broadcast; beyond it those joins shuffle.
BROADCAST_KEYS = 50_000
#: Bits of a sketch, in words of 64. Rounds of trees go on while one of WORTH pairs is a link.
SKETCH, WORTH = 1_024, 8
#: Bands of a set of shingles and least hashes in each: a pair at 0.8 is met with probability 0.9996. Keys have BAND set.
BANDS, ROWS, BAND = 20, 5, 1 << 62
#: What a probe costs beside a candidate, and the largest threshold of a part.
PROBE_COST, MOST_T = 0.3, 3


def shingles(text: str | None, k: int) -> list[bytes]:
    """A-Z lowered; words parted by ASCII white space; k joined by spaces (fewer words: all of them; none: none)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[k - 1 :], strict=False)]


def fingerprint(features: list[bytes]) -> int:
    """64 bits, signed: a bit is set if it is in over half the features' XXH64 (seed 42); 0 without features."""
    if not features:
        return 0
    h, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(features), 1 << 16):
        part = features[at : at + (1 << 16)]
        hashes = np.fromiter((h(x, 42) for x in part), np.uint64, len(part)).astype(">u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(features)).view(">i8")[0])


_DRAWN = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
_FACTOR, _SHIFT = (_DRAWN[0] | np.uint64(1))[:, None], _DRAWN[1][:, None]


def digests(features: list[bytes]) -> np.ndarray:
    """The XXH64 of each."""
    return np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features))


def bands(hashes: np.ndarray) -> list[int]:
    """The values of the bands of a set of features by their digests; none without features."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12)] * _FACTOR + _SHIFT).min(axis=1))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) % BAND + BAND for i in range(BANDS)]


def members(hashes: np.ndarray) -> np.ndarray:
    """The set of features, by 32 bits of their digests, sorted."""
    return np.unique(hashes.astype(np.uint32))


def sketch(own: np.ndarray) -> list[int]:
    """SKETCH parities of the members in longs, then how many there are."""
    return np.packbits(np.bincount(own % SKETCH, minlength=SKETCH) & 1).view(np.int64).tolist() + [len(own)]


def words_of(text: Column) -> Column:
    """The text's words with one space between them, A-Z lowered: what the shingles see of it."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", " "))


def _size(sketch: str) -> Column:
    return F.col(sketch)[SKETCH // 64]


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 3, distinct: bool = False, banded: int = 0, node: str | None = None) -> DataFrame:
    """(id, fp) of each row; distinct: every feature counts once.

    banded: also bands and sketch, those of the set of shingles of so many words. node: a column of longs that comes along."""
    kind = docs.schema[doc_id].dataType.simpleString()
    extra = {"node": "long"} if node else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            fps, keys, odd = [], [], []
            for t in b.column("text").to_pylist():
                f = shingles(t, k)
                fps.append(fingerprint(list(set(f)) if distinct else f))
                if banded:
                    hashes = digests(shingles(t, banded))
                    keys.append(bands(hashes))
                    odd.append(sketch(members(hashes)))
            more = [pa.array(x, pa.list_(pa.int64())) for x in (keys, odd)] if banded else []
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in extra), pa.array(fps, pa.int64()), *more], ["id", *extra, "fp", "bands", "sketch"][: 2 + len(extra) + len(more)])

    own = docs.select(F.col(doc_id).alias("id"), *([F.col(node).alias("node")] if node else []), F.col(text).alias("text"))
    return own.mapInArrow(run, f"id {kind}" + ", node long" * bool(node) + ", fp long" + ", bands array<long>, sketch array<long>" * bool(banded))


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each; bit 0 is the lowest."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j set (64 x 64); sums of all, 4,096 to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((64, 64))
        for b in batches:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)
            n, total = n + len(x), total + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])

    got = nodes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4097)
    for r in got:
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(64, 64)


def grouped(n: int, both: np.ndarray, parts: int) -> list[np.ndarray]:
    """The bits of each part; a part grows by the bit that correlates most with what it has."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = list(range(64)), []
    for i in range(parts):
        size = (64 * (i + 1)) // parts - (64 * i) // parts
        first = max(left, key=lambda b: (tie[b][left].max(), -b))
        own = [first]
        left.remove(first)
        while len(own) < size:
            best = max(left, key=lambda b: (tie[b][own].mean(), -b))
            own.append(best)
            left.remove(best)
        out.append(np.array(sorted(own)))
    return out


def expected(bits: np.ndarray, p: np.ndarray, n: int, most: int) -> np.ndarray:
    """Candidates within t = 0..most of each row's bits among n fingerprints, from the shares p of set bits."""
    own = np.clip(np.where(bits == 1, p, 1 - p), 1e-3, 1 - 1e-3)
    odds = (1 - own) / own
    poly = np.zeros((most + 1, len(bits)))
    poly[0] = 1
    for j in range(bits.shape[1]):
        poly[1:] += poly[:-1] * odds[:, j]
    return np.cumsum(poly, axis=0) * own.prod(axis=1) * n


def allocate(costs: list[np.ndarray], tau: int) -> np.ndarray:
    """Thresholds (rows x parts) of least cost with sum tau - parts + 1; costs[i][t + 1] are part i's at t, from -1."""
    rows, parts = costs[0].shape[1], len(costs)
    total = tau + 1  # of t + 1 over the parts
    best = np.full((total + 1, rows), np.inf)
    best[0] = 0
    back = []
    for cost in costs:
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for u in range(min(len(cost), total + 1)):
            trial = best[: total + 1 - u] + cost[u]
            better = trial < new[u:]
            new[u:][better], pick[u:][better] = trial[better], u
        best = new
        back.append(pick)
    out, at = np.zeros((rows, parts), np.int8), np.full(rows, total)
    for i in range(parts - 1, -1, -1):
        out[:, i] = back[i][at, np.arange(rows)]
        at = at - out[:, i]
    return out - 1


def _masks(k: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(k), n)], np.int64)


class Plan:
    """The parts, the shares of set bits and the probe masks for some fingerprints; the same for all of them."""

    def __init__(self, nodes: DataFrame, tau: int, parts: int):
        self.n, both = together(nodes)
        self.tau, self.groups, self.p = tau, grouped(self.n, both, parts), np.diag(both) / max(1, self.n)
        self.most = min(MOST_T, tau)
        self.masks = [[_masks(len(g), t) for t in range(self.most + 1)] for g in self.groups]

    def entries(self, bits: np.ndarray, probes: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows): each row's own value of every part, or the values that it probes."""
        if probes:
            costs = []
            for g, ms in zip(self.groups, self.masks, strict=True):
                c = expected(bits[:, g], self.p[g], self.n, self.most) + PROBE_COST * np.array([[len(m)] for m in ms])
                costs.append(np.vstack([np.zeros((1, len(bits))), c]))
            chosen = allocate(costs, self.tau)
        for i, (g, ms) in enumerate(zip(self.groups, self.masks, strict=True)):
            value = bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) + (i << 40)
            if not probes:
                yield value, np.arange(len(bits))
                continue
            for t in range(self.most + 1):
                rows = np.flatnonzero(chosen[:, i] == t)
                if len(rows):
                    yield (value[rows][:, None] ^ ms[t][None, :]).ravel(), np.repeat(rows, len(ms[t]))


class Similar:
    """Whether the sets of k-word shingles of two texts have at least a Jaccard similarity; sets are of 32-bit hashes."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, k: int, least: float, rows: DataFrame | None = None, row: str | None = None):
        """Texts go by doc_id; with rows (id, row), one text of each is that whose column row is that row, null for null."""
        columns = [F.col(doc_id).alias("id"), F.col(text).alias("text")] + ([F.col(row).alias("_row")] if row else [])
        self.docs, self.k, self.least, self.rows = docs.select(*columns), k, least, rows

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(id, s: the sorted hashes, sketch: SKETCH parities in longs, then the size) of what is in pairs (a, b)."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in byte_slices(batches, "text"):
                made = [members(digests(shingles(t, k))) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(list(map(sketch, made)), pa.list_(pa.int64()))], ["id", "s", "sketch"])

        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if self.rows is None:
            wanted = self.docs.join(ids, "id", "left_semi")
        else:
            of = ids.join(self.rows, "id").select(F.col("id").alias("_id"), F.col("row").alias("_r"))
            wanted = self.docs.join(of, (F.col("id") == F.col("_id")) & F.col("_row").eqNullSafe(F.col("_r")), "left_semi").select("id", "text")
        return cut(wanted.mapInArrow(run, "id long, s binary, sketch array<long>").dropDuplicates(["id"]))

    def may(self, x: str, y: str) -> Column:
        """False only if the sketches prove that the sets are less similar; null without a sketch."""
        words = SKETCH // 64
        differ = sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(words))
        return differ * (1 + self.least) <= (F.col(x)[words] + F.col(y)[words]) * (1 - self.least) + 1e-6

    def possible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that the sketches of nodes (node, sketch) do not prove to be too different."""
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"k{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(self.may("ka", "kb")).select("a", "b")

    def keep(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The similar ones of the pairs; held are their sets."""
        least = self.least

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                    small, large = sorted((len(x), len(y)))
                    if small < least * large:
                        keep.append(False)
                        continue
                    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda c: held.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def entries(nodes: DataFrame, plan: Plan, probes: bool) -> DataFrame:
    """(key, node, fp, comp) of nodes (node, fp, comp), with the nodes' size and sketch if they have them; of bands too."""
    names = [c for c in ("node", "fp", "comp", "size", "sketch") if c in nodes.columns]
    step = 500 if "sketch" in names else 2_000
    also = ["bands"] if "bands" in nodes.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                for keys, rows in plan.entries(_bits(b.column("fp").to_numpy()), probes):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(b.column(c).take(pa.array(rows)) for c in names)], ["key", *names])
                if also:
                    rows = pc.list_parent_indices(b.column("bands"))
                    yield pa.RecordBatch.from_arrays([pc.list_flatten(b.column("bands")), *(b.column(c).take(rows) for c in names)], ["key", *names])

    kinds = {"size": "int", "sketch": "array<long>"}
    return nodes.select(*names, *also).mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in ["key", *names]))


def link(nodes: DataFrame, tau: int, parts: int, verify: Similar | None = None) -> DataFrame:
    """(node, root) of the nodes (node long, fp long) linked within tau bits and, if verify is given, found similar by it.

    With verify nodes have a sketch of their set. They may have bands, further values at which they meet at any distance; then
    verify has to be given.
    Nodes without a link do not come back. An empty table gives an empty one. Entries are made anew for each use, from
    a row of a few numbers for each node, and are not kept; probes are shuffled once.
    """
    if not parts - 1 <= tau <= parts * (MOST_T + 1) - 1:
        raise ValueError("tau needs thresholds between -1 and 3 on these parts")
    plan = Plan(nodes, tau, parts)
    banded = [c for c in ("bands",) if c in nodes.columns]
    alone = nodes.select("node", "fp", F.col("node").alias("comp"), *banded)
    close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= tau
    near = (lambda x, y: close(x, y) | (F.col("key") >= BAND)) if banded else close
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    first = [F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("h"), "node", "fp")).alias(f"l{s}") for s in range(LEADERS)]
    crowded = cut(entries(alone, plan, False).groupBy("key").agg(F.count("*").alias("n"), *first).where(F.col("n") >= CROWDED))
    few = crowded.count() <= BROADCAST_KEYS
    sent = lambda df: F.broadcast(df) if few else df
    # One row for each value of a node with all its leaders; a leader that a node meets at several values is one pair.
    ls = F.array_distinct(F.array(*[F.struct(F.col(f"l{s}.node").alias("other"), F.col(f"l{s}.fp").alias("ofp")) for s in range(LEADERS)]))
    leaders = crowded.select("key", ls.alias("ls"))
    within = lambda x: (x["other"] != F.col("node")) & ((F.bit_count(x["ofp"].bitwiseXOR(F.col("fp"))) <= tau) | (F.lit(bool(banded)) & (F.col("key") >= BAND)))
    meets = lambda probes: entries(alone, plan, probes).join(sent(leaders), "key").select("node", F.filter("ls", within).alias("ls")).where(F.size("ls") > 0)
    each = meets(True).union(meets(False)).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("ls"))).alias("ls"))
    met = each.select("node", F.explode("ls.other").alias("other"))
    reach = None
    if verify:
        met = cut(met)
        reach = met.select("node").union(met.select("other")).distinct()
        drawn = leaders.select(F.explode("ls.other").alias("node")).distinct()
        drawn = cut(nodes.join(drawn, "node", "left_semi").select(F.col("node").alias("other"), F.col("sketch").alias("osketch")))
        met = met.join(nodes.select("node", "sketch"), "node").join(sent(drawn), (met["other"] == drawn["other"]) & verify.may("sketch", "osketch")).select("node", drawn["other"])
    met = cut(met.select(*pair).distinct())
    sure = cut(verify.keep(met, verify.sets(met))) if verify else met
    known = cut(components(sure))
    if banded:
        dense = crowded.where((F.col("key") >= BAND) & (F.col("n") >= CROWD)).select("key", F.col("n").alias("size"))
        live = cut(nodes.select("node", F.explode("bands").alias("key")).join(sent(dense), "key"))
        for turn in range(TURNS):
            now = live.join(known, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
            mixed = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).where("low <> top").select("key")
            live = cut(now.join(mixed, "key"))
            likely, asked = measured(trees(live.join(nodes.select("node", _size("sketch").alias("n"), F.slice("sketch", 1, SKETCH // 64).alias("sketch")), "node"), verify.least, turn), n=F.count("*"))
            if not asked["n"]:
                break
            found = cut(verify.keep(likely, verify.sets(likely)))
            sure = sure.union(found)
            known = cut(components(sure))
            live = live.drop("comp")
            if found.count() * WORTH < asked["n"]:
                break
    grown = nodes.join(known, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    if verify:
        grown = grown.join(reach.withColumn("reached", F.lit(True)), "node", "left").withColumn("size", _size("sketch").cast("int")).withColumn("sketch", F.when(F.col("reached"), F.col("sketch")))
    grown = cut(grown.select("node", "fp", "comp", *banded, *(["size", "sketch"] if verify else [])))
    splits = F.ceil(F.col("n") / SPLIT).cast("int").alias("splits")
    heads = cut(crowded.select(F.col("l0.node").alias("node"), "key", splits).join(known, "node", "left").select("key", F.coalesce("root", "node").alias("head"), "splits"))

    def marked(probes: bool) -> DataFrame:
        """Entries with apart: whether they are outside the component of their value's first leader; sketches for crowded values alone."""
        out = entries(grown, plan, probes).join(sent(heads), "key", "left").withColumn("apart", F.coalesce(F.col("comp") != F.col("head"), F.lit(True)))
        out = out.withColumn("splits", F.coalesce("splits", F.lit(1)))
        return (out.withColumn("sketch", F.when(F.col("head").isNotNull(), F.col("sketch"))) if verify else out).drop("head")

    # Side 0 meets all that has the value, side 1 (of the head's component) only what is apart from it. What is met of a
    # crowded value is dealt to splits, and what meets it goes to all of them.
    probing = marked(True).withColumn("side", F.when(F.col("apart"), 0).otherwise(1)).drop("apart")
    probing = probing.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    sides = F.explode(F.when(F.col("apart"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    found = marked(False).withColumnsRenamed({"node": "other", "fp": "ofp", "comp": "ocomp", "size": "osize", "sketch": "osketch"}).withColumn("side", sides)
    found = found.withColumn("split", F.pmod(F.xxhash64("other"), F.col("splits")).cast("int")).drop("apart", "splits")
    fits = (F.col("node") < F.col("other")) & (F.col("comp") != F.col("ocomp")) & near("fp", "ofp")
    if verify:
        fits = fits & (F.least("size", "osize") >= verify.least * F.greatest("size", "osize") - 1e-6) & F.coalesce(verify.may("sketch", "osketch"), F.lit(True))
    more = probing.join(found, ["key", "side", "split"]).where(fits).select(*pair).distinct()
    if verify:
        more = cut(verify.possible(cut(more), nodes))
        more = verify.keep(more, verify.sets(more))
    return components(sure.union(more))


def clusters(prints: DataFrame, tau: int = 2, parts: int = 3) -> DataFrame:
    """(id, fp, component_id: the smallest id reachable) of prints (id, fp), a row each; null ids are never smallest."""
    held = prints.groupBy("fp").agg(F.min("id").alias("least"))
    held = cut(held)
    roots = cut(link(held.select(F.col("fp").alias("node"), "fp"), tau, parts))
    named = held.join(roots, held["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows come back each."""
    prints = cut(fingerprints(read(spark, sf_dir, "documents")))
    return clusters(prints).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, tau: int = 7, parts: int = 4) -> DataFrame:
    """The rows of docs without all but one of each group of copies: that of the smallest doc_id, which may be of any type.

    Texts with the same words in order are copies. So are those whose fingerprints of distinct words differ in at most
    tau bits, or whose sets of shingles share a band, and whose sets of k-word shingles have at least the given similarity;
    groups are what such links connect. Null, empty and wordless texts are copies of each other.

    Texts, not ids, are what is told apart (by 64 bits of their words' hash): of rows that share an id each different text
    has its own group. Null ids come after all others and are told apart by their texts alike. Of rows with the same id
    (or none) and the same words one stays, the least by its columns. Very long texts are hashed whole. Columns of docs may
    have any names and types.
    """
    columns, (node, stay, row, many) = docs.columns, unused(docs, "node", "stay", "row", "many")
    docs = docs.withColumn(node, F.xxhash64(words_of(F.col(text))))
    held = cut(fingerprints(docs, doc_id=doc_id, text=text, k=1, distinct=True, banded=k, node=node))
    nodes = cut(held.groupBy("node").agg(F.min("id").alias("row"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    rows = nodes.select(F.col("node").alias("id"), "row")
    roots = cut(link(nodes.select("node", "fp", "bands", "sketch"), tau, parts, Similar(docs, node, text, k, similarity, rows, doc_id)))
    named = nodes.select("node", "row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("row").isNull().alias("none"), "row", "node")).alias("m")
    stays = named.groupBy("root").agg(first).select(F.col("m.node").alias("node"), F.col("m.row").alias("row"))
    again = held.groupBy("node", "id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("_n"), F.col("id").alias("_i"), F.lit(True).alias("many"))
    stays = stays.join(again, (F.col("node") == F.col("_n")) & F.col("row").eqNullSafe(F.col("_i")), "left").select(F.col("node").alias(stay), F.col("row").alias(row), F.col("many").alias(many))
    out = docs.join(stays, (F.col(node) == F.col(stay)) & F.col(doc_id).eqNullSafe(F.col(row)))
    once = out.where(F.col(many).isNull()).select(*columns)
    if again.isEmpty():
        return once
    # Of the same words and id the least by its columns as JSON stays, so that columns may be of any type.
    whole = F.struct(*columns)
    least = out.where(F.col(many)).groupBy(node).agg(F.min_by(whole, F.to_json(whole)).alias(many)).select(*[F.col(many)[c].alias(c) for c in columns])
    return once.union(least)
