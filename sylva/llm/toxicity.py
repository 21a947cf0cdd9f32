"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k | x) = sigmoid(w.x - theta_k) with one w for all thresholds theta_1 < theta_2; the expected severity is the
sum of these. Grades come from the labels alone: 0 for harmless rows, 1 for toxic ones of good quality, 2 for toxic ones
of bad quality (or of unknown quality where there is no such column: then all toxic rows have grade 1).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, cut, read

#: Labelled rows of either class that training uses, in the order of a hash of the id: the bound of the sample.
SAMPLE = 4_000
#: A feature carries weight if it is so many times as frequent in the rows of one kind as in those of the other, by so many
#: standard errors; all that do are used, those of toxic rows and those that speak against them.
TIMES, SURE = 4.0, 1.7
#: The penalty on weights, and how much a row's grade among the toxic counts next to its being toxic: quality says little of
#: how toxic a text is, and at full weight it costs a quarter of the toxic rows found.
RIDGE, GRADED = 6e-3, 0.05
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The text's words in lower case, those that occur again once more with +, and beginnings of 4 to 6 letters."""
    counts = Counter(WORD.findall((text or "").lower()))
    return {*counts, *(f"{w}+" for w, n in counts.items() if n > 1), *(f"^{w[:n]}" for w in counts for n in (4, 5, 6) if len(w) > n)}


@dataclass(frozen=True)
class Severity:
    weights: dict[str, float]
    thresholds: tuple[float, float]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(grade >= 1), P(grade >= 2); the whole of each text counts."""
        get = self.weights.get
        eta = np.array([sum(get(f, 0.0) for f in features(t)) for t in texts], dtype=float)
        return tuple(1 / (1 + np.exp(np.clip(theta - eta, -500, 500))) for theta in self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, row_weights: np.ndarray, n: int, steps: int = 600, ridge: float = 2e-3, split: float = 1.0) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights and thresholds by Adam on the penalised likelihood; rows hold the numbers of their features.

    split is the weight of which of the two upper grades a row has, next to that it has one of them: 1 for grades that are
    as sure as that, less where they are not.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    share = row_weights / row_weights.sum()
    x = np.concatenate([np.zeros(n), [3.0, 1.0]])  # w, theta_1, log of the gap to theta_2
    m, v = np.zeros_like(x), np.zeros_like(x)
    low, mid, high = grades == 0, grades == 1, grades == 2
    for step in range(1, steps + 1):
        t1, gap = x[-2], np.exp(x[-1])
        eta = np.bincount(at, x[ids], minlength=len(rows)) if len(ids) else np.zeros(len(rows))
        s1, s2 = 1 / (1 + np.exp(t1 - eta)), 1 / (1 + np.exp(t1 + gap - eta))
        d1, d2 = s1 * (1 - s1), s2 * (1 - s2)
        between = np.maximum(s1 - s2, 1e-12)
        either = (1 - split) * -(1 - s1)
        to1 = np.where(low, s1, either + np.where(mid, -split * d1 / between, 0.0)) * share  # of the loss by the argument of s1
        to2 = split * np.where(mid, d2 / between, np.where(high, -(1 - s2), 0.0)) * share
        grad = np.zeros_like(x)
        if len(ids):
            grad[:n] = np.bincount(ids, (to1 + to2)[at], minlength=n)
        grad[:n] += ridge * x[:n] / max(1, n) ** 0.5
        grad[-2], grad[-1] = -(to1 + to2).sum(), -to2.sum() * gap
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:n], (float(x[-2]), float(x[-2] + np.exp(x[-1])))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", quality: str = "quality", sample: int = SAMPLE) -> Severity:
    """A model from at most sample labelled rows of either class; without rows of both, one that rejects nothing.

    Of several labels of an id the most severe counts. Labels that are null, have no id or no document do not. A labelled
    id that stands on several documents labels each of them. The texts of the sample are read whole; other columns of docs
    are not, whatever their names.
    """
    none = Severity({}, (50.0, 60.0))
    good = F.coalesce(F.col(quality), F.lit(0)) > 0 if quality in labels.columns else F.lit(True)
    grade = F.when(F.col(label) > 0, F.when(good, 1).otherwise(2)).otherwise(0)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(grade).alias("grade"))
    known = known.withColumn("y", (F.col("grade") > 0).cast("int"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return none
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(pick(0).union(pick(1))), "id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("grade"), pa.array([sorted(features(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["y", "grade", "fs"])

    held = cut(chosen.mapInArrow(split, "y int, grade int, fs array<string>"))
    n = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return none
    marked = _marked(held.select("y", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")), n)
    names = sorted(r["f"] for r in marked.select("f").collect())  # of the sample's rows alone
    if not names:
        return none
    index = {f: i for i, f in enumerate(names)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("grade"), pa.array([[index[f] for f in fs if f in index] for fs in b.column("fs").to_pylist()], pa.list_(pa.int32()))], ["y", "grade", "ids"])

    got = sorted((r["grade"], r["y"], r["ids"]) for r in held.mapInArrow(numbers, "y int, grade int, ids array<int>").collect())  # at most twice the sample
    y = np.array([r[1] for r in got])
    weights, thresholds = fit([np.array(r[2], int) for r in got], np.array([r[0] for r in got]), np.where(y == 1, total[1] / n[1], total[0] / n[0]), len(names), ridge=RIDGE, split=GRADED)
    return Severity({f: float(w) for f, w in zip(names, weights, strict=True)}, thresholds)


def _marked(counts: DataFrame, n: dict[int, int]) -> DataFrame:
    """Of features with their rows of either kind (n1, n0) those that tell the kinds apart."""
    p1, p0 = F.col("n1") / n[1], F.col("n0") / n[0]
    h1, h0 = (F.col("n1") + 0.5) / (n[1] + 1.0), (F.col("n0") + 0.5) / (n[0] + 1.0)
    for_it = (F.col("n1") >= 3) & (p1 >= TIMES * (F.col("n0") + 0.5) / n[0]) & ((p1 - h0) >= SURE * F.sqrt(p1 * (1 - p1) / n[1] + h0 / n[0]))
    against = (F.col("n0") >= 3) & (p0 >= TIMES * (F.col("n1") + 0.5) / n[1]) & ((p0 - h1) >= SURE * F.sqrt(p0 * (1 - p0) / n[0] + h1 * (1 - h1) / n[1]))
    return counts.where(for_it | against)


def score(docs: DataFrame, model: Severity, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_severity from 0 to 2, p_toxic, grade, toxic), a row for each row of docs.

    Null, empty and wordless texts have no features and are harmless; repeated rows and null ids are scored each. Texts are
    read whole, however long. Other columns are not read, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text", 1 << 20):
            p1, p2 = model.scores(b.column("text").to_pylist())
            grade = (p1 >= 0.5).astype(np.int32) + (p2 >= 0.5)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p1 + p2), pa.array(p1), pa.array(grade, pa.int32()), pa.array(p1 >= 0.5)], ["id", "expected_severity", "p_toxic", "grade", "toxic"])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(judge, f"id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", doc_id)


def harmless(docs: DataFrame, model: Severity, *, text: str = "text") -> DataFrame:
    """The rows of docs that score() would not call toxic, each judged by itself in one pass, whatever its id."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, text, 1 << 20):
            yield b.filter(pa.array(model.scores(b.column(text).to_pylist())[0] < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
