"""A corpus from documents: toxic ones go, copies go, benchmark passages go, and the rest is mixed to target weights.

Each stage works on all that the one before kept. The last one returns the documents' columns with copies, how often
each is to be taken (0: not in this mix), and size, source_size, target and taken in words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import cut, read
from sylva.llm.decontaminate import clean
from sylva.llm.mixing import mix
from sylva.llm.simhash import near_dedup
from sylva.llm.toxicity import harmless, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely harmless than not; the model is fitted on labelled rows of docs.

    Every row is judged by itself: rows with a null or a repeated id stay or go by their own texts. Null, empty and
    wordless texts are harmless. Without labels of both kinds, or without documents, nothing is rejected.
    """
    docs = docs.select(*COLUMNS)
    return harmless(docs, train(docs, read(spark, sf_dir, "labels")))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, five-word shingles and a similarity of 0.8.

    The one of the smallest id stays, a null id being the largest. Rows that share an id are told apart by their texts.
    All null, empty and wordless texts are one group.
    """
    return near_dedup(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; every row is judged by itself, whatever its id.

    Null and empty texts hold none. With an empty benchmark all stay.
    """
    return clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their copies in the mix.

    Rows are told apart by all their columns, so that null and repeated ids have shares of their own; rows that are the
    same throughout are numbered, and each has its share. Null, empty and wordless texts have size 0 and no copies.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(s), *[F.struct(c) for c in COLUMNS])) for s in (0, 1)]))
    plan = cut(mix(docs, doc_id="_key", numbered=True).select(F.col("_key").alias("_id"), "copy", "size", "source_size", "target", "copies", "taken"))
    added = ["size", "source_size", "target", "copies", "taken"]
    single = docs.join(plan.where("copy = 1"), F.col("_key") == F.col("_id")).select(*COLUMNS, *added, "_key")
    many = plan.where("copy > 1").select(F.col("_id").alias("_more")).distinct()
    if many.isEmpty():
        return single.drop("_key")
    once = single.join(many, F.col("_key") == F.col("_more"), "left_anti").drop("_key")
    again = single.join(many, F.col("_key") == F.col("_more"), "left_semi").select(*COLUMNS, "_key").groupBy(*COLUMNS, "_key").agg(F.count("*").alias("_n"))
    return once.unionByName(again.join(plan, F.col("_key") == F.col("_id")).select(*COLUMNS, *added))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("SimHash near-dedup", simhash),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: SQL cannot express the trained classifier, the alignment or the rounding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
