"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree, on DataFrames alone.

A document of a source with target / size = r is to be taken r times: floor(r) for sure and once more with probability
p = r - floor(r). Two fractional documents meet and move words from one to the other, in a random direction and by as
much as makes one of them integral, so the words of the pair stay as they are and every p keeps its mean. Documents
meet in blocks of about FAN of a source; what a block leaves over, one document, meets those of FAN blocks, and so on.
No group is larger than a block, however many documents a source has. Only the last document of a source is rounded to
the nearer side, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import numbered
from .common import cut, read, unit

FAN = 64
#: Sources of which the table of targets is broadcast; beyond it that join shuffles.
BROADCAST_SOURCES = 100_000
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) of sized (source, size); only sums come to the driver.

    The level is the words for each unit of weight among the sources below their limit; it rises until none passes.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    rank = numbered(per, [F.col("source").asc_nulls_last()], "_rank").withColumn("_rank", F.col("_rank") - 1)
    per = cut(rank.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))))
    total, level, full = None, 0.0, -1
    while True:
        over = F.col("limit") <= F.col("weight") * F.lit(level)
        row = per.agg(F.sum("source_size"), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        total = share * (row[0] or 0) if total is None else total
        if row[3] == full or not row[2]:
            break
        level, full = (total - (row[1] or 0.0)) / row[2], row[3]
    out = per.withColumn("target", F.least("limit", F.col("weight") * F.lit(level) if full >= 0 else F.lit(0.0)))
    return out.select("source", "source_size", "docs", "target")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


ITEM = "struct<u: double, id: string, copy: long, size: double, p: double>"
DONE = "array<struct<id: string, copy: long, one: int>>"


def _meet(held: Column, x: Column) -> Column:
    """held (left: the fractional item, done: those decided) after its item has met x."""
    a = held["left"]

    def moved(t: Column) -> Column:
        up = unit(x["id"], x["copy"], x["u"]) * (t["up"] + t["down"]) < t["down"]
        pa = F.when(up, F.when(t["up"] == t["a1"], 1.0).otherwise(a["p"] + t["up"] / a["size"])).otherwise(F.when(t["down"] == t["a0"], 0.0).otherwise(a["p"] - t["down"] / a["size"]))
        pb = F.when(up, F.when(t["up"] == t["b0"], 0.0).otherwise(x["p"] - t["up"] / x["size"])).otherwise(F.when(t["down"] == t["b1"], 1.0).otherwise(x["p"] + t["down"] / x["size"]))
        return F.struct(pa.alias("pa"), pb.alias("pb"))

    def parted(t: Column) -> Column:
        first = (t["pa"] <= 0) | (t["pa"] >= 1)
        item = lambda y, p: F.struct(y["u"].alias("u"), y["id"].alias("id"), y["copy"].alias("copy"), y["size"].alias("size"), p.alias("p"))
        done = lambda y, p: F.struct(y["id"].alias("id"), y["copy"].alias("copy"), (p >= 0.5).cast("int").alias("one"))
        return F.struct(
            F.when(first, item(x, t["pb"])).otherwise(item(a, t["pa"])).cast(ITEM).alias("left"),
            F.concat(held["done"], F.array(F.when(first, done(a, t["pa"])).otherwise(done(x, t["pb"])))).cast(DONE).alias("done"),
        )

    a1, a0, b0, b1 = (1 - a["p"]) * a["size"], a["p"] * a["size"], x["p"] * x["size"], (1 - x["p"]) * x["size"]
    masses = F.struct(F.least(a1, b0).alias("up"), F.least(a0, b1).alias("down"), a1.alias("a1"), a0.alias("a0"), b0.alias("b0"), b1.alias("b1"))
    return _let(_let(masses, moved), parted)


def _round(items: DataFrame, most_blocks: int) -> DataFrame:
    """(source, id, copy, one) of items (source, block, blocks, item)."""
    out, level = [], 0
    while True:
        ordered = F.sort_array(F.collect_list("item"))
        groups = items.groupBy("source", "block", "blocks").agg(ordered.alias("all"))
        start = F.struct(F.get("all", F.lit(0)).cast(ITEM).alias("left"), F.array().cast(DONE).alias("done"))
        folded = F.aggregate(F.slice("all", 2, F.size("all")), start, _meet)
        level += 1
        groups = cut(groups.select("source", "block", "blocks", folded.alias("held")))
        out.append(groups.select("source", F.explode("held.done").alias("x")).select("source", "x.*"))
        left = groups.select("source", (F.col("block") / FAN).cast("long").alias("block"), F.ceil(F.col("blocks") / FAN).alias("blocks"), "blocks", "held.left").toDF("source", "block", "blocks", "was", "item")
        out.append(left.where("was = 1").select("source", "item.id", "item.copy", (F.col("item.p") >= 0.5).cast("int").alias("one")))
        items = left.where("was > 1").withColumn("item", F.col("item").withField("u", unit("item.id", "item.copy", F.lit(level)))).drop("was")
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // FAN)
    done = out[0]
    for x in out[1:]:
        done = done.union(x)
    return done


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, numbered: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often each row of docs enters the mix.

    Sizes are words; null and empty texts have none and are never taken. A null source is a source, the last one.
    Repeated rows are told apart by a number and rounded one by one; null ids are ids. An empty table gives an empty one.
    Very long texts count whole. Reruns on the same rows agree, in whatever order and partitions they come; only the three
    columns named are read, so others may have any name. numbered: also copy, that number, from 1.
    """
    kind = docs.schema[doc_id].dataType
    sized = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    sized = cut(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    each = sized.select(F.col("id").cast("string").alias("id"), "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    per = cut(targets(each.select("source", "size"), weights, share, most))
    known = per.agg(F.count("*"), F.max("docs")).first()
    side = per.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if known[0] <= BROADCAST_SOURCES else side
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = each.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rated = rated.withColumn("base", F.when(F.col("size") > 0, F.floor(ratio)).otherwise(0)).withColumn("p", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0))
    u = unit(F.lit(seed), "id", "copy")
    item = F.struct(u.alias("u"), "id", "copy", F.col("size").cast("double").alias("size"), "p").cast(ITEM)
    blocks = F.ceil(F.col("docs") / FAN)
    live = rated.where("p > 0").select("source", F.pmod(F.xxhash64("id", "copy", F.lit(seed), F.lit("block")), blocks).alias("block"), blocks.alias("blocks"), item.alias("item"))
    ones = _round(live, -(-(known[1] or 1) // FAN)).select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("copy").alias("_copy"), "one").where("one = 1")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")) & F.col("source").eqNullSafe(F.col("_source"))
    out = rated.join(ones, same, "left").withColumn("copies", (F.col("base") + F.coalesce("one", F.lit(0))).cast("long"))
    return out.select(F.col("id").cast(kind).alias(doc_id), *(["copy"] if numbered else []), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))

