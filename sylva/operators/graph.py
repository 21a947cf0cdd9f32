"""The property graph: nodes, edges, reachability, cycles, merge."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..plans.lineage import cut, numbered
from .pieces import settled
from .reach import counted_reach, cyclic_components, numbered_graph, numbered_pairs, reach_counts, strong_components  # noqa: F401

#: Siblings that a folder is tied to, and the hops that reverse reachability goes.
NEXT_SIBLINGS, HOPS = 10, 51
META = ["depth", "layer", "file_count", "subfolder_count", "weight_score", "entropy_contribution", "nesting_chain", "path_length", "extension", "size_bytes", "impact_ratio", "is_entry_point"]


def nodes(folders: DataFrame, files: DataFrame, impact: DataFrame | None = None) -> DataFrame:
    """(id, label, node_type, source_file, physical_meta) of folders and files; impact adds its two fields to files."""
    one = folders.select(F.col("folder_id").alias("id"), "label", F.lit("physical_folder").alias("node_type"), F.lit(None).cast("string").alias("source_file"), "depth", "layer", "file_count", "subfolder_count", "weight_score", "entropy_contribution", "nesting_chain", "path_length")
    two = files.select(F.col("file_id").alias("id"), F.col("name").alias("label"), F.lit("physical_file").alias("node_type"), F.col("rel_path").alias("source_file"), "depth", "layer", "extension", "size_bytes")
    if impact is not None:
        two = two.join(impact.select("id", "impact_ratio", "is_entry_point"), "id", "left")
    both = one.unionByName(two, allowMissingColumns=True)
    for c, kind in (("impact_ratio", "double"), ("is_entry_point", "boolean")):
        both = both if c in both.columns else both.withColumn(c, F.lit(None).cast(kind))
    return both.select("id", "label", "node_type", "source_file", F.struct(*META).alias("physical_meta"))


def _edges(df: DataFrame, relation: str, meta: str = "null") -> DataFrame:
    return df.select("source", "target", F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.expr(f"cast({meta} as struct<line: int, statement: string>)").alias("meta"))


def contains_edges(folders: DataFrame, files: DataFrame) -> DataFrame:
    ends = files.join(folders.select(F.col("rel_path").alias("parent_path"), F.col("folder_id").alias("source")), "parent_path")
    return _edges(ends.withColumn("target", F.col("file_id")), "contains")


def sibling_edges(folders: DataFrame, ahead: int = NEXT_SIBLINGS) -> DataFrame:
    """Each folder with the next ones of its parent by id, by position alone and without a self-join.

    Folders are cut into ranges of (parent, id), however many a parent has, and each range also gets the first rows after
    it, so that all look ahead within a range. What is put in one place is a few rows a range.
    """
    order = ["parent_path", "folder_id"]
    own = folders.where("parent_path is not null").select(*order)
    ranged = cut(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    heads = cut(ranged.withColumn("_at", place).where(F.col("_at") <= ahead).drop("_at"))
    heads = cut(heads.withColumn("_n", F.row_number().over(Window.orderBy(*order))))  # at most ahead rows a range
    starts = heads.groupBy("_part").agg(F.min("_n").alias("_start"))
    after = starts.where("_start > 1").select((F.col("_start") - 1).alias("_last"), "_start")
    before = heads.select(F.col("_n").alias("_last"), F.col("_part").alias("_to"))
    halo = after.join(before, "_last").select("_to", F.explode(F.sequence(F.col("_start"), F.col("_start") + ahead - 1)).alias("_n"))
    halo = halo.join(heads.select("_n", *order), "_n").select(*order, F.col("_to").alias("_part"), F.lit(True).alias("_halo"))
    both = ranged.select(*order, "_part", F.lit(False).alias("_halo")).union(halo)
    by = Window.partitionBy("_part").orderBy(*order)
    later = F.array(*[F.when(F.lead("parent_path", k).over(by) == F.col("parent_path"), F.lead("folder_id", k).over(by)) for k in range(1, ahead + 1)])
    each = both.withColumn("_later", later).where(~F.col("_halo")).select(F.col("folder_id").alias("source"), F.explode(F.array_compact("_later")).alias("target"))
    return _edges(each, "sibling")


def import_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    ends = resolved.where("is_resolved").join(files.select(F.col("rel_path").alias("resolved_path"), F.col("file_id").alias("target")), "resolved_path")
    return _edges(ends.withColumnRenamed("file_id", "source"), "imports", "struct(line_number as line, raw_statement as statement)")


def valid_imports(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Imports of which both ends are nodes; multi-edges stay."""
    one = edges.where("relation = 'imports'").join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    return one.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")


def inbound(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inbound"))


def impact(files: DataFrame, imports: DataFrame, hops: int = HOPS, once: bool = False) -> DataFrame:
    """(id, direct_impact, transitive_impact, impact_ratio, is_entry_point) of every file; once: repeated imports count as one.

    Imports are read once: what they count is taken from the numbered pairs, and the result is written for all its uses.
    """
    named, pairs = numbered_pairs(imports)
    reach = cut(counted_reach(named, pairs.select("a", "b").dropna(), hops))
    came = pairs.where("b is not null").groupBy(F.col("b").alias("v")).agg((F.count("*") if once else F.sum("n")).alias("inbound")).join(named, "v").select("id", "inbound")
    ids = files.select("id")
    total = ids.agg(F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    out = ids.join(came, "id", "left").join(reach, "id", "left").crossJoin(F.broadcast(total))
    moved = F.coalesce("transitive_impact", zero)
    return cut(out.select("id", F.coalesce("inbound", zero).alias("direct_impact"), moved.alias("transitive_impact"), F.when(F.col("total") > 0, moved / F.col("total")).otherwise(0.0).alias("impact_ratio"), F.col("inbound").isNull().alias("is_entry_point")))


def cycles(imports: DataFrame) -> DataFrame:
    """(cycle: its nodes, the first again at the end): one for each edge that closes a cycle of its component's tree.

    The tree of a component holds the shortest paths from its smallest member, of several the first in order; an edge from
    a node to one on that node's path closes a cycle. So each cycle's first node is its nearest to that member, every
    component has a cycle, and one that is a mere ring has exactly itself. Small pieces of the graph are settled by the
    tasks that read them, the others by rounds.
    """
    small, rest = settled(imports)
    return small if rest.isEmpty() else small.union(_tree_cycles(rest))


def _tree_cycles(imports: DataFrame) -> DataFrame:
    """cycles of a graph whose components are of any size, level by level of all trees at once."""
    ids, edges = numbered_graph(imports)
    members = strong_components(edges, ids.count())[0].select("v", "comp")
    named = cut(members.join(ids, "v"))
    one, two = members.toDF("a", "comp"), members.toDF("b", "_c")
    inner = cut(edges.join(one, "a").join(two, "b").where("comp = _c").select("a", "b"))
    least = named.groupBy("comp").agg(F.min("id").alias("id"))
    front = cut(least.join(named.select("v", "id"), "id").select("v", F.lit(0).cast("long").alias("rank"), F.array("v").alias("path"), F.array("id").alias("names")))
    seen = front
    while not front.isEmpty():
        # All paths of a level are of one length, so the least before a node is that of the least rank.
        came = front.select("v", "rank").join(inner, F.col("v") == F.col("a")).groupBy("b").agg(F.min("rank").alias("before"), F.min_by("a", "rank").alias("a"))
        fresh = came.select(F.col("b").alias("v"), "before", "a").join(seen.select("v"), "v", "left_anti").join(named.select("v", "id"), "v")
        ranked = numbered(fresh, ["before", "id"], "rank")
        before = front.select(F.col("v").alias("a"), "path", "names")
        front = cut(ranked.join(before, "a").select("v", "rank", F.concat("path", F.array("v")).alias("path"), F.concat("names", F.array("id")).alias("names")))
        seen = seen.union(front)
    closing = cut(inner.join(seen.select("v", "path"), F.col("v") == F.col("a")).withColumn("at", F.array_position("path", F.col("b")).cast("int")).where("at > 0").select("v", "at"))
    whole = closing.join(seen.select("v", "names"), "v")
    return whole.select(F.concat(F.slice("names", F.col("at"), F.size("names")), F.array(F.get("names", F.col("at") - 1))).alias("cycle"))


# Merging two graphs


def meta_map(meta: Column, names: list[str]) -> Column:
    """A flat struct of metadata as a map from name to JSON value, without its nulls."""
    text = lambda n: F.regexp_replace(F.to_json(F.array(meta[n])), r"(?s)^\[|\]$", "")
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.when(meta[n].isNotNull(), text(n)))]), lambda _, v: v.isNotNull())


def merge_nodes(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes (id, other columns, physical_meta: map from dotted path to JSON value) of both, with merge_state and repeats.

    A node of old keeps its columns and takes the metadata of the new ones of its id, path by path and in the given order;
    a value replaces what stands at its path, below it, or above it, and a JSON null is a value. Of the new ones of an
    unknown id the first is the node. Nodes without an id are left out. merge_state is kept, updated or new; repeats
    counts the new rows that changed a node. Rows of one id are never gathered: only the last value of each path is.
    """
    columns = [c for c in old.columns if c != "physical_meta"]
    at = F.col(order).cast("long") if order else F.lit(0).cast("long")
    shape = lambda df, side: df.where("id is not null and id <> ''").select(
        "id", F.struct(*[c for c in columns if c != "id"]).alias("own"), F.coalesce("physical_meta", F.expr("cast(map() as map<string, string>)")).alias("m"), F.struct(F.lit(side).alias("side"), (at if side else F.lit(0).cast("long")).alias("at")).alias("at")
    )
    both = shape(old, 0).union(shape(new, 1))
    heads = both.groupBy("id").agg(F.min_by("own", "at").alias("own"), F.count_if(F.col("at.side") == 0).alias("had"), F.count_if(F.col("at.side") == 1).alias("came"))
    leaves = both.select("id", "at", F.explode("m").alias("k", "v")).groupBy("id", "k").agg(F.max(F.struct("at", "v")).alias("x"))
    held = leaves.groupBy("id").agg(F.collect_list(F.struct(F.col("k"), F.col("x.at").alias("at"), F.col("x.v").alias("v"))).alias("all"))
    above = lambda a, b: F.startswith(b["k"], F.concat(a["k"], F.lit(".")))
    stays = lambda a: ~F.exists("all", lambda b: (b["at"] > a["at"]) & (above(a, b) | above(b, a)))
    kept = F.filter("all", stays)
    meta = F.map_from_entries(F.transform(F.array_sort(kept), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))
    out = heads.join(held.select("id", meta.alias("physical_meta")), "id", "left")
    state = F.when(F.col("had") == 0, "new").when(F.col("came") == 0, "kept").otherwise("updated")
    repeats = F.when(F.col("had") > 0, F.col("came")).otherwise(F.col("came") - 1)
    return out.select(*["id" if c == "id" else f"own.{c}" for c in columns], F.coalesce("physical_meta", F.expr("cast(map() as map<string, string>)")).alias("physical_meta"), state.alias("merge_state"), repeats.alias("repeats"))


def merged_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ids that merge_nodes gives for both, without the nodes."""
    return old.select("id").union(new.select("id")).where("id is not null and id <> ''").distinct()


def merge_edges(old: DataFrame, new: DataFrame, ids: DataFrame, order: str | None = None) -> DataFrame:
    """old and, for each key (source, target, relation) that it lacks, the first of new whose ends are nodes, with all columns."""
    key, at = ["source", "target", "relation"], F.col(order) if order in new.columns else F.lit(0)
    rest = [c for c in old.columns if c not in key]
    fresh = new.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])).groupBy(*key).agg(F.min_by(F.struct(*rest), at).alias("_rest")) if rest else new.select(*key).distinct()
    fresh = fresh.join(old.select(*key), key, "left_anti")
    for end in ("source", "target"):
        fresh = fresh.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return old.unionByName(fresh.select(*key, *[F.col("_rest")[c].alias(c) for c in rest]))


@dataclass
class Merged:
    nodes: DataFrame
    edges: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=dict)


def safe_merge(old: tuple[DataFrame, DataFrame, Mapping[str, Any]], new: tuple[DataFrame, DataFrame, Mapping[str, Any]], order: str | None = None) -> Merged:
    """Both graphs (nodes, edges, metadata) as one; merging the same again changes nothing but the counters."""
    nodes = cut(merge_nodes(old[0], new[0], order))
    edges = cut(merge_edges(old[1], new[1].drop(order) if order and order not in old[1].columns else new[1], nodes))
    row = nodes.agg(F.count_if(F.col("merge_state") == "new"), F.sum("repeats")).first()
    added = edges.count() - old[1].count()
    stats = {"new_nodes": row[0], "updated_nodes": row[1] or 0, "added_edges": added, "skipped_edges": new[1].count() - added}
    return Merged(nodes.drop("merge_state", "repeats"), edges, {**old[2], **new[2], "merge_report": stats}, stats)
