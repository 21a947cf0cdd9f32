"""Versioned relational tables of a graph, back-translation, and checks of schema and references."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import meta_map

VERSION = "1.0.0"
RELATIONS = ("contains", "imports", "sibling")
CONFIDENCE = ("EXTRACTED", "INFERRED")
TYPES = ("physical_folder", "physical_file")


def to_tables(nodes: DataFrame, edges: DataFrame, impact: DataFrame | None = None) -> dict[str, DataFrame]:
    """folders_hierarchy, files_identity, import_dependencies and impact_metrics; typed also when empty."""
    m, version, zero = "physical_meta.", F.lit(VERSION).alias("schema_version"), F.lit(0).cast("long")
    folders = nodes.where("node_type = 'physical_folder'").select(
        F.col("id").alias("folder_id"), F.col("label").alias("folder_name"), F.col("source_file").alias("relative_path"),
        F.coalesce(m + "depth", F.lit(0)).alias("depth"), F.coalesce(m + "layer", F.lit("nested")).alias("layer"),
        F.coalesce(m + "file_count", zero).alias("file_count"), F.coalesce(m + "subfolder_count", zero).alias("subfolder_count"),
        F.coalesce(m + "weight_score", F.lit(0.0)).alias("weight_score"), F.coalesce(m + "entropy_contribution", F.lit(0.0)).alias("entropy_contribution"),
        P.list_text(F.col(m + "nesting_chain")).alias("nesting_chain"), F.coalesce(m + "path_length", F.lit(0)).alias("path_length"), version,
    )
    held = nodes.where("node_type = 'physical_file'")
    if impact is not None:
        held = held.join(impact.select("id", "direct_impact", "transitive_impact"), "id", "left")
    else:
        held = held.withColumn("direct_impact", zero).withColumn("transitive_impact", zero)
    files = held.select(
        F.col("id").alias("file_id"), F.col("label").alias("file_name"), F.col("source_file").alias("relative_path"),
        F.coalesce(m + "extension", F.lit("")).alias("extension"), F.coalesce(m + "depth", F.lit(0)).alias("depth"), F.coalesce(m + "layer", F.lit("module")).alias("layer"),
        F.coalesce(m + "size_bytes", zero).alias("size_bytes"), P.inferred_parent(F.col("id")).alias("parent_folder_id"),
        F.coalesce(m + "impact_ratio", F.lit(0.0)).alias("impact_ratio"), F.coalesce("direct_impact", zero).alias("direct_impact"),
        F.coalesce("transitive_impact", zero).alias("transitive_impact"), F.coalesce(m + "is_entry_point", F.lit(False)).alias("is_entry_point"),
        (F.coalesce("direct_impact", zero) > 20).alias("is_god_file"), version,
    )
    imports = edges.where("relation = 'imports'").select(
        F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.coalesce("meta.line", F.lit(0)).alias("line_number"),
        (F.col("confidence") == "EXTRACTED").alias("is_resolved"), zero.alias("caller_count"), zero.alias("called_count"), version,
    )
    metrics = files.select("file_id", "direct_impact", "transitive_impact", "impact_ratio", "is_entry_point", "is_god_file", "schema_version")
    return {"folders_hierarchy": folders, "files_identity": files, "import_dependencies": imports, "impact_metrics": metrics}


#: Columns of the tables that are metadata of a node, and their types in it.
FOLDER_META = ("depth", "layer", "file_count", "subfolder_count", "weight_score", "entropy_contribution", "nesting_chain", "path_length")
FILE_META = ("extension", "depth", "layer", "size_bytes", "parent_folder_id", "impact_ratio", "direct_impact", "transitive_impact", "is_entry_point", "is_god_file")
NODE = "id string, label string, node_type string, source_file string, physical_meta map<string, string>"


def to_graph(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Nodes (metadata as a map of JSON values), import edges with meta, and metadata of the tables that there are."""
    spark, parts = next(iter(tables.values())).sparkSession if tables else SparkSession.active(), []
    for name, kind, prefix, meta in (("folders_hierarchy", TYPES[0], "folder", FOLDER_META), ("files_identity", TYPES[1], "file", FILE_META)):
        if (t := tables.get(name)) is not None:
            held = [c for c in meta if c in t.columns]
            pick = lambda c, t=t: F.col(c) if c in t.columns else F.lit(None).cast("string")
            named = t.select(F.col(f"{prefix}_id").alias("id"), F.coalesce(pick(f"{prefix}_name"), F.lit("")).alias("label"), F.lit(kind).alias("node_type"), pick("relative_path").alias("source_file"), F.struct(F.lit(1).alias("_"), *held).alias("m"))
            parts.append(named.withColumn("physical_meta", meta_map(F.col("m"), held)).drop("m") if held else named.withColumn("physical_meta", F.expr("cast(map() as map<string, string>)")).drop("m"))
    nodes = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], NODE)
    t = tables.get("import_dependencies")
    if t is None:
        t = spark.createDataFrame([], "source_id string, target_id string, line_number long, is_resolved boolean")
    confidence = F.when(F.col("is_resolved") if "is_resolved" in t.columns else F.lit(False), CONFIDENCE[0]).otherwise(CONFIDENCE[1])
    line = F.coalesce("line_number", F.lit(0)) if "line_number" in t.columns else F.lit(0)
    edges = t.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit("imports").alias("relation"), confidence.alias("confidence"), F.struct(line.cast("int").alias("line"), F.lit(None).cast("string").alias("statement")).alias("meta"))
    return nodes, edges, {"analyzer": "relational_reverse_v1", "schema_version": VERSION}


def violations(nodes: DataFrame | None, edges: DataFrame | None, metadata: Mapping[str, Any] | None) -> DataFrame:
    """(rule, subject) for each breach of the graph's schema; no row: valid. A root that is None is missing."""
    spark = next((df.sparkSession for df in (nodes, edges) if df is not None), None) or SparkSession.active()
    roots = {"nodes": nodes, "edges": edges, "metadata": metadata}
    if missing := [(f"root key missing: {k}", None) for k, v in roots.items() if v is None]:
        return spark.createDataFrame(missing, "rule string, subject string")
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    of = lambda df, rule, when, subject: df.where(when).select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    held = F.col("physical_meta").isNull() if "physical_meta" in nodes.columns else F.lit(True)
    whole = edges.where(~(blank("source") | blank("target")))
    out = [
        of(nodes, "node id missing", blank("id"), "label"),
        of(nodes, "node label missing", blank("label"), "id"),
        of(nodes, "node type unknown", ~F.coalesce(F.col("node_type").isin(*TYPES), F.lit(False)), "id"),
        of(nodes, "node metadata missing", held, "id"),
        nodes.where(~blank("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("node id repeated"), "id"),
        of(edges, "edge end missing", blank("source") | blank("target"), "source"),
        of(whole, "relation unknown", ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)), "source"),
        of(whole, "confidence unknown", ~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "source"),
    ]
    for end in ("source", "target"):
        out.append(whole.join(nodes.select(F.col("id").alias(end)), end, "left_anti").select(F.lit(f"edge {end} unknown"), end))
    if lost := [(f"metadata {k} missing", None) for k in ("analyzer", "root_path") if not metadata.get(k)]:
        out.append(spark.createDataFrame(lost, "rule string, subject string"))
    return reduce(DataFrame.union, out)


def _ids(tables: Mapping[str, DataFrame], table: str, column: str) -> DataFrame | None:
    df = tables.get(table)
    return df.select(F.col(column).alias("x")) if df is not None and column in df.columns else None


def references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, total_rows, orphan_ids): distinct ids that a table refers to and another lacks; absent tables have none.

    Rows of imports count if both their ends are there, those of parents if they have one.
    """
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    none = spark.createDataFrame([], "x string")
    known = {k: ids if (ids := _ids(tables, *k)) is not None else none for k in (("files_identity", "file_id"), ("folders_hierarchy", "folder_id"))}
    files, folders = known.values()
    whole = dict(tables)
    if (t := tables.get("import_dependencies")) is not None:
        whole["import_dependencies"] = t.dropna(subset=["source_id", "target_id"])
    checks = (
        ("import source", "import_dependencies", "source_id", files),
        ("import target", "import_dependencies", "target_id", files),
        ("parent folder", "files_identity", "parent_folder_id", folders),
        ("impact file", "impact_metrics", "file_id", files),
    )
    out = []
    for name, table, column, own in checks:
        if (ids := _ids(whole, table, column)) is not None:
            ids = ids.dropna()
            lost = ids.distinct().join(own, "x", "left_anti").agg(F.count("*").alias("orphan_ids"))
            out.append(ids.agg(F.count("*").alias("total_rows")).crossJoin(lost).select(F.lit(name).alias("check_name"), "total_rows", "orphan_ids"))  # one row each
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "check_name string, total_rows long, orphan_ids long")


@dataclass
class RefCheck:
    is_valid: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stats: dict[str, int] = field(default_factory=dict)


# What is told of each kind of orphan.
WARNINGS = {
    "import source": "import_dependencies: {} source IDs missing in files_identity.",
    "import target": "import_dependencies: {} target IDs missing in files_identity.",
    "parent folder": "files_identity: {} orphan parent_folder_id references.",
    "impact file": "impact_metrics: {} IDs missing in files_identity.",
}


def check_references(tables: Mapping[str, DataFrame]) -> RefCheck:
    """Orphans are warnings; only tables without any id at all are an error. Stats take distinct orphans from rows."""
    ids = [_ids(tables, *k) for k in (("files_identity", "file_id"), ("folders_hierarchy", "folder_id"))]
    if all(x is None or x.dropna().isEmpty() for x in ids):
        return RefCheck(False, ["Critical: No valid entity IDs found in files_identity or folders_hierarchy."])
    rows = {r["check_name"]: r for r in references(tables).collect()}
    out = RefCheck(warnings=[WARNINGS[k].format(r["orphan_ids"]) for k, r in rows.items() if r["orphan_ids"]])
    if "import source" in rows:
        out.stats["import_edges_total"] = total = rows["import source"]["total_rows"]
        out.stats["import_edges_valid"] = total - rows["import source"]["orphan_ids"] - rows["import target"]["orphan_ids"]
    if "parent folder" in rows:
        out.stats["files_with_valid_parent"] = rows["parent folder"]["total_rows"] - rows["parent folder"]["orphan_ids"]
    return out
