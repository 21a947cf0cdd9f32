"""Whole analyses of a directory tree: scan, metrics, identity, references, graph, findings, reports."""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import imports as I
from ..operators import insights as N
from ..operators import relational as R
from ..sources import tables, tree
from .config import DEPENDENCY, IMPACT, LEGACY, PENALTIES, STRUCTURE, Config, load
from .lineage import cut
from .render import RENDERERS, to_legacy_markdown

#: Cycles that a report lists; all are in the analysis.
LISTED = 100


@dataclass
class Analysis:
    root: str
    folders: DataFrame
    files: DataFrame
    imports: DataFrame
    nodes: DataFrame
    edges: DataFrame
    impact: DataFrame
    cycles: DataFrame
    entropy: DataFrame
    errors: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)


class AnalysisError(RuntimeError):
    pass


def run_analysis(spark: SparkSession, root: str, overrides: Mapping[str, Any] | None = None, config: Config | None = None) -> Analysis:
    """Frames of a tree's graph. Raises if the tree holds no file, or if what comes out breaks the graph's schema."""
    if not os.path.isdir(root):
        raise AnalysisError(f"[FAIL-FAST] scan: no folder {root}")
    config = (config or load(root)).overlay(overrides or {})
    listing = cut(tree.scan(spark, root, config.ignore, config.max_file_mb))
    fs_files = listing.where("kind = 'file'").select("rel_path", "parent_path", "name", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "content")
    fs_folders = listing.where("kind = 'folder'").select("rel_path")
    if fs_files.isEmpty():
        raise AnalysisError("[FAIL-FAST] classify: no files")
    folders = cut(H.folder_metrics(fs_folders, fs_files, root=os.path.basename(os.path.abspath(root)), rules=config.layer_rules, coeffs=config.weights))
    files = cut(H.file_identity(fs_files, rules=config.layer_rules, max_file_mb=config.max_file_mb))
    texts = files.select("file_id", "rel_path", "extension").join(fs_files.select("rel_path", "content"), "rel_path")
    imports = cut(I.resolve(I.extract(texts), files))
    links = G.import_edges(imports, files)
    edges = cut(G.contains_edges(folders, files).unionByName(G.sibling_edges(folders)).unionByName(links))
    ids = files.select(F.col("file_id").alias("id"))
    own = cut(G.valid_imports(edges, ids))
    impact = cut(G.impact(ids, own))
    errors = listing.where("error is not null").select("rel_path", "error", F.lit("scan").alias("stage")).union(H.oversized(fs_files, config.max_file_mb))
    metadata = {"analyzer": "structure_v1", "root_path": os.path.abspath(root), "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    out = Analysis(root, folders, files, imports, cut(G.nodes(folders, files, impact)), edges, impact, cut(G.cycles(own)), H.entropy(H.depth_histogram(fs_files)), errors, metadata)
    if broken := R.violations(out.nodes, out.edges, metadata).limit(5).collect():
        raise AnalysisError("[FAIL-FAST] graph: " + "; ".join(f"{r['rule']}: {r['subject']}" for r in broken))
    return out


def aggregated_metrics(a: Analysis) -> dict[str, Any]:
    """Frames of entry points and cycles, and the counts of a graph document."""
    points = a.impact.where("is_entry_point").select("id")
    return {
        "entry_point_candidates": points, "circular_dependencies": a.cycles, "total_nodes": a.nodes.count(), "total_edges": a.edges.count(),
        "parse_errors_count": a.errors.count(), "global_entropy": a.entropy.first()[0], **I.totals(a.imports).first().asDict(),
    }


def write_graph(a: Analysis, folder: str) -> None:
    """The graph document as folders of JSON lines (nodes, edges, entry points, cycles) and one file of metadata and counts."""
    found = aggregated_metrics(a)
    frames = {"nodes": a.nodes, "edges": a.edges, **{k: v for k, v in found.items() if isinstance(v, DataFrame)}}
    for name, df in frames.items():
        df.write.mode("overwrite").json(os.path.join(folder, name))
    counts = {k: v for k, v in found.items() if k not in frames}
    a.nodes.sparkSession.createDataFrame([(json.dumps({"metadata": a.metadata, "aggregated_metrics": counts}),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "metadata"))


def run_analysis_safe(spark: SparkSession, root: str, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Never raises; errors are distinct, in the order of their files."""
    try:
        data = run_analysis(spark, root, overrides)
        told = data.errors.groupBy(F.concat("stage", F.lit(": "), "error").alias("e")).agg(F.min("rel_path").alias("p")).orderBy("p", "e")
        return {"success": True, "data": data, "errors": [r["e"] for r in told.collect()], "warnings": [], "metadata": data.metadata}
    except Exception as e:
        text = str(e) if isinstance(e, AnalysisError) else f"[FAIL-FAST] {type(e).__name__}: {e}"
        return {"success": False, "data": None, "errors": [text], "warnings": [], "metadata": {"root_path": root}}


# Findings


def _files(a: Analysis) -> DataFrame:
    return a.files.select(F.col("file_id").alias("id"), "layer").join(a.impact.select("id", "impact_ratio", F.col("direct_impact").alias("inbound")), "id")


def _heads(a: Analysis) -> DataFrame:
    return a.cycles.select(F.col("cycle")[0].alias("id"))


def _structure(a: Analysis, limits: Mapping[str, Any]) -> DataFrame:
    return N.structure(a.folders.withColumnRenamed("folder_id", "id"), a.entropy if limits.get("with_entropy") else None, limits)


Extractor = Callable[[Analysis, Mapping[str, Any]], DataFrame]
#: Extractors by id with their default thresholds; register() adds to them.
EXTRACTORS: dict[str, tuple[Extractor, Mapping[str, Any]]] = {
    "structure": (_structure, STRUCTURE),
    "dependency": (lambda a, limits: N.dependency(_heads(a), limits), DEPENDENCY),
    "impact": (lambda a, limits: N.impact(_files(a), limits), IMPACT),
}


def register(extractor_id: str, extract: Extractor, defaults: Mapping[str, Any] | None = None) -> None:
    """Adds an extractor: a function from an analysis and thresholds to findings with the columns of the others."""
    if not callable(extract):
        raise TypeError(f"extractor {extractor_id!r} is not callable")
    EXTRACTORS[extractor_id] = (extract, defaults or {})


def find_insights(spark: SparkSession, a: Analysis, config: Config, with_entropy: bool = False, active: Iterable[str] = ("structure", "dependency", "impact")) -> DataFrame:
    """Findings of the active extractors that are registered, each with its own thresholds."""
    out = None
    for name in [x for x in active if x in EXTRACTORS]:
        extract, defaults = EXTRACTORS[name]
        found = extract(a, {**config.limit(name, defaults), **({"with_entropy": True} if with_entropy else {})})
        out = found if out is None else out.unionByName(found)
    return out if out is not None else N.dependency(_heads(a).limit(0))


def raw_findings(a: Analysis, active: Iterable[str] = ("structure", "dependency", "impact")) -> dict[str, dict[str, DataFrame]]:
    found = N.raw_findings(a.folders.withColumnRenamed("folder_id", "id"), a.edges, a.cycles, a.entropy)
    return {k: found[k] for k in active if k in found}


def report(spark: SparkSession, a: Analysis, config: Config | None = None, active: Iterable[str] = ("structure", "dependency", "impact"), penalties: Mapping[str, float] = PENALTIES, with_entropy: bool = False) -> dict[str, Any]:
    config, active = config or Config(), [x for x in active if x in EXTRACTORS]
    found = cut(find_insights(spark, a, config, with_entropy, active))
    total = a.nodes.count()
    health = N.health(found, total, penalties).first().asDict()
    rows = [r.asDict(recursive=True) for r in found.orderBy("rank", "insight_id").collect()]
    actions = [r.asDict() for r in N.recommendations(found).collect()]
    cycles = [r["cycle"] for r in a.cycles.orderBy(F.size("cycle"), "cycle").limit(LISTED).collect()]
    about = {"total_nodes": total, "total_edges": a.edges.count(), "total_cycles": a.cycles.count(), "active_extractors": active}
    return {**health, **about, "metadata": a.metadata, "cycles": cycles, "insights": rows, "recommendations": actions, "thresholds_applied": dict(config.thresholds)}


def ranked_lists(a: Analysis) -> dict[str, list[dict[str, Any]]]:
    """Heaviest and deepest folders, most imported files (ten each) and the first twenty orphans."""
    files = a.files.select(F.col("file_id").alias("id"), "name", "layer").join(a.impact.select("id", F.col("direct_impact").alias("imported_by")), "id")
    folders = a.folders.select(F.col("folder_id").alias("id"), "label", "depth", "weight_score")
    lists = {
        "top_heaviest_folders": N.top(folders, [F.desc("weight_score"), "id"], 10),
        "deepest_paths": N.top(folders, [F.desc("depth"), "id"], 10),
        "most_depended_files": N.top(files.select("id", "name", "imported_by"), [F.desc("imported_by"), "id"], 10),
        "orphan_files": N.top(files.where("imported_by = 0 and layer <> 'test'").select("id"), ["id"], 20),
    }
    return {k: [r.asDict() for r in df.collect()] for k, df in lists.items()}


def legacy_report(spark: SparkSession, a: Analysis, thresholds: Mapping[str, Any] | None = None, with_entropy: bool = False) -> dict[str, Any]:
    """The older engine's report: its findings, strict score, actions and ranked lists."""
    limits = {**LEGACY, **(thresholds or {})}
    found = cut(N.legacy(a.folders.withColumnRenamed("folder_id", "id"), _files(a), a.edges, _heads(a), a.entropy if with_entropy else None, limits))
    rows = [r.asDict(recursive=True) for r in found.orderBy(F.substring_index("insight_id", "-", -1).cast("int")).collect()]
    about = {"generated_at": a.metadata.get("timestamp"), "project_root": a.metadata.get("root_path"), "total_nodes": a.nodes.count(), "total_edges": a.edges.count()}
    health = N.health(found, about["total_nodes"]).first()["strict_score"]
    actions = [r.asDict() for r in N.recommendations(found).collect()]
    return {"report_version": "1.1.0", "metadata": {**about, "health_score": health}, "insights": rows, "recommendations": actions, "ranked_lists": ranked_lists(a), "thresholds_applied": limits}


def write_legacy_report(made: Mapping[str, Any], out: str) -> None:
    os.makedirs(out, exist_ok=True)
    for name, text in (("architectural_insights.json", json.dumps(made, indent=2, default=str)), ("architectural_insights.md", to_legacy_markdown(made))):
        with open(os.path.join(out, name), "w", encoding="utf-8") as f:
            f.write(text)


def main(spark: SparkSession, root: str, out: str, overrides: Mapping[str, Any] | None = None, formats: tuple[str, ...] = ("json", "markdown")) -> int:
    """Writes reports to out; 0 for a health of 80 or more, 1 from 60, 2 below, 3 if the analysis failed."""
    try:
        config = load(root).overlay(overrides or {})
        made = report(spark, run_analysis(spark, root, overrides), config)
        os.makedirs(out, exist_ok=True)
        for fmt in formats:
            suffix, render = RENDERERS[fmt]
            with open(os.path.join(out, f"structure_report.{suffix}"), "w", encoding="utf-8") as f:
                f.write(render(made))
        return int(made["exit_code"])
    except Exception:
        return 3


# Tables


def export_relational(a: Analysis, fmt: str, folder: str, **options) -> tables.Report:
    """The four tables of a graph that keeps to its schema; raises ValueError for one that does not."""
    if broken := R.violations(a.nodes, a.edges, a.metadata).limit(5).collect():
        raise ValueError("not a valid graph: " + "; ".join(f"{r['rule']}: {r['subject']}" for r in broken))
    return tables.export(R.to_tables(a.nodes, a.edges, a.impact), folder, fmt, **options)


def import_relational(spark: SparkSession, source: str, fmt: str, existing: tuple[DataFrame, DataFrame, Mapping[str, Any]] | None = None, **options) -> tuple[G.Merged, tables.Report]:
    """Tables back as a graph, merged into an existing one (nodes with metadata maps, edges, metadata) if there is one.

    Raises if a table cannot be loaded; another version and references without a row are told as warnings.
    """
    got = tables.load(spark, source, fmt, **options)
    if not got.success:
        raise RuntimeError(f"import failed: {got.warnings}")
    if got.version != R.VERSION:
        got.warnings.append(f"schema version {got.version}, expected {R.VERSION}")
    checked = R.check_references(got.tables)
    got.warnings += checked.errors + checked.warnings
    new = R.to_graph(got.tables)
    old = existing or (new[0].limit(0), new[1].limit(0), {})
    return G.safe_merge(old, new), got


def graph_of(a: Analysis) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """An analysis as a graph that safe_merge takes."""
    return a.nodes.withColumn("physical_meta", G.meta_map(F.col("physical_meta"), G.META)), a.edges, a.metadata


@dataclass
class Hook:
    """Adds an analysis to what a host pipeline already has; off, it changes nothing, and it never raises."""

    enabled: bool = False
    notes: dict[str, Any] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, root: str, existing: dict[str, Any]) -> dict[str, Any]:
        if not self.enabled:
            return existing
        got = run_analysis_safe(spark, root)
        notes = {"analysed": got["success"], "errors": got["errors"]}
        if not got["success"]:
            return {**existing, "metadata": {**existing.get("metadata", {}), **notes}}
        try:
            new = graph_of(got["data"])
            if existing.get("nodes") is None or existing.get("edges") is None:
                return {**existing, "nodes": new[0], "edges": new[1], "metadata": {**existing.get("metadata", {}), **new[2], **notes}}
            merged = G.safe_merge((existing["nodes"], existing["edges"], existing.get("metadata", {})), new)
            return {**existing, "nodes": merged.nodes, "edges": merged.edges, "metadata": {**merged.metadata, **notes}}
        except Exception as e:
            return {**existing, "metadata": {**existing.get("metadata", {}), "analysed": False, "errors": [str(e)]}}


def add_flags(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--codebase-report", action="store_true")
    parser.add_argument("--report-format", choices=sorted(RENDERERS), default="markdown")
    parser.add_argument("--relational-export", choices=["csv", "hdf5", "parquet", "postgresql"])
    parser.add_argument("--output", default="structure-out")
