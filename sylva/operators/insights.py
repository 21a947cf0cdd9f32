"""Threshold rules over graph metrics: traceable findings, ranked lists, recommendations and health scores."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import DEPENDENCY, IMPACT, LEGACY, PENALTIES, STRICT_PENALTIES, STRUCTURE
from ..plans.lineage import numbered

# Fixed values: {code: (category, severity, title, recommendation, where the evidence stands)}.
RULES = {
    "DEPTH": ("nesting_complexity", "warning", "Excessive Folder Nesting", "Flatten hierarchy or apply domain-driven structure.", "nodes[*].physical_meta.depth"),
    "GODF": ("modular_violation", "warning", "Overloaded Folder (God Folder)", "Split by domain responsibility. Apply Vertical Slices.", "nodes[*].physical_meta.weight_score"),
    "FLAT": ("structural_organization", "info", "Flat Folder Structure", "Group related files into feature subdirectories.", "nodes[*].physical_meta.file_count"),
    "ENTR": ("structural_chaos", "warning", "High Nesting Entropy", "Standardize layering (src/core, src/api, src/utils).", "aggregated_metrics.global_entropy"),
    "CYCL": ("dependency_coupling", "critical", "Circular Import Chain", "Break cycles via interfaces or lazy imports.", "aggregated_metrics.circular_dependencies"),
    "HOTS": ("impact_concentration", "warning", "High Blast Radius Files", "Isolate core logic, add integration tests, document change contracts.", "nodes[*].physical_meta.impact_ratio"),
    "GODX": ("centralization_risk", "critical", "God Files / Dependency Hubs", "Apply Facade pattern, split responsibilities, enforce layer boundaries.", "import_dependencies.target_id"),
    "ORPH": ("dead_code_risk", "info", "Orphan Files Detected", "Review for deletion or archival.", "nodes[*].id"),
}
# The older engine's findings, in the same form.
OLD_RULES = {
    "CYCLE": ("dependency_coupling", "critical", "Circular Import Chain Detected", "Break cycles using interfaces, event buses, or lazy imports.", "aggregated_metrics.circular_dependencies"),
    "HOTSPOT": ("impact_concentration", "warning", "High Blast Radius Files", "Isolate core logic, add integration tests, and document change contracts.", "nodes[*].physical_meta.impact_ratio"),
    "GODFILE": ("centralization_risk", "critical", "God Files / High Dependency Hubs", "Apply Facade pattern, split responsibilities, and enforce layer boundaries.", "import_dependencies.target_id"),
    "UNRESOLVED": ("reference_integrity", "warning", "High Rate of Unresolved Imports", "Check sys.path configuration, verify virtual environments, or update import regex patterns.", "edges[*].confidence"),
    "DEPTH": ("nesting_complexity", "warning", "Excessive Folder Nesting", "Flatten hierarchy, apply domain-driven folder structure.", "nodes[*].physical_meta.depth"),
    "GODFOLDER": ("modular_violation", "warning", "Overloaded Folders (God Folders)", "Split by domain responsibility. Apply Vertical Slice Architecture.", "nodes[*].physical_meta.weight_score"),
    "FLAT": ("structural_organization", "info", "Flat Folder Structure", "Consider grouping related files into feature-specific subdirectories.", "nodes[*].physical_meta.file_count"),
    "ENTROPY": ("structural_chaos", "warning", "High Folder Nesting Entropy", "Flatten deep directories, apply consistent layering (src/core, src/api).", "aggregated_metrics.global_entropy"),
}
STATUS = {"critical": "FAIL", "warning": "WARN", "info": "PASS"}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _fixed(c: Column, places: int) -> Column:
    """A number with so many places, ties to even as the number's decimal form has them."""
    return F.bround(c, places).cast(f"decimal(38, {places})").cast("string")


def _finding(df: DataFrame, rules: Mapping[str, tuple], code: str, description: Column, metric: str, actual: Column, threshold: float, evidence: Column, extractor: str, order: int) -> DataFrame:
    category, severity, title, advice, path = rules[code]
    trace = F.struct(F.lit(metric).alias("metric_name"), actual.cast("double").alias("actual_value"), F.lit(float(threshold)).alias("threshold"), F.lit(STATUS[severity]).alias("status"), F.lit(path).alias("evidence_path"))
    return df.select(
        F.lit("GODF" if code == "GODX" else code).alias("code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
        F.lit(title).alias("title"), description.alias("description"), evidence.alias("evidence"), F.array(trace).alias("traceability_matrix"),
        F.lit(advice).alias("recommendation"), F.lit(extractor).alias("extractor_id"), F.lit(order).alias("rank"),
    )


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("INS-%s-001", "code").alias("insight_id"), *[x for x in found.columns if x != "code"])


def _running(found: DataFrame, order: list) -> DataFrame:
    out = numbered(found, order, "_n")
    return out.select(F.format_string("INS-%s-%03d", "code", "_n").alias("insight_id"), *[x for x in found.columns if x != "code"])


def structure(folders: DataFrame, entropy: DataFrame | None = None, limits: Mapping[str, Any] = STRUCTURE) -> DataFrame:
    """Findings of folders (id, label, depth, weight_score, file_count, subfolder_count), numbered in order of id."""
    c, quoted, own = {**STRUCTURE, **limits}, _text("'", F.col("label"), "'"), F.array("id")
    deep = folders.where(F.col("depth") > c["max_depth"])
    heavy = folders.where(F.col("weight_score") > c["folder_weight_god"])
    flat = folders.where((F.col("subfolder_count") == 0) & (F.col("file_count") > c["flat_folder_files"]))
    make = lambda *a: _finding(a[0], RULES, *a[1:-1], "structure", a[-1])
    out = make(deep, "DEPTH", _text(quoted, " depth (", F.col("depth"), f") > limit ({c['max_depth']})."), "folder_depth", F.col("depth"), c["max_depth"], own, 1)
    out = out.union(make(heavy, "GODF", _text(quoted, " weight (", _fixed(F.col("weight_score"), 2), ") > threshold."), "folder_weight", F.round("weight_score", 3), c["folder_weight_god"], own, 2))
    out = out.union(make(flat, "FLAT", _text(quoted, " has ", F.col("file_count"), " files, 0 subfolders."), "file_count", F.col("file_count"), c["flat_folder_files"], own, 3))
    if entropy is not None:
        e = F.col("global_entropy")
        out = out.union(make(entropy.where(e > c["entropy_warn"]), "ENTR", _text("Entropy ", _fixed(e, 2), " indicates irregular distribution."), "nesting_entropy", F.round(e, 3), c["entropy_warn"], F.array(F.lit("root_hierarchy")), 4))
    return _running(out, [F.when(F.col("code") == "ENTR", 1).otherwise(0), F.col("evidence")[0], "rank"])


def _first(df: DataFrame, n: int) -> DataFrame:
    """One row: e, the n smallest ids; no more than n are ever in one place."""
    return df.select("id").orderBy("id").limit(n).agg(F.sort_array(F.collect_list("id")).alias("e"))


def _summed(df: DataFrame, least: float, n: int) -> DataFrame:
    """One row (n, e: the first n ids) if df has more than least rows, else none."""
    return df.agg(F.count("*").alias("n")).where(F.col("n") > least).crossJoin(_first(df, n))  # one row each


def dependency(heads: DataFrame, limits: Mapping[str, Any] = DEPENDENCY) -> DataFrame:
    """One critical finding if there are more cycles (one row each, id: its first node) than allowed."""
    c = {**DEPENDENCY, **limits}
    found = _summed(heads, c["cycles_allowed"], 3)
    return _named(_finding(found, RULES, "CYCL", F.format_string("Found %d cycles.", "n"), "cycles", F.col("n"), c["cycles_allowed"], F.col("e"), "dependency", 11))


def impact(files: DataFrame, limits: Mapping[str, Any] = IMPACT) -> DataFrame:
    """Findings of files (id, layer, impact_ratio, inbound); each tells of all files at once, with the first ten ids."""
    c = {**IMPACT, **limits}
    rules = (
        ("HOTS", F.col("impact_ratio") > c["impact_hotspot"], 0, f"%d files affect >{c['impact_hotspot'] * 100:.0f}%% of codebase.", "high_impact_files", 21),
        ("GODX", F.col("inbound") > c["god_file_impact"], 0, f"%d files imported by >{c['god_file_impact']} modules.", "god_files", 22),
        ("ORPH", (F.col("inbound") == 0) & (F.col("layer") != "test"), c["orphan_files_allowed"], "%d files have 0 inbound imports.", "orphan_count", 23),
    )
    out = [_finding(_summed(files.where(when), least, 10), RULES, code, F.format_string(text, "n"), metric, F.col("n"), least, F.col("e"), "impact", order) for code, when, least, text, metric, order in rules]
    return _named(reduce(DataFrame.union, out))


def unresolved(edges: DataFrame) -> DataFrame:
    """One row: how many imports could not be traced to a file."""
    return edges.agg(F.count_if((F.col("relation") == "imports") & ~F.col("confidence").eqNullSafe(F.lit("EXTRACTED"))).alias("unresolved"))


def legacy(folders: DataFrame, files: DataFrame, edges: DataFrame, heads: DataFrame, entropy: DataFrame | None = None, limits: Mapping[str, Any] = LEGACY) -> DataFrame:
    """The older engine's findings: as above in other words, with one running number over all and unresolved imports.

    Its order: cycles, hot spots, hubs, unresolved imports, then folder by folder depth, weight and flatness, then entropy.
    """
    c, own, name = {**LEGACY, **limits}, F.array("id"), _text("Folder '", F.col("label"), "'")
    make = lambda *a: _finding(a[0], OLD_RULES, *a[1:-1], "legacy", a[-1])
    hot, hub = files.where(F.col("impact_ratio") > c["impact_hotspot"]), files.where(F.col("inbound") > c["god_file_impact"])
    lost = unresolved(edges).where(F.col("unresolved") > c["unresolved_import_warn"])
    deep, heavy = folders.where(F.col("depth") > c["max_depth"]), folders.where(F.col("weight_score") > c["folder_weight_god"])
    flat = folders.where((F.col("subfolder_count") == 0) & (F.col("file_count") > c["flat_folder_files"]))
    out = [
        make(_summed(heads, c["cycles_allowed"], 5), "CYCLE", _text("Found ", F.col("n"), " cycle(s) blocking modular isolation."), "circular_dependencies", F.col("n"), c["cycles_allowed"], F.col("e"), 1),
        make(_summed(hot, 0, 10), "HOTSPOT", _text(F.col("n"), f" files affect >{c['impact_hotspot'] * 100:.0f}% of the codebase."), "high_impact_files", F.col("n"), 0, F.col("e"), 2),
        make(_summed(hub, 0, 10), "GODFILE", _text(F.col("n"), f" files are imported by >{c['god_file_impact']} modules."), "god_files", F.col("n"), 0, F.col("e"), 3),
        make(lost, "UNRESOLVED", _text(F.col("unresolved"), " import statements could not be resolved to physical files."), "unresolved_imports", F.col("unresolved"), c["unresolved_import_warn"], F.array(F.lit("edge_trace")), 4),
        make(deep, "DEPTH", _text(name, " depth (", F.col("depth"), f") exceeds limit ({c['max_depth']})."), "folder_depth", F.col("depth"), c["max_depth"], own, 5),
        make(heavy, "GODFOLDER", _text(name, " exceeds structural weight threshold (", _fixed(F.col("weight_score"), 2), ")."), "folder_weight", F.round("weight_score", 3), c["folder_weight_god"], own, 6),
        make(flat, "FLAT", _text(name, " contains ", F.col("file_count"), " files but no subfolders."), "file_count", F.col("file_count"), c["flat_folder_files"], own, 7),
    ]
    if entropy is not None:
        e = F.col("global_entropy")
        out.append(make(entropy.where(e > c["entropy_warn"]), "ENTROPY", _text("Entropy score ", _fixed(e, 2), " indicates irregular/deep nesting distribution."), "nesting_entropy", F.round(e, 3), c["entropy_warn"], F.array(F.lit("root_hierarchy")), 8))
    group = F.when(F.col("rank") < 5, F.col("rank")).when(F.col("rank") < 8, 5).otherwise(8)
    return _running(reduce(DataFrame.union, out), [group, F.when(F.col("rank").between(5, 7), F.col("evidence")[0]), "rank"])


def raw_findings(folders: DataFrame, edges: DataFrame, cycles: DataFrame, entropy: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """What the rules look at before any threshold, by extractor."""
    inbound = edges.where("relation = 'imports'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inbound"))
    return {
        "structure": {"folder_tree_depths": folders.select("id", "depth"), "folder_weights": folders.select("id", "weight_score"), "global_entropy": entropy},
        "dependency": {"circular_deps": cycles},
        "impact": {"inbound_dependency_map": inbound},
    }


def health(insights: DataFrame, total_nodes: int | Column, penalties: Mapping[str, float] = PENALTIES) -> DataFrame:
    """One row: counts by severity, the normalised score (30 to 100), the strict one (0 to 100), exit code and badge."""
    count = lambda s: F.count_if(F.col("severity") == s)
    sums = insights.agg(count("critical").alias("critical"), count("warning").alias("warning"), count("info").alias("info"))
    total = F.lit(total_nodes) if isinstance(total_nodes, int) else total_nodes
    raw = (sum(F.col(s) * F.lit(float(penalties[s])) for s in ("critical", "warning", "info")) / F.greatest(F.lit(1.0), total / 1000.0)) * 10
    modular = F.round(F.greatest(F.lit(30.0), 100 - F.least(F.lit(70.0), raw)), 1)
    strict = 100 - sum(F.col(s) * F.lit(STRICT_PENALTIES[s]) for s in ("critical", "warning", "info"))
    out = sums.withColumn("health_score", modular).withColumn("strict_score", F.round(F.least(F.greatest(strict.cast("double"), F.lit(0.0)), F.lit(100.0)), 1))
    score = F.col("health_score")
    badge = F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")
    return out.withColumn("exit_code", F.when(score >= 80, 0).when(score >= 60, 1).otherwise(2)).withColumn("badge", badge)


def recommendations(insights: DataFrame) -> DataFrame:
    """(priority, category, action, related): one row for each action, of the first finding that advises it, most urgent first."""
    priority = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    first = F.min(F.struct("rank", "insight_id", priority.alias("priority"), "category")).alias("f")
    each = insights.groupBy(F.col("recommendation").alias("action")).agg(first)
    return each.orderBy("f.priority", "f.rank").select(F.col("f.priority").alias("priority"), F.col("f.category").alias("category"), "action", F.col("f.insight_id").alias("related"))


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows; the order ends with the id, so that ties are settled."""
    return df.orderBy(*order).limit(n)
