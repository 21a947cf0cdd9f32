"""Reports as JSON, Markdown and HTML text, on the driver: findings are few."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping
from typing import Any

BADGES = ((90, "excellent"), (70, "good"), (50, "fair"))


def badge(score: float) -> str:
    return next((name for least, name in BADGES if score >= least), "poor")


def to_json(report: Mapping[str, Any]) -> str:
    return json.dumps(report, indent=2, default=str, ensure_ascii=False)


def _by_severity(report: Mapping[str, Any], severity: str) -> list[dict[str, Any]]:
    return [i for i in report["insights"] if i["severity"] == severity]


def _summary(report: Mapping[str, Any]) -> list[tuple[str, Any, str]]:
    critical, warning = len(_by_severity(report, "critical")), len(_by_severity(report, "warning"))
    return [("Health Score", report["health_score"], "INFO"), ("Critical Issues", critical, "FAIL" if critical else "PASS"), ("Warnings", warning, "WARN" if warning else "PASS")]


def _trace(report: Mapping[str, Any]) -> list[tuple[Any, ...]]:
    return [(i["insight_id"], i["category"], t["metric_name"], t["actual_value"], t["threshold"], t["status"], t["evidence_path"]) for i in report["insights"] for t in i["traceability_matrix"]]


TRACE = ("ID", "Category", "Metric", "Actual", "Threshold", "Status", "Path")


def to_markdown(report: Mapping[str, Any]) -> str:
    row = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    out = ["# Structure report", "", f"Health: **{report['health_score']}** ({badge(report['health_score'])}), exit code {report['exit_code']}", ""]
    out += [f"Nodes: {report['total_nodes']}, edges: {report['total_edges']}", "", row(("Metric", "Value", "Status")), row(["---"] * 3), *map(row, _summary(report)), ""]
    for severity in ("critical", "warning", "info"):
        found = _by_severity(report, severity)
        out += [f"## {severity.capitalize()} ({len(found)})", ""]
        out += [f"- **{i['insight_id']}** {i['title']}: {i['description']} Evidence: {', '.join(i['evidence']) or 'none'}. {i['recommendation']}" for i in found] + [""]
    out += ["## Traceability", "", row(TRACE), row(["---"] * len(TRACE)), *map(row, _trace(report))]
    out += ["", "## Actions", ""] + [f"{r['priority']}. {r['action']}" for r in report["recommendations"]]
    return "\n".join(out) + "\n"


def to_legacy_markdown(report: Mapping[str, Any]) -> str:
    about, ranked = report["metadata"], report["ranked_lists"]
    out = ["# Architectural insights", "", f"Health: **{about['health_score']}/100**, generated {about['generated_at']}", ""]
    out += [f"- Nodes: {about['total_nodes']}", f"- Edges: {about['total_edges']}"]
    out += [f"- {name}: {len(_by_severity(report, s))}" for name, s in (("Critical issues", "critical"), ("Warnings", "warning"))]
    out += ["", "## Top insights", ""] + [f"- **{i['title']}** ({i['severity'].upper()}): {i['description']}" for i in report["insights"][:5]]
    out += ["", "## Ranked views", "", f"- Heaviest folders: {', '.join(f['label'] for f in ranked['top_heaviest_folders'][:3])}"]
    out += [f"- Most imported files: {', '.join(f['name'] for f in ranked['most_depended_files'][:3])}"]
    return "\n".join(out) + "\n"


STYLE = "body{font-family:sans-serif;max-width:75rem;margin:auto;padding:2rem}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.5rem;text-align:left}.FAIL,.poor{color:#b00}.WARN,.fair{color:#b60}.PASS,.good,.excellent{color:#070}"


def to_html(report: Mapping[str, Any]) -> str:
    safe = lambda x: html.escape(str(x))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{safe(c)}</{tag}>" for c in cells) + "</tr>"
    table = lambda head, rows: "<table>" + row(head, "th") + "".join(map(row, rows)) + "</table>"
    score = badge(report["health_score"])
    out = [f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Structure report</title><style>{STYLE}</style></head><body>"]
    out += [f"<h1>Structure report</h1><p class='{score}'>Health {safe(report['health_score'])} ({score}), exit code {safe(report['exit_code'])}</p>"]
    out += ["<h2>Summary</h2>", table(("Metric", "Value", "Status"), _summary(report))]
    for severity, name in (("critical", "Critical findings"), ("warning", "Warnings"), ("info", "Notes")):
        if found := _by_severity(report, severity):
            out.append(f"<h2>{name} ({len(found)})</h2>")
        for i in found:
            path = i["traceability_matrix"][0]["evidence_path"] if i["traceability_matrix"] else "N/A"
            out.append(f"<h3>{safe(i['insight_id'])}: {safe(i['title'])}</h3><p>{safe(i['description'])} {safe(i['recommendation'])}</p><small>Evidence: {safe(', '.join(i['evidence']) or 'none')}; path: <code>{safe(path)}</code></small>")
    out += ["<h2>Traceability</h2>", table(TRACE, _trace(report))]
    out += ["<h2>Actions</h2><ol>", *(f"<li>[P{safe(a['priority'])}] {safe(a['action'])}</li>" for a in report["recommendations"]), "</ol></body></html>\n"]
    return "".join(out)


RENDERERS = {"json": ("json", to_json), "markdown": ("md", to_markdown), "html": ("html", to_html)}
