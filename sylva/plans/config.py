"""Configuration of an analysis: fixed defaults, an ignore file, and a JSON overlay."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

# The defaults.
IGNORE = (".git", "__pycache__", "node_modules", ".venv", "dist", "build")
LAYER_RULES = {"**/test*": "test", "**/src/**": "core", "**/utils/**": "utility"}
WEIGHTS = {"density": 0.5, "depth_penalty": 0.3, "centrality": 0.2}
MAX_FILE_MB = 5.0
STRUCTURE = {"max_depth": 5, "folder_weight_god": 0.85, "entropy_warn": 0.6, "flat_folder_files": 10}
DEPENDENCY = {"cycles_allowed": 0, "unresolved_warn": 5}
IMPACT = {"impact_hotspot": 0.15, "god_file_impact": 20, "orphan_files_allowed": 5}
LEGACY = {**STRUCTURE, **IMPACT, "cycles_allowed": 0, "unresolved_import_warn": 5}
PENALTIES = {"critical": 3.0, "warning": 1.0, "info": 0.1}
STRICT_PENALTIES = {"critical": 20, "warning": 10, "info": 2}


@dataclass(frozen=True)
class Config:
    ignore: tuple[str, ...] = IGNORE
    layer_rules: Mapping[str, str] = field(default_factory=lambda: dict(LAYER_RULES))
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    max_file_mb: float = MAX_FILE_MB
    thresholds: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    def overlay(self, values: Mapping[str, Any]) -> Config:
        """Later values win key by key."""
        known = {"layer_rules": "layer_rules", "weight_coeffs": "weights"}
        out = self
        for key, name in known.items():
            if isinstance(values.get(key), Mapping):
                out = replace(out, **{name: {**getattr(out, name), **values[key]}})
        if "max_file_size_mb" in values:
            out = replace(out, max_file_mb=float(values["max_file_size_mb"]))
        if "ignore_patterns" in values:
            out = replace(out, ignore=tuple(values["ignore_patterns"]))
        if isinstance(values.get("thresholds"), Mapping):
            out = replace(out, thresholds={**out.thresholds, **values["thresholds"]})
        return out

    def limit(self, group: str, defaults: Mapping[str, Any]) -> dict[str, Any]:
        return {**defaults, **self.thresholds.get(group, {})}


def ignore_patterns(path: str | Path) -> tuple[str, ...]:
    """One glob a line. Blank lines and lines that begin with # go; a missing, broken or empty file gives the defaults."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except (OSError, UnicodeDecodeError):
        return IGNORE
    return tuple(x.strip() for x in lines if x.strip() and not x.startswith("#")) or IGNORE


def load(root: str | Path, ignore_file: str = ".treeignore", config_file: str = "tree-config.json") -> Config:
    config = Config(ignore=ignore_patterns(Path(root) / ignore_file))
    try:
        values = json.loads((Path(root) / config_file).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return config
    return config.overlay({k: v for k, v in values.items() if k != "ignore_patterns"}) if isinstance(values, dict) else config
