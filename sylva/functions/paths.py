"""Column expressions over relative POSIX paths ('.' is the root), globs and identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_value

#: Rules beyond this many are matched by one automaton instead of an expression each, with the same result.
MANY_RULES = 100
LAYERS = ("core", "module", "nested", "test", "external", "utility")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell glob; * crosses /, [!x] negates, an open [ is literal."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body, i = pattern[i:end], end + 1
            negated = body.startswith("!")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out += f"[{'^' if negated else ''}{inner}]"
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})$"


def matches_any(name: Column, patterns: Iterable[str], strip_slash: bool = False) -> Column:
    """Whether a name fits one of the globs; strip_slash also lets 'dir/' mean 'dir'."""
    globs = [glob_regex(p.rstrip("/") if strip_slash else p) for p in patterns]
    return name.rlike("|".join(f"(?:{g})" for g in globs)) if globs else F.lit(False)


def ignored_path(rel: Column, patterns: Iterable[str], strip_slash: bool = False) -> Column:
    """Whether any segment is ignored, so that what lies below an ignored folder goes with it."""
    patterns = list(patterns)
    return F.exists(F.split(rel, "/"), lambda s: matches_any(s, patterns, strip_slash))


def depth(rel: Column) -> Column:
    return F.when(rel == ".", 0).otherwise(F.size(F.split(rel, "/"))).cast("int")


def name_of(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def parent_of(rel: Column) -> Column:
    """Null for the root, '.' for what lies in it."""
    return F.when(rel == ".", None).when(rel.contains("/"), F.regexp_replace(rel, "/[^/]*$", "")).otherwise(".")


def node_id(kind: str, rel: Column) -> Column:
    return F.concat(F.lit(f"fs:{kind}:"), F.translate(rel, "/\\", "::"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "(?s)^.+(\\.[^.]+)$", 1))


def nesting_chain(rel: Column, root: str) -> Column:
    return F.when(rel == ".", F.array(F.lit(root))).otherwise(F.concat(F.array(F.lit(root)), F.split(rel, "/")))


def layer(rel: Column, rules: Mapping[str, str]) -> Column:
    """The first rule that fits; a rule's unknown layer is module. Else test by its name. No rules: always module."""
    if not rules:
        return F.lit("module")
    known = {g: x if x in LAYERS else "module" for g, x in rules.items()}
    fits = [first_value(rel, known, glob_regex)] if len(known) > MANY_RULES else [F.when(rel.rlike(glob_regex(g)), F.lit(x)) for g, x in known.items()]
    low = F.lower(rel)
    return F.coalesce(*fits, F.when(low.contains("test") | low.contains("spec"), "test"), F.lit("module"))


def inferred_parent(file_id: Column) -> Column:
    """The parent folder's id as a file's id tells it; null for files of the root."""
    p = F.split(file_id, ":")
    return F.when(F.size(p) > 3, F.concat(F.lit("fs:folder:"), F.array_join(F.slice(p, 3, F.size(p) - 3), ":")))


def list_text(c: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
