"""References from text: per-line extraction by extension, and resolution through a ladder of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import urls as U

# One pattern for each extension; the first group that is not empty is the target.
PATTERNS = {
    ".py": r"(?U)^\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import)",
    ".js": r"""(?U)^\s*(?:import\s+.*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))""",
    ".ts": r"""(?U)^\s*(?:import\s+.*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))""",
    ".java": r"(?U)^\s*import\s+([\w.]+(?:\.\*)?)\s*;()",
    ".go": r"""(?U)^\s*(?:"([^"]+)"|import\s*\([\s\S]*?"([^"]+)"[\s\S]*?\))""",
    ".c": r"""(?U)^\s*#include\s*["<]([^">]+)[">]()""",
    ".cpp": r"""(?U)^\s*#include\s*["<]([^">]+)[">]()""",
    ".rb": r"""(?U)^\s*require\s+['"]([^'"]+)['"]()""",
    ".php": r"""(?U)^\s*(?:require|include)\s*['"]([^'"]+)['"]()""",
}
#: White space as the lines' own ends and Unicode define it, on both sides.
AROUND = r"(?U)^[\s\x1C-\x1F\x85]+|[\s\x1C-\x1F\x85]+$"
LINE_ENDS = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085  ]"


def lines(content: Column) -> Column:
    """Lines without their ends; a last empty line is none."""
    all_lines = F.split(content, LINE_ENDS, -1)
    return F.when(F.element_at(all_lines, -1) == "", F.slice(all_lines, F.lit(1), F.size(all_lines) - 1)).otherwise(all_lines)


def target(line: Column, ext: Column) -> Column:
    found = F.lit(None).cast("string")
    for e, pattern in PATTERNS.items():
        one, two = (F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in (1, 2))
        found = F.when(ext == e, F.coalesce(one, two)).otherwise(found)
    return found


def extract(files: DataFrame) -> DataFrame:
    """(file_id, rel_path, line_number, raw_statement, raw_target) of files (file_id, rel_path, extension, content)."""
    known = files.where(F.col("extension").isin(*PATTERNS) & F.col("content").isNotNull())
    each = known.select("file_id", "rel_path", "extension", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    found = each.withColumn("raw_target", target(F.col("line"), F.col("extension"))).where("raw_target is not null")
    return found.select("file_id", "rel_path", (F.col("at") + 1).cast("int").alias("line_number"), F.regexp_replace("line", AROUND, "").alias("raw_statement"), "raw_target")


def normalised(path: Column) -> Column:
    """Without '.', '..' and empty segments; what climbs above the root stays outside and matches nothing."""
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


#: Languages whose names of modules are dotted.
DOTTED = (".py", ".java")
_STEM = "(?<=[^/])\\.[^./]+$"


def resolve(found: DataFrame, files: DataFrame, modules: bool = False) -> DataFrame:
    """found with resolved_path and is_resolved; the best of a ladder of candidates that is a known file.

    The target itself, then the target with its last suffix replaced by each known extension; from the own folder if it
    starts with a dot, else from the root. Known files are indexed by path and by stem, a row each, so that an import
    stays one row. With modules, what is then left of Python and Java is looked up as a dotted name: see by_module.
    """
    raw, rel = F.col("raw_target"), F.col("rel_path")
    base = normalised(F.when(raw.startswith("."), F.concat(P.parent_of(rel), F.lit("/"), raw)).otherwise(raw))
    tried = found.withColumn("_base", base).withColumn("_stem", F.regexp_replace("_base", _STEM, ""))
    paths = files.select(F.col("rel_path").alias("_base"), F.col("rel_path").alias("_exact")).distinct()
    rung = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(PATTERNS)]), lambda x: F.endswith(F.col("_base"), x["e"]))).alias("r")
    stems = paths.select("_base", rung).select(F.expr("left(_base, length(_base) - length(r.e))").alias("_stem"), F.col("_base").alias("path"), "r.i")
    by_stem = stems.groupBy("_stem").agg(F.min_by("path", "i").alias("_near"))
    out = tried.join(paths, "_base", "left").join(by_stem, "_stem", "left").withColumn("_path", F.coalesce("_exact", "_near"))
    if modules:
        out = by_module(out, files)
    return out.select("file_id", "line_number", "raw_statement", "raw_target", F.col("_path").alias("resolved_path"), F.col("_path").isNotNull().alias("is_resolved"))


def by_module(tried: DataFrame, files: DataFrame) -> DataFrame:
    """tried with _path also where a dotted name means a module of the same language.

    A file is a module by its path without extension, __init__.py by its folder. A name that starts with dots is relative:
    one dot is the own folder, each further one the folder above. Any other fits the modules whose paths end with it; the
    one of fewest folders before it wins, then the smallest path. A name that fits none loses its last part once, which
    may be a member of the module, an inner class or *. Modules are indexed by all ends of their paths, the best of each
    end alone, so names are matched by plain joins.
    """
    ext = F.regexp_extract("rel_path", "(\\.[^./]+)$", 1)
    own = files.select("rel_path", ext.alias("_ext")).where(F.col("_ext").isin(*DOTTED)).distinct()
    path = F.regexp_replace(F.expr("left(rel_path, length(rel_path) - length(_ext))"), "(^|/)__init__$", "")
    parts = own.select("rel_path", "_ext", path.alias("_module"), F.split(path, "/").alias("s"))
    ends = parts.select("_ext", "rel_path", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("i"))
    ends = ends.select("_ext", F.array_join(F.expr("slice(s, i + 1, size(s))"), "/").alias("end"), F.struct("i", "rel_path").alias("at"))
    index = ends.groupBy("_ext", "end").agg(F.min("at")["rel_path"].alias("path"))
    exact = parts.groupBy("_ext", F.col("_module").alias("end")).agg(F.min("rel_path").alias("path"))

    name, dots = F.col("raw_target"), F.length(F.regexp_extract("raw_target", "^(\\.*)", 1))
    climb = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    folder = F.concat_ws("/", P.parent_of(F.col("rel_path")), climb, F.translate(F.regexp_replace(name, "^\\.+", ""), ".", "/"))
    full = F.when(dots > 0, normalised(folder)).otherwise(F.translate(name, ".", "/"))
    asked = tried.withColumn("_own", ext).withColumn("_full", F.when(F.col("_path").isNull() & F.col("_own").isin(*DOTTED), full)).withColumn("_dots", dots)
    asked = asked.withColumn("_less", F.when(F.col("_full").contains("/"), F.regexp_replace("_full", "/[^/]*$", "")))
    for key in ("_full", "_less"):
        for table, relative in ((exact, True), (index, False)):
            side = table.select(F.col("_ext"), F.col("end").alias("_end"), F.col("path").alias("_hit"))
            fits = (F.col(key) == F.col("_end")) & (F.col("_own") == F.col("_ext")) & ((F.col("_dots") > 0) == relative) & F.col("_path").isNull()
            asked = asked.join(side, fits, "left").withColumn("_path", F.coalesce("_path", "_hit")).drop("_ext", "_end", "_hit")
    return asked


def totals(found: DataFrame) -> DataFrame:
    """One row (total_imports, resolved_imports) of resolved references."""
    return found.agg(F.count("*").alias("total_imports"), F.count_if("is_resolved").alias("resolved_imports"))


#: What a page refers to: the quoted value of an href.
HREF = r"""(?i)\bhref\s*=\s*["']([^"'<>]*)["']"""


def page_links(pages: DataFrame, *, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(key, line_number: the link's place in its page from 1, raw_target, resolved_path, is_resolved) of pages.

    References are resolved against their page's address, and are known if they are the address of a page, fragments
    apart. Pages without an address or text have no links; pages that share an address make it known once.
    """
    found = pages.select(F.col(key), F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(HREF), F.lit(1))).alias("_at", "raw_target"))
    made = found.withColumn("resolved_path", U.resolved(F.col("_base"), F.col("raw_target")))
    known = pages.select(U.resolved(F.col(url), F.lit("")).alias("resolved_path"), F.lit(True).alias("_known")).dropna().distinct()
    out = made.where("resolved_path is not null").join(known, "resolved_path", "left")
    return out.select(key, (F.col("_at") + 1).alias("line_number"), "raw_target", "resolved_path", F.col("_known").isNotNull().alias("is_resolved"))
