"""URL filter: host and path rules, spread over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read, unused
from .components import components

#: Rules travel inside the plan as literal maps of at most so many.
MAP = 20_000

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of one address share: no scheme, no fragment, host in lower case. Null without a host."""
    tail = F.regexp_extract(url, "(?s)^.*?://[^/?#]*/?([^#]*)", 1)
    return F.concat(F.nullif(host_of(url), F.lit("")), F.lit("/"), tail)


def _maps(rules: Sequence[tuple[str, str]]) -> list[Column]:
    """Rules to verdicts; of a rule that stands twice, an allow counts."""
    known = {rule: verdict for verdict, rule in sorted(rules, reverse=True)}
    pairs = list(known.items())
    return [F.create_map(*[F.lit(x) for kv in pairs[i : i + MAP] for x in kv]) for i in range(0, len(pairs), MAP)]


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (null: none); of two as long, one that allows."""
    if not rules:
        return F.lit(None).cast("string")
    sizes = sorted({len(rule) - len(rule.partition("/")[0]) for _, rule in rules})
    labels = F.split(host, "\\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = F.flatten(F.transform(ends, lambda e: F.array(*[F.concat(e, F.substring(path, 1, n)) for n in sizes])))

    def best(known: Column) -> Column:
        hits = F.filter(tried, lambda r: F.map_contains_key(known, r))
        return F.array_max(F.transform(hits, lambda r: F.struct(F.length(r).alias("n"), (known[r] == "allow").cast("int").alias("allow"), r.alias("rule"))))

    return F.array_max(F.array(*[best(known) for known in _maps(rules)]))["rule"]


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[known[rule] for known in _maps(rules)]) if rules else F.lit(None).cast("string")


def _absolute(link: Column, url: Column) -> Column:
    """A link as seen from url: with a scheme, //host, /path, or relative to url's folder."""
    scheme, host = F.regexp_extract(url, "^([^:/?#]*)://", 1), F.concat(F.regexp_extract(url, "^[^:/?#]*", 0), F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^(.*/)?", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(host, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) addresses: every canonical link and every refresh of each page, as seen from its base address.

    Comments are no part of a page; canonical may be one of several words of rel; the first base with an href counts.
    """
    text = F.regexp_replace(F.col(html), "(?s)<!--.*?(?:-->|\\z)", " ")
    tags = lambda name: F.regexp_extract_all(F.col("html"), F.lit(f"(?is)<{name}\\b[^>]*>"), F.lit(0))
    quoted = lambda t, attr: F.regexp_extract(t, f"(?is)(?<![\\w-]){attr}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", 0)
    bare = lambda c: F.trim(F.regexp_replace(c, "(?is)^[\\w-]+\\s*=\\s*[\"']?|[\"']$", ""))
    words = lambda t: F.split(F.lower(bare(quoted(t, "rel"))), "\\s+")
    canonical = F.transform(F.filter(tags("link"), lambda t: F.array_contains(words(t), "canonical")), lambda t: bare(quoted(t, "href")))
    after = lambda t: F.trim(F.regexp_extract(bare(quoted(t, "content")), "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1))
    refresh = F.transform(F.filter(tags("meta"), lambda t: F.lower(bare(quoted(t, "http-equiv"))) == "refresh"), after)
    base = F.get(F.filter(F.transform(tags("base"), lambda t: bare(quoted(t, "href"))), lambda h: h != ""), F.lit(0))
    found = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("src"), text.alias("html"))
    found = found.select("src", F.coalesce(_absolute(base, F.col("src")), F.col("src")).alias("base"), F.explode(F.concat(canonical, refresh)).alias("link"))
    return found.where("link <> ''").select("src", _absolute(F.col("link"), F.col("base")).alias("dst"))


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    redirects: DataFrame | None = None,
    *,
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """pages' columns with host, path, rule, verdict and component added; one row out for each row in.

    An address that a rule fits gets that rule's verdict, so an explicit allow outweighs any alias. One that no rule
    fits is blocked if an address in its component (of redirects (src, dst), canonical links and refreshes) is blocked
    by a rule, else allowed. Targets that are not pages count as well.

    Null addresses and those without "://" have empty host and path, no component, and are allowed. Repeated rows stay.
    Columns of pages named like an added one are replaced; any other names stay, and very long pages are read whole.
    """
    added = ["host", "path", "rule", "verdict", "component"]
    here, node, bad, least = unused(pages, "url", "node", "bad", "least")
    at = F.col(here)
    own = pages.withColumn(here, F.col(url)).drop(*[c for c in added if c != url])
    links = redirects.select("src", "dst") if redirects is not None else None
    if html is not None:
        found = page_links(pages.select(F.col(url).alias("url"), F.col(html).alias("html")))
        links = found if links is None else links.union(found)
    judged = lambda df, c: df.withColumn("host", host_of(c)).withColumn("path", path_of(c)).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = judged(own, at).withColumn("verdict", verdict_of(F.col("rule"), rules)).withColumn(node, node_of(at))
    edges = cut(links.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a <> b").distinct()) if links is not None else None
    if edges is None or edges.isEmpty():
        out = out.withColumn("component", F.col(node)).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    else:
        found = cut(components(edges))
        ruled = judged(found, F.concat(F.lit("x://"), F.col("node"))).select("node", "root", verdict_of(F.col("rule"), rules).alias("own"))
        groups = ruled.groupBy("root").agg(F.max((F.col("own") == "block").cast("int")).alias(bad), F.min("node").alias(least))
        alias = ruled.select(F.col("node").alias(node), "root").join(groups, "root").drop("root")
        out = out.join(alias, node, "left").withColumn("component", F.coalesce(least, node))
        out = out.withColumn("verdict", F.coalesce("verdict", F.when(F.col(bad) == 1, "block"), F.lit("allow")))
    return out.select(*[c for c in pages.columns if c not in added or c == url], *[c for c in added if c != url])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


#: The tables hold neither canonical links nor refreshes; a component is then one address, and the method allows it.
OP4_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM
  (SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
   FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path)
"""
