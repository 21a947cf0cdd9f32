"""The driver's tables seen as trees, graphs and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_file(prefix: str, *keys: str | Column) -> Column:
    """node_id of a file whose name is made of numbers, which hold nothing to translate."""
    return F.concat(F.lit(f"fs:file:{prefix}"), *[k if isinstance(k, Column) else F.col(k).cast("string") for k in keys], F.lit(".py"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the host's labels in reverse and the path's segments are folders."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", ""), "/+$", ""), "\\.html$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size_bytes"), F.split(bare, "/").alias("s"))
    folder = F.array_join(F.concat(F.reverse(F.split(F.get("s", F.lit(0)), "\\.")), F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0)))), "/")
    name = F.concat(F.element_at("s", -1), F.lit("_"), F.col("page_id").cast("string"), F.lit(".html"))
    files = pages.select(folder.alias("parent_path"), name.alias("name"), "size_bytes")
    return files.select(F.concat("parent_path", F.lit("/"), "name").alias("rel_path"), "parent_path", "name", "size_bytes")


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/nation/segment/customer, customers as files; their size is the whole of their orders."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").cast("long").alias("size_bytes"))
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    joined = joined.join(spent, joined["c_custkey"] == spent["o_custkey"], "left")
    parent = F.concat_ws("/", F.translate("r_name", " ", "_"), F.translate("n_name", " ", "_"), F.translate("c_mktsegment", " ", "_"))
    return joined.select(F.concat(parent, F.lit("/"), "c_name").alias("rel_path"), parent.alias("parent_path"), F.col("c_name").alias("name"), F.coalesce("size_bytes", F.lit(0).cast("long")).alias("size_bytes"))


def part_edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Parts that follow each other in an order, as imports (source, target) between file ids; repeats: a row each time."""
    items = table(spark, sf_dir, "lineitem")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = items.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(by).alias("b")).where("b is not null")
    pairs = pairs if repeats else pairs.distinct()
    return pairs.select(_numbered_file("p", "a").alias("source"), _numbered_file("p", "b").alias("target"))


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparser graph of the same orders: each part with its cheapest and its dearest follower in any of them."""
    items = table(spark, sf_dir, "lineitem")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    follower = F.struct(F.lead("l_extendedprice").over(by).alias("price"), F.lead("l_partkey").over(by).alias("b"))
    pairs = items.select(F.col("l_partkey").alias("a"), follower.alias("f")).where("f.b is not null")
    ends = pairs.groupBy("a").agg(F.min("f").alias("least"), F.max("f").alias("most"))
    each = ends.select("a", F.explode(F.array_distinct(F.array("least.b", "most.b"))).alias("b"))
    return each.select(_numbered_file("p", "a").alias("source"), _numbered_file("p", "b").alias("target"))


def order_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring for each order: each of its lines, by number, imports the next one, and the last the first."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("l_orderkey is not null")
    ends = lines.select("l_orderkey", "n", F.explode(F.sequence(F.lit(1), "n")).alias("a")).withColumn("b", F.col("a") % F.col("n") + 1)
    name = lambda c: _numbered_file("o", "l_orderkey", F.lit(":l"), c)
    return ends.select(name("a").alias("source"), name("b").alias("target"))


def module_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as modules src/lang/source/d<id>, every fifth in Java, the others in Python; each names the one after it.

    By its package, by its package and a member, and in Python from the own folder and from the folder above.
    """
    word = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("none")), "[^A-Za-z0-9_]", "_")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    own = docs.select("doc_id", word("lang").alias("lang"), word("source").alias("source"), F.when(F.col("doc_id") % 5 == 4, ".java").otherwise(".py").alias("extension"))
    later = own.select((F.col("doc_id") - 1).alias("doc_id"), F.concat_ws(".", "lang", "source", F.concat(F.lit("d"), "doc_id")).alias("next"), F.concat_ws(".", "source", F.concat(F.lit("d"), "doc_id")).alias("beside"))
    python = F.concat(F.lit("import "), "next", F.lit("\nfrom "), "next", F.lit(".Part import x\nfrom .d"), (F.col("doc_id") + 1).cast("string"), F.lit(" import y\nfrom .."), "beside", F.lit(" import z\n"))
    java = F.concat(F.lit("import "), "next", F.lit(";\nimport "), "next", F.lit(".Part;\nimport "), "next", F.lit(".*;\n"))
    text = F.coalesce(F.when(F.col("extension") == ".py", python).otherwise(java), F.lit(""))
    rel = F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), "extension")
    return own.join(later, "doc_id", "left").select(P.node_id("file", rel).alias("file_id"), rel.alias("rel_path"), "extension", text.alias("content"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select(P.node_id("file", rel).alias("id"), rel.alias("rel_path"), F.when(F.col("p_size") % 7 == 0, "test").otherwise("module").alias("layer"))


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files whose text imports the parts that follow them, a line each, in order."""
    edges = part_edges(spark, sf_dir)
    line = F.concat(F.lit("import "), F.regexp_replace(F.regexp_replace("target", "^fs:file:", ""), "\\.py$", ""))
    texts = edges.groupBy(F.col("source").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("content"))
    files = part_files(spark, sf_dir)
    return files.join(texts, "id", "left").select(F.col("id").alias("file_id"), "rel_path", F.lit(".py").alias("extension"), F.coalesce("content", F.lit("")).alias("content"))


#: Extensions that documents get in turn, and how a line of each names another file.
LANGUAGES = {
    ".py": "import {}", ".js": "  import x from '{}'", ".ts": "import {{ y }} from \"{}\"", ".java": "import {};", ".go": '\t"{}"',
    ".c": '#include "{}"', ".cpp": "#include <{}>", ".rb": "require '{}'", ".php": "include '{}'",
}


def polyglot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files lang/source/d<id><extension> in nine languages; each names the one after it.

    Python and Java name it as a module, the others by ./ in the same folder and by ../ beyond it, without an extension.
    The lines around hold no reference.
    """
    kinds = list(LANGUAGES)
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    folder = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.regexp_replace(F.coalesce("source", F.lit("none")), "[^A-Za-z0-9_-]", "_"))
    ext = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % len(kinds)).cast("int"))
    own = docs.select("doc_id", folder.alias("folder"), ext.alias("extension"))
    # The successor by a join, since ids run from 0 without gaps; a missing one is simply not named.
    later = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("folder").alias("next"))
    stem = F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"))
    near = F.when(F.col("folder") == F.col("next"), F.concat(F.lit("./"), stem)).otherwise(F.concat(F.lit("../../"), "next", F.lit("/"), stem))
    named = F.when(F.col("extension").isin(".py", ".java"), F.concat(F.lit("pkg."), stem)).otherwise(near)
    named = F.when(F.col("next").isNotNull(), named)
    line = F.lit(None).cast("string")
    for k, form in LANGUAGES.items():
        before, after = form.replace("{{", "{").replace("}}", "}").split("{}")
        line = F.when(F.col("extension") == k, F.concat(F.lit(before), named, F.lit(after))).otherwise(line)
    content = F.concat(F.lit("first line\r\n"), F.coalesce(F.concat(line, F.lit(" \t")), F.lit("")), F.lit("\nlast line\n"))
    rel = F.concat("folder", F.lit("/d"), F.col("doc_id").cast("string"), "extension")
    return own.join(later, "doc_id", "left").select(P.node_id("file", rel).alias("file_id"), rel.alias("rel_path"), "extension", content.alias("content"))
