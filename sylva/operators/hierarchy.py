"""Folder metrics: depth, counts, structural weight, and the entropy of files over depths.

fs_files (rel_path, parent_path, name, size_bytes) and fs_folders (rel_path) describe a tree; the root is '.'.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.config import LAYER_RULES, WEIGHTS
from ..plans.lineage import cut


def folders_of(fs_files: DataFrame) -> DataFrame:
    """Every ancestor of every file, and the root."""
    parents = fs_files.select("parent_path").distinct().where("parent_path <> '.'").select(F.split("parent_path", "/").alias("s"))
    above = parents.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array_join(F.slice("s", F.lit(1), i), "/"))).alias("rel_path"))
    return above.distinct().union(fs_files.sparkSession.range(1).select(F.lit(".").alias("rel_path")))


def counted(fs_folders: DataFrame, fs_files: DataFrame) -> DataFrame:
    """(rel_path, parent_path, depth, file_count, subfolder_count); both counts are partial sums before one shuffle."""
    own = fs_folders.select("rel_path", F.lit(1).alias("own"), F.lit(0).alias("f"), F.lit(0).alias("c"))
    files = fs_files.select(F.col("parent_path").alias("rel_path"), F.lit(0), F.lit(1), F.lit(0))
    children = fs_folders.where("rel_path <> '.'").select(P.parent_of(F.col("rel_path")), F.lit(0), F.lit(0), F.lit(1))
    sums = own.union(files).union(children).groupBy("rel_path").agg(F.sum("own").alias("own"), F.sum("f").alias("file_count"), F.sum("c").alias("subfolder_count"))
    rel = F.col("rel_path")
    return sums.where("own > 0").select("rel_path", P.parent_of(rel).alias("parent_path"), P.depth(rel).alias("depth"), "file_count", "subfolder_count")


def maxima(counts: DataFrame) -> DataFrame:
    one = F.lit(1)
    return counts.agg(F.coalesce(F.max("depth"), one).cast("long").alias("max_depth"), F.coalesce(F.max("file_count"), one).alias("max_files"), F.coalesce(F.max("subfolder_count"), one).alias("max_subfolders"))


def weight(coeffs: Mapping[str, float]) -> Column:
    c = {**WEIGHTS, **coeffs}
    part = lambda x, most, none: F.when(F.col(most) > 0, F.col(x) / F.col(most)).otherwise(none)
    density, centrality = part("file_count", "max_files", 0.0), part("subfolder_count", "max_subfolders", 0.0)
    shallow = F.when(F.col("max_depth") > 0, 1 - F.col("depth") / F.col("max_depth")).otherwise(1.0)
    raw = c["density"] * density + c["depth_penalty"] * shallow + c["centrality"] * centrality
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4)


def folder_metrics(fs_folders: DataFrame, fs_files: DataFrame, *, root: str = "root", rules: Mapping[str, str] = LAYER_RULES, coeffs: Mapping[str, float] = WEIGHTS) -> DataFrame:
    counts = cut(counted(fs_folders, fs_files))  # read twice, for itself and for its maxima
    rel = F.col("rel_path")
    chain = P.nesting_chain(rel, root)
    return counts.crossJoin(F.broadcast(maxima(counts))).select(  # one row of maxima
        P.node_id("folder", rel).alias("folder_id"),
        F.when(rel == ".", root).otherwise(P.name_of(rel)).alias("label"),
        "rel_path",
        "parent_path",
        "depth",
        P.layer(rel, rules).alias("layer"),
        "file_count",
        "subfolder_count",
        weight(coeffs).alias("weight_score"),
        F.lit(0.0).alias("entropy_contribution"),
        chain.alias("nesting_chain"),
        (F.col("depth") + 1).alias("path_length"),
    )


def depth_histogram(fs_files: DataFrame) -> DataFrame:
    return fs_files.groupBy(P.depth(F.col("parent_path")).alias("depth")).agg(F.count("*").alias("file_count"))


def entropy(histogram: DataFrame) -> DataFrame:
    """One row: Shannon entropy of file_count over the rows, divided by its largest value; 0 for fewer than two rows."""
    total = histogram.agg(F.sum("file_count").alias("total"), F.count("*").alias("k"))
    p = F.col("file_count") / F.col("total")
    summed = histogram.crossJoin(F.broadcast(total)).agg(F.sum(F.when(F.col("file_count") > 0, -p * F.log2(p))).alias("h"), F.max("k").alias("k"))
    return summed.select(F.when(F.col("k") >= 2, F.round(F.coalesce("h", F.lit(0.0)) / F.log2("k"), 4)).otherwise(0.0).alias("global_entropy"))


def file_identity(fs_files: DataFrame, *, rules: Mapping[str, str] = LAYER_RULES, max_file_mb: float = 5.0) -> DataFrame:
    """Files up to the size limit with id, extension, layer and depth."""
    rel = F.col("rel_path")
    return fs_files.where(F.col("size_bytes") / 1048576.0 <= max_file_mb).select(
        P.node_id("file", rel).alias("file_id"), "name", "rel_path", "parent_path", P.extension(F.col("name")).alias("extension"),
        P.layer(rel, rules).alias("layer"), P.depth(rel).alias("depth"), F.col("size_bytes").cast("long").alias("size_bytes"),
    )


def oversized(fs_files: DataFrame, max_file_mb: float = 5.0) -> DataFrame:
    return fs_files.where(F.col("size_bytes") / 1048576.0 > max_file_mb).select("rel_path", F.lit("SizeLimit").alias("error"), F.lit("classify").alias("stage"))
