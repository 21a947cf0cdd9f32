"""A graph kept as tables in buckets, into which graphs are merged by rewriting only the buckets that they touch.

Nodes lie in buckets by id, edges by their whole key, so that a node of many edges is no bucket of its own. A merge reads
and replaces the buckets of what comes in, and looks the ends of edges up in the buckets of those ends alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import merge_edges, merge_nodes
from .lineage import cut, discard

KEY = ("source", "target", "relation")
COUNTS = ("new_nodes", "updated_nodes", "added_edges", "skipped_edges")


class StoredGraph:
    """Tables nodes, edges and metadata below path, a folder that driver and executors share; one writer at a time.

    The number of buckets is fixed by the first merge. A merge that is cut off half-way is repeated as a whole: what it had
    stored already is found there and changes nothing, except that the counters of the second run are lower.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        if (meta := self._document()) is not None:
            self.buckets = meta["buckets"]

    def _where(self, name: str) -> str:
        return os.path.join(self.path, name)

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._where(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _document(self) -> dict[str, Any] | None:
        return json.loads(self.spark.read.text(self._where("metadata")).first()[0]) if self._exists("metadata/_SUCCESS") else None

    def _put(self, name: str, df: DataFrame) -> None:
        by_bucket = df.repartition(self.buckets, "bucket")
        by_bucket.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._where(name))

    def _bucket(self, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _touched(self, df: DataFrame, *columns: str) -> list[int]:
        return [r[0] for r in df.select(self._bucket(*columns).alias("b")).distinct().collect()]  # at most one row a bucket

    def _held(self, name: str, like: DataFrame, touched: list[int] | None = None) -> DataFrame:
        """What is stored, of the touched buckets or all; like gives the columns while there is nothing."""
        if not self._exists(name):
            return like.limit(0)
        held = self.spark.read.parquet(self._where(name))
        return (held if touched is None else held.where(F.col("bucket").isin(touched))).drop("bucket")

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(self._where("nodes")).drop("bucket")

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.parquet(self._where("edges")).drop("bucket")

    @property
    def metadata(self) -> dict[str, Any]:
        return (self._document() or {}).get("metadata", {})

    def merge(self, nodes: DataFrame, edges: DataFrame, metadata: Mapping[str, Any] | None = None, order: str | None = None) -> dict[str, int]:
        """Merges a graph as safe_merge does, and returns its counters.

        Nodes come as (id, other columns, physical_meta: map); those without an id and edges without a key are left out.
        Of the very first merge, nothing stored, repeated nodes of one id are merged in the given order. Columns beyond
        those of what is stored are dropped.
        """
        at = [order] if order else []
        self._document() or self._store_metadata({})
        came = nodes.where("id is not null and id <> ''")
        touched = self._touched(came, "id")
        plain = came.drop(*at)
        merged = cut(merge_nodes(self._held("nodes", plain, touched), came, order))
        row = merged.agg(F.count_if(F.col("merge_state") == "new"), F.sum("repeats")).first()
        if touched:
            self._put("nodes", merged.drop("merge_state", "repeats").withColumn("bucket", self._bucket("id")))
        keyed = edges.where(" and ".join(f"{c} is not null" for c in KEY))
        ends = self._touched(keyed.select(F.explode(F.array("source", "target")).alias("id")), "id")
        ids = self._held("nodes", plain, ends).select("id")
        places = self._touched(keyed, *KEY)
        before = self._held("edges", edges.drop(*at), places)
        after = cut(merge_edges(before, keyed, ids, order))
        added = after.count() - before.count()
        if added:
            fresh = self._touched(after.join(before.select(*KEY), list(KEY), "left_anti"), *KEY)
            self._put("edges", after.withColumn("bucket", self._bucket(*KEY)).where(F.col("bucket").isin(fresh)))
        stats = dict(zip(COUNTS, (row[0], row[1] or 0, added, edges.count() - added)))
        self._store_metadata({**self.metadata, **(metadata or {}), "merge_report": stats})
        discard(merged, after)
        return stats

    def _store_metadata(self, metadata: Mapping[str, Any]) -> None:
        text = json.dumps({"buckets": self.buckets, "metadata": dict(metadata)})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self._where("metadata"))
