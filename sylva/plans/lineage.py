"""Cutting lineage by tables in the shared checkpoint folder of the session, and running numbers without one big window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written in the session's spark.checkpoint.dir, which survives lost executors.

    Unlike checkpoint(), whose plan keeps the size estimated for df, it has its real size: in loops of joins estimates
    multiply until the optimizer does nothing but count. Where no folder is set, one machine (a local master, as in tests)
    gets a temporary one and a cluster an error: each executor would write to a disk of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sylva-checkpoint-"))
        folder = context.getCheckpointDir()
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def measured(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut(df), and aggregates over its rows that are taken while they are written; 0 for none."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(name) for name, c in counts.items()]))
    return out, {name: int(seen.get.get(name) or 0) for name in counts}


def discard(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these; nothing that is still to be computed may read them."""
    for df in tables:
        if path := df.__dict__.get("_written"):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the running number of each row, from 1, in the given order, which has to tell all rows apart.

    Ranges are counted side by side and only the sums of ranges are added up in one place.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_start", "_own")
