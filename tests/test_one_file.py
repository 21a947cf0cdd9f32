"""One CSV file a table: bytes, order, quotes, and nothing left by a failed write."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from sylva.plans import api
from sylva.sources.one_file import write_csv_file


def test_one_file_with_mark_and_quotes(spark, tmp_path):
    df = spark.range(0, 1_000, 1, 8).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit('a "b",\n'), F.col("id").cast("string"))).alias("t"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("even"))
    path = tmp_path / "t.csv"
    write_csv_file(df, str(path))
    write_csv_file(df, str(path))  # replaced
    raw = path.read_bytes()
    assert raw.startswith(b'\xef\xbb\xbf"id","t","x","even"\n"0","NULL","0.0","True"\n')
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[1:] == [[str(i), "NULL" if i % 7 == 0 else f'a "b",\n{i}', str(i / 4), str(i % 2 == 0)] for i in range(1_000)]
    assert os.listdir(tmp_path) == ["t.csv"]


def test_failure_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        write_csv_file(df, str(tmp_path / "t.csv"))
    assert os.listdir(tmp_path) == []


def test_export_and_load(spark, tmp_path):
    df = spark.createDataFrame([("f", "n,1", None, "1.0"), ("g", None, 2.5, "1.0")], "a string, b string, c double, schema_version string")
    assert api.tables.export({"t": df}, str(tmp_path / "out"), "csv").stats == {"t": 2}
    assert os.path.isfile(tmp_path / "out" / "t.csv")
    assert api.tables.export({"t": df}, str(tmp_path / "parts"), "csv", parts=True).success and os.path.isdir(tmp_path / "parts" / "t.csv")
    for folder in ("out", "parts"):
        back = api.tables.load(spark, str(tmp_path / folder), "csv").tables["t"]
        assert sorted(map(str, back.collect())) == sorted(map(str, df.withColumn("c", F.col("c").cast("string")).collect()))
