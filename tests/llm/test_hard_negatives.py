"""Hard negatives against SQL and plain loops."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import sylva.llm.hard_negatives as hn
from sylva.llm.hard_negatives import OP12_SQL, hard_negatives, op12_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_equals_sql(spark, data):
    db = duckdb.connect()
    for t in os.listdir(data):
        db.execute(f"create view {t[:-8]} as select * from '{data}/{t}'")
    want = sorted(db.execute(f"select {', '.join(COLUMNS)} from ({OP12_SQL})").fetchall())
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, data).select(*COLUMNS).collect())
    assert got == want and len(got) > 50


def plain(rows, asks, low=80, high=100):
    good = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            good[(i, label, tuple(x))] = [math.floor(256 * v) for v in x]
    out = []
    for (i, label, x), v in good.items():
        if not asks(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, y, m) for (j, m, y), w in good.items() if j != i and len(y) == len(x)]
        same = sorted((s, j) for s, j, _, m in scored if m == label)[:5]
        for ps, p in same:
            window = sorted((s, j) for s, j, _, m in scored if m != label and low * -ps <= 100 * -s <= high * -ps)[:5]
            out += [(i, p, k, j, -ps, -s) for k, (s, j) in enumerate(window, 1)]
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_nulls_ties_repeats_lengths(spark):
    rng = random.Random(4)
    vec = lambda d: [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(d)]
    rows = [(i, vec(4), rng.randrange(3)) for i in range(120)]
    rows += [(i, vec(3), rng.randrange(2)) for i in range(200, 230)] + [(i, [], i % 2) for i in range(300, 312)]
    rows += [(400, None, 1), (401, [None, 1.0, 1.0, 1.0], 1), (402, [float("nan"), 1.0, 1.0, 1.0], 1), (403, [float("inf"), 0.0, 0.0, 0.0], 0), (404, vec(4), None), (None, vec(4), 1)]
    rows += rows[:40] * 2
    got = sorted(tuple(r) for r in hard_negatives(make(spark, rows).withColumn("row", F.lit(1)).withColumn("wins", F.lit("x")), F.col("vec_id") % 10 == 0).collect())
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 100
    assert {r[0] for r in got} >= {200, 300} and not {r[0] for r in got} & {400, 401, 402, 403, 404}


def test_small_blocks_and_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) + (0.7 if d == label else 0) for d in range(10)], label) for i in range(300) for label in [0 if i % 3 else rng.randrange(5)]]
    want = plain(rows, lambda i: i % 7 == 0)
    for name, value in (("CHUNK", 3), ("ANCHORS", 5), ("ROWS", 16), ("SLAB", 2)):
        monkeypatch.setattr(hn, name, value)
    got = sorted(tuple(r) for r in hard_negatives(make(spark, rows), F.col("vec_id") % 7 == 0).collect())
    assert got == want and len(got) > 100


def test_shared_ids_large_values_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [0.9, 0.9], 1), (4, [2.0**21, 1.0], 0), (5, [2.0**21, 0.0], 1), (6, [2.0**21, 7.0], 0)]
    got = sorted(tuple(r) for r in hard_negatives(make(spark, rows), F.col("vec_id").isin(1, 4)).collect())
    assert got == plain(rows, lambda i: i in (1, 4)) and any(r[0] == 4 and r[4] > 2**53 for r in got)
    assert hard_negatives(make(spark, []), F.lit(True)).count() == 0
    assert hard_negatives(make(spark, rows), F.lit(False)).count() == 0
    assert hard_negatives(make(spark, rows[:1]), F.lit(True)).count() == 0
    named = spark.createDataFrame([(i, v, "ab"[c]) for i, v, c in rows], "vec_id int, embedding array<float>, label string")
    assert sorted(tuple(r) for r in hard_negatives(named, F.col("vec_id").isin(1, 4)).collect()) == got


def test_product_is_exact():
    rng = np.random.default_rng(0)
    for most in (5, 300, 1 << 20, 1 << 28):
        x, y = rng.integers(-most, most, (7, 33)), rng.integers(-most, most, (9, 33))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x]
        assert hn.product(hn.narrow(x), hn.narrow(y)).tolist() == want
