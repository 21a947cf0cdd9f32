"""Cycles of small pieces are found by the tasks that read them, those of torn or large ones by rounds."""

import random

import pyarrow as pa
import pytest

from sylva.operators import graph as G
from sylva.operators import pieces as P

from .test_whole_graph import tree_cycles


def rings(n, size):
    return [(f"r{k:03}n{i}", f"r{k:03}n{(i + 1) % (k % size + 1)}") for k in range(n) for i in range(k % size + 1)]


def test_small_rings_take_no_rounds(spark, monkeypatch):
    def rounds(_):
        raise AssertionError("rounds over small pieces")

    monkeypatch.setattr(G, "_tree_cycles", rounds)
    edges = rings(300, 9)
    got = [tuple(r["cycle"]) for r in G.cycles(spark.createDataFrame(edges + edges[:5] + [(None, "x"), ("x", None)], "source string, target string").coalesce(1)).collect()]
    assert len(got) == 300 and set(got) == tree_cycles(edges)


@pytest.mark.parametrize("parts", (1, 7))
def test_whole_torn_and_large_pieces(spark, parts):
    """Small graphs of any form, in one task and torn over seven, beside one of too many edges for a task."""
    r = random.Random(parts)
    edges = {(f"g{k:02}n{r.randrange(6)}", f"g{k:02}n{r.randrange(6)}") for k in range(12) for _ in range(9)}
    wide = [e for i in range(P.SMALL // 2 + 5) for e in ((f"z{i:04}", "hub"), ("hub", f"z{i:04}"))]
    imports = spark.createDataFrame(sorted(edges) + wide, "source string, target string").repartition(parts)
    got = {tuple(x["cycle"]) for x in G.cycles(imports).collect()}
    assert got == tree_cycles(edges) | {("hub", f"z{i:04}", "hub") for i in range(P.SMALL // 2 + 5)}


def test_pieces_go_on_into_the_next_chunk(monkeypatch):
    """Rows that stand together stay whole across chunks; every edge comes out once, with its piece."""
    monkeypatch.setattr(P, "CHUNK", 7)
    edges = rings(40, 6)
    table = pa.table({"source": [a for a, _ in edges], "target": [b for _, b in edges]})
    out = pa.Table.from_batches(list(P._found(iter(table.to_batches(4))))).to_pylist()
    assert {tuple(x["cycle"]) for x in out if x["cycle"]} == tree_cycles(edges)
    pieces = {}
    for x in out:
        if x["source"]:
            pieces.setdefault(x["piece"], []).append((x["source"], x["target"]))
    assert sorted(e for p in pieces.values() for e in p) == sorted(edges) and len(pieces) == 40
