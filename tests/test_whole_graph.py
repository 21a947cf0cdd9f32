"""The part graph of all orders, and its reachability, strong components and cycles by brute force."""

import os
import random

import duckdb
import pandas as pd
import pytest

from sylva.operators import graph as G
from sylva.operators import reach as RE
from sylva.plans.queries import ORACLE_SQL, QUERIES
from sylva.sources import bindings as B

from .test_queries import frame

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n in sorted(ORACLE_SQL) if "FROM lineitem" in ORACLE_SQL[n]]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        c.execute(f"create view {t[:-8]} as select * from '{SMALL}/{t}'")
    return c


def test_edges_of_every_order(spark, duck):
    want = duck.execute("select count(*) from (select distinct l_partkey, b from (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b from lineitem) where b is not null)").fetchone()[0]
    assert B.part_edges(spark, SMALL).count() == want


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_over_all_orders(spark, duck, name):
    got, want = frame(QUERIES[name](spark, SMALL).toPandas()), frame(duck.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


def brute(edges, hops):
    """{(node, ancestor)} by walks of 1 to hops edges."""
    out = front = {(b, a) for a, b in edges}
    for _ in range(hops - 1):
        front = {(n, a) for n, x in front for a, b in edges if b == x} - out
        out = out | front
    return out


@pytest.mark.parametrize(("seed", "hops"), [(0, None), (1, 3), (2, None), (3, 2)])
def test_reach_by_brute_force(spark, seed, hops):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range((40, 80, 110, 300)[seed])] + [("loop", "loop"), ("n1", "loop")]
    imports = spark.createDataFrame(edges + edges[:3], "source string, target string")
    pairs = brute(set(edges), hops or 100)
    want = {n: sum(1 for x, _ in pairs if x == n) for n, _ in pairs}
    assert {x["id"]: x["transitive_impact"] for x in G.reach_counts(imports, hops).collect()} == want
    if hops is None:
        both = {(n, a) for n, a in pairs if (a, n) in pairs}
        want = {n: min(a for x, a in both if x == n) for n, _ in both}
        assert {x["id"]: x["component"] for x in G.cyclic_components(imports).collect()} == want


def test_reach_of_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert G.reach_counts(none).count() == 0 and G.cyclic_components(none).count() == 0 and G.cycles(none).count() == 0


def test_hop_limit_and_more_than_a_block(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(60)], "source string, target string")
    got = {r["id"]: r["transitive_impact"] for r in G.reach_counts(chain).collect()}
    assert got == {f"n{i:02}": min(i, 51) for i in range(1, 61)}
    star = spark.createDataFrame([(f"s{i}", "hub") for i in range(3000)] + [("hub", "end"), ("end", "x"), ("x", "y"), ("y", "end")], "source string, target string")
    assert {r["id"]: r["transitive_impact"] for r in G.reach_counts(star).collect()} == {"hub": 3000, "end": 3004, "x": 3004, "y": 3004}


def test_long_ring_and_tail(spark):
    """A ring of 2,000 with a path into it and one out of it; the limit of hops binds everywhere but near the path's start."""
    edges = [(f"r{i:04}", f"r{(i + 1) % 2000:04}") for i in range(2000)] + [(f"a{i:02}", f"a{i + 1:02}") for i in range(70)] + [("a70", "r0000"), ("r1000", "z0"), ("z0", "z1")]
    imports = spark.createDataFrame(edges, "source string, target string")
    found = G.cyclic_components(imports).collect()
    assert len(found) == 2000 and {r["component"] for r in found} == {"r0000"}
    got = {r["id"]: r["transitive_impact"] for r in G.reach_counts(imports).collect()}
    assert got == {f"a{i:02}": min(i, 51) for i in range(1, 71)} | {f"r{i:04}": 51 + max(0, 51 - i) for i in range(2000)} | {"z0": 51, "z1": 51}


def test_what_is_far_from_the_largest_component(spark, monkeypatch):
    """By brute force where only the limit tells: a core with paths into it, within it, out of it and past it."""
    used, arrived, hops = [], RE._arrived, 4
    edges = [e for i in range(10) for e in (("hub", f"c{i}"), (f"c{i}", "hub"))] + [(f"u{i}", f"u{i + 1}") for i in range(6)] + [("u6", "hub"), ("u2", "b1")]
    edges += [("c0", "d0"), ("d0", "d1"), ("d1", "d2"), ("d2", "hub"), ("c1", "b0"), ("b0", "b1"), ("b1", "b2")]
    monkeypatch.setattr(RE, "BLOCK", 1)
    monkeypatch.setattr(RE, "_arrived", lambda *a: used.append(1) or arrived(*a))
    got = {x["id"]: x["transitive_impact"] for x in G.reach_counts(spark.createDataFrame(edges, "source string, target string"), hops).collect()}
    pairs = brute(set(edges), hops)
    assert got == {n: sum(1 for x, _ in pairs if x == n) for n, _ in pairs} and used


def test_members_of_many_edges_show_what_is_within_the_hops(spark, monkeypatch):
    """On a ring both ways the root's bound is twice the true distance; nothing is walked, and counts are those of brute force."""

    def walked(*_):
        raise AssertionError("walked although sure")

    ring = [e for i in range(10) for e in ((f"c{i}", f"c{(i + 1) % 10}"), (f"c{(i + 1) % 10}", f"c{i}"))] + [("u0", "c3"), ("c3", "c0")]
    monkeypatch.setattr(RE, "BLOCK", 1)
    monkeypatch.setattr(RE, "_walked", walked)
    monkeypatch.setattr(RE, "_arrived", walked)
    got = {x["id"]: x["transitive_impact"] for x in G.reach_counts(spark.createDataFrame(ring, "source string, target string"), 6).collect()}
    pairs = brute(set(ring), 6)
    assert got == {n: sum(1 for x, _ in pairs if x == n) for n, _ in pairs}


def test_what_no_member_shows_is_walked(spark, monkeypatch):
    """By brute force on a random graph with one node a block, where the limit binds for some of the members."""
    r, hops = random.Random(5), 4
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(100)] + [(f"t{i}", f"t{i + 1}") for i in range(4)] + [("t4", "n1"), ("n2", "t0")]
    monkeypatch.setattr(RE, "BLOCK", 1)
    got = {x["id"]: x["transitive_impact"] for x in G.reach_counts(spark.createDataFrame(edges, "source string, target string"), hops).collect()}
    pairs = brute(set(edges), hops)
    assert got == {n: sum(1 for x, _ in pairs if x == n) for n, _ in pairs}


def tree_cycles(edges):
    """By the definition: breadth-first trees of the strong components from their smallest members."""
    pairs = brute(set(edges), 100)
    members = {}
    for n in {x for e in edges for x in e}:
        if (n, n) in pairs:
            members.setdefault(min(a for x, a in pairs if x == n and (a, n) in pairs), set()).add(n)
    out = set()
    for root, own in members.items():
        inner, path, front = {(a, b) for a, b in edges if a in own and b in own}, {root: [root]}, [root]
        while front:
            found = {}
            for a, b in inner:
                if a in front and b not in path:
                    found[b] = min(found.get(b, [chr(0x10FFFF)]), [*path[a], b])
            path |= found
            front = list(found)
        out |= {(*path[a][path[a].index(b) :], b) for a, b in inner if b in path[a]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cycles_by_brute_force(spark, seed):
    r = random.Random(seed)
    edges = {(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range((30, 60, 110)[seed])} | {("x", "y"), ("y", "x"), ("y", "z"), ("z", "y"), ("loop", "loop")}
    got = [tuple(x["cycle"]) for x in G.cycles(spark.createDataFrame(sorted(edges), "source string, target string")).collect()]
    assert len(got) == len(set(got)) and set(got) == tree_cycles(edges)
    assert {("x", "y", "x"), ("y", "z", "y"), ("loop", "loop")} <= set(got)


def test_cycle_finding_is_of_the_part_graph(spark):
    """As many as the parts on cycles, by brute force over the edges of every order."""
    following, reached = {}, {}
    for r in B.part_edges(spark, SMALL).collect():
        following.setdefault(r["source"], set()).add(r["target"])
    for start in following:
        front, seen = [start], set()
        while front:
            fresh = following.get(front.pop(), set()) - seen
            seen |= fresh
            front += fresh
        reached[start] = seen
    want = sorted(n for n, seen in reached.items() if n in seen)
    got = QUERIES["q34_cycle_finding"](spark, SMALL).first()
    assert (got["description"], got["evidence"]) == (f"Found {len(want)} cycles.", ",".join(want[:3]))


def _dense(copies=3, n=60):
    """Copies of a core of many edges, with single nodes before, between and behind them, loops and a ring of two cores."""
    r = random.Random(9)
    edges = {(f"c{k}n{r.randrange(n):02}", f"c{k}n{r.randrange(n):02}") for k in range(copies) for _ in range(n * 20)}
    edges |= {(f"in{i}", f"c{i % copies}n{i:02}") for i in range(9)} | {(f"c{i % copies}n{i:02}", f"out{i}") for i in range(9)}
    return edges | {("c0n00", "c1n00"), ("c1n01", "mid"), ("mid", "c0n01"), ("c1n02", "c2n02"), ("out0", "out0")}


def test_many_edges_a_node_are_contracted_along_a_part_first(spark, monkeypatch):
    """Components, reach within a limit of hops and imports that are repeated, by brute force; the first turn has a part of the edges."""
    edges, sizes, turn = _dense(), [], RE._turn
    monkeypatch.setattr(RE, "_turn", lambda live, n: sizes.append(live.count()) or turn(live, n))
    imports = spark.createDataFrame(sorted(edges) * 2, "source string, target string")
    following = {}
    for a, b in edges:
        following.setdefault(a, set()).add(b)
    pairs = set()
    for a in following:
        front, seen = {a}, set()
        for _ in range(51):
            front = {b for x in front for b in following.get(x, ())} - seen
            seen |= front
        pairs |= {(b, a) for b in seen}
    both = {(n, a) for n, a in pairs if (a, n) in pairs}
    got = {x["id"]: x["component"] for x in G.cyclic_components(imports).collect()}
    least = {}
    for n, a in both:
        least[n] = min(a, least.get(n, a))
    assert got == least
    assert sizes[0] < len(edges) / 2
    ids = sorted({x for e in edges for x in e})
    files = spark.createDataFrame([(x,) for x in ids], "id string")
    got = {x["id"]: (x["direct_impact"], x["transitive_impact"]) for x in G.impact(files, imports, once=True).collect()}
    assert got == {n: (sum(1 for _, b in edges if b == n), sum(1 for x, _ in pairs if x == n)) for n in ids}


def test_ids_whose_numbers_clash_are_numbered_by_joins(spark, monkeypatch):
    monkeypatch.setattr(RE, "RANK_BITS", 2)
    imports = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)] + [(None, "n0"), ("n8", None)], "source string, target string")
    ids, edges = RE.numbered_graph(imports)
    name = {r["v"]: r["id"] for r in ids.collect()}
    assert len(name) == 9 and {(name[r["a"]], name[r["b"]]) for r in edges.collect()} == {(f"n{i}", f"n{i + 1}") for i in range(8)}


def test_merged_edges_are_made_once_and_nodes_not_at_all(spark):
    """The slices of q24 and q25 read edges that were written once, and q24 merges no metadata for its ids."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = plan(QUERIES["q24_merge_edges"](spark, SMALL))
    assert "lead(" not in got and "collect_list" not in got
