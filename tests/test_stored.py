"""Merging into a stored graph, JDBC by an embedded database, registries."""

import os

import pytest

from sylva.operators.graph import safe_merge
from sylva.plans.stored import StoredGraph
from sylva.sources import tables

NODE = "id string, label string, physical_meta map<string, string>"
EDGE = "source string, target string, relation string, confidence string"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def files(root):
    return {os.path.join(at, n) for at, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def graph(spark, ids, links):
    nodes = spark.createDataFrame([(f"n{i}", f"label{i}", {"depth": str(i)}) for i in ids], NODE)
    return nodes, spark.createDataFrame([(f"n{a}", f"n{b}", "imports", "EXTRACTED") for a, b in links], EDGE)


def test_stored_merge_equals_safe_merge(spark, tmp_path):
    first = graph(spark, range(300), [(i, i + 1) for i in range(320)] + [(0, i) for i in range(2, 200)])
    second = (spark.createDataFrame([("n1", "other", {"depth": "9", "x": "1"}, 1), ("n1", "again", {"x": "2"}, 2), ("new", "n", None, 3), (None, "no", {}, 4)], NODE + ", at int"),
              spark.createDataFrame([("n1", "new", "imports", "EXTRACTED"), ("n1", "n2", "imports", "AMBIGUOUS"), ("n1", "nowhere", "imports", "X"), (None, "n1", "imports", "X")], EDGE))
    empty = graph(spark, [], [])
    one = safe_merge((*empty, {}), (*first, {"v": 1}))
    two = safe_merge((one.nodes, one.edges, one.metadata), (*second, {"w": 2}), "at")
    store = StoredGraph(spark, str(tmp_path / "g"), buckets=16)
    assert store.merge(*first, {"v": 1}) == one.stats
    assert rows(store.nodes) == rows(one.nodes) and rows(store.edges) == rows(one.edges)
    before = files(tmp_path / "g")
    assert StoredGraph(spark, str(tmp_path / "g")).merge(*second, {"w": 2}, "at") == two.stats
    assert rows(store.nodes) == rows(two.nodes) and rows(store.edges) == rows(two.edges) and store.metadata == two.metadata
    gone = {os.path.relpath(os.path.dirname(f), tmp_path / "g") for f in before - files(tmp_path / "g")}
    assert len([g for g in gone if g.startswith("nodes")]) <= 2 and len([g for g in gone if g.startswith("edges")]) == 1
    kept = files(tmp_path / "g")
    assert store.merge(*second, {"w": 2}, "at")["new_nodes"] == 0
    assert rows(store.edges) == rows(two.edges) and {f for f in kept if "/edges/" in f} <= files(tmp_path / "g")


def test_stored_merge_of_nothing(spark, tmp_path):
    store = StoredGraph(spark, str(tmp_path / "g"), buckets=4)
    none = graph(spark, [], [])
    assert store.merge(*none) == dict.fromkeys(("new_nodes", "updated_nodes", "added_edges", "skipped_edges"), 0)
    store.merge(*graph(spark, [1, 2], [(1, 2), (1, 2), (2, 1)]))
    assert store.nodes.count() == 2 and store.edges.count() == 2
    store.merge(*none)
    assert store.nodes.count() == 2 and store.edges.count() == 2


def four(spark):
    sample = {"string": "cast(id as string)", "bigint": "id", "double": "id / 4", "boolean": "id % 3 = 0"}
    out = {}
    for name, schema in tables.SCHEMAS.items():
        empty = spark.createDataFrame([], schema)
        texts = [f"if(id % 7 = 3 and '{f.name}' not like '%\\_id' and '{f.name}' != 'schema_version', null, {sample[f.dataType.simpleString()]}) as `{f.name}`" for f in empty.schema.fields]
        out[name] = spark.range(0, 1_000, 1, 4).selectExpr(*texts)
    return out


def test_round_trip_through_a_database(spark, tmp_path):
    url, source = f"jdbc:derby:{tmp_path}/db;create=true", four(spark)
    made = tables.export(source, "x", "psql", db_uri=url, schema="APP", key_type="VARCHAR(200)", batchsize="100")
    assert made.success and made.stats == dict.fromkeys(source, 1_000), made.warnings
    back = tables.load(spark, url, "postgresql", schema="APP", parts=4)
    assert back.success and set(back.tables) == set(source), back.warnings
    for name, df in back.tables.items():
        assert rows(df) == rows(source[name])
        shares = df.rdd.glom().map(len).collect()
        assert len(shares) == 4 and min(shares) > 200
    again = tables.export({"files_identity": source["files_identity"].limit(5)}, "x", "psql", db_uri=url, schema="APP", if_exists="append")
    assert again.success and tables.load(spark, url, "psql", schema="APP", names=["files_identity"]).tables["files_identity"].count() == 1_005


def test_keys_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(None, "a"), (3, "o'b"), (3, "c"), (3, "d"), (9, "o'b")], "k long, v string")
    df.write.option("createTableColumnTypes", "v VARCHAR(20)").jdbc(url, "APP.t")
    df.limit(0).write.jdbc(url, "APP.nothing")
    for key in ("k", "v"):
        for parts in (1, 2, 3, 50):
            got = tables.load(spark, url, "psql", schema="APP", names=["t", "nothing"], keys={"t": key}, parts=parts)
            assert got.success and rows(got.tables["t"]) == rows(df) and got.tables["nothing"].count() == 0, got.warnings
    assert not tables.load(spark, url, "psql", schema="APP", names=["absent"]).success


def test_registries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOADERS", dict(tables.LOADERS))
    monkeypatch.setattr(tables, "EXPORTERS", dict(tables.EXPORTERS))
    monkeypatch.setattr(tables, "DEFAULTS", dict(tables.DEFAULTS))
    df = spark.createDataFrame([("a", "1.0")], "x string, schema_version string")
    assert tables.export({"t": df}, str(tmp_path)).success and os.path.isfile(tmp_path / "t.csv")
    assert rows(tables.load(spark, str(tmp_path)).tables["t"]) == rows(df)
    for wrong in (None, "text", lambda: None, lambda a: None, lambda a, b, c: None):
        with pytest.raises(TypeError):
            tables.register_loader("x", ".x", wrong)
        with pytest.raises(TypeError):
            tables.register_exporter("x", wrong)
    tables.register_exporter(" JSON ", lambda df, path, **_: df.write.json(path + ".json"), default=True)
    tables.register_loader("Json", ".json", lambda s, path: s.read.json(path), default=True)
    assert tables.export({"t": df}, str(tmp_path)).success
    assert rows(tables.load(spark, str(tmp_path)).tables["t"]) == rows(df)
    with pytest.raises(ValueError, match="json"):
        tables.load(spark, str(tmp_path), "nope")
