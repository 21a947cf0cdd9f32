"""Listing in rounds, filters that reach the source, and files that stay closed."""

import builtins
import os

import pytest
from pyspark.sql import functions as F

from sylva.sources import tree


def walked(root):
    out = {(".", "folder")}
    for at, folders, files in os.walk(root):
        rel = os.path.relpath(at, root)
        out |= {(n if rel == "." else f"{rel}/{n}", kind) for kind, names in (("folder", folders), ("file", files)) for n in names}
    return out


def told(df):
    rows = [(r["rel_path"], r["kind"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src/_hidden/.deep").mkdir(parents=True)
    (root / "empty").mkdir()
    for rel, text in {"src/a.py": "import b\n", "src/b.PY": "x" * 100, "src/_hidden/.deep/c.js": "", "src/d.txt": "no source", "e é\n.py": "1"}.items():
        (root / rel).write_text(text)
    return root


def test_deep_narrow_tree(spark, tmp_path):
    deep = tmp_path.joinpath(*["d"] * 400)
    deep.mkdir(parents=True)
    (deep / "end.py").write_text("")
    assert told(tree.list_tree(spark, str(tmp_path))) == walked(tmp_path)
    last = tmp_path.joinpath(*["d"] * 392)
    assert told(tree.list_tree(spark, str(last), budget=1)) == walked(last)  # a round a level


def test_rounds_of_small_budget(spark, tmp_path):
    for i in range(30):
        for j in range(5):
            (tmp_path / f"f{i}" / f"g{j}").mkdir(parents=True)
            (tmp_path / f"f{i}" / f"g{j}" / "x.py").write_text("")
    for budget, given in ((1, 1), (7, 3), (10_000, 256)):
        assert told(tree.list_tree(spark, str(tmp_path), budget=budget, given=given)) == walked(tmp_path)
    assert told(tree.list_tree(spark, str(tmp_path), ignore=("g[1-4]", "f2*"))) == {x for x in walked(tmp_path) if not any(s[:2] in ("g1", "g2", "g3", "g4", "f2") for s in x[0].split("/"))}


def test_wide_folder_is_many_tasks(spark, tmp_path):
    wide = tmp_path / "wide"
    wide.mkdir()
    for i in range(100_000):
        os.close(os.open(wide / f"{i}.txt", os.O_CREAT))
    got = tree.scan(spark, str(tmp_path), columns=("kind", "rel_path", "size_bytes"))
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 100_002 and len(parts) >= 15 and max(parts) < 3 * tree.NAMES
    assert got.agg(F.count_distinct("rel_path"), F.sum("size_bytes")).first() == (100_002, 0)


def test_missing_root_and_links(spark, tmp_path):
    assert [(r["kind"], r["rel_path"]) for r in tree.list_tree(spark, str(tmp_path / "none")).orderBy("kind").collect()] == [("error", "."), ("folder", ".")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "to_folder")
    os.symlink(tmp_path / "gone", tmp_path / "to_nothing")
    got = {r["rel_path"]: (r["kind"], r["error"] is None) for r in tree.scan(spark, str(tmp_path)).collect()}
    assert got == {".": ("folder", True), "a": ("folder", True), "a/x.py": ("file", True), "to_folder": ("folder", True), "to_nothing": ("file", False)}


@pytest.mark.parametrize("when", [
    "kind = 'file' and size_bytes > 5", "size_bytes between 1 and 10", "name like '%.py'", "name like '%a%' and kind <> 'folder'", "rel_path like 'src/%'",
    "parent_path = '.'", "parent_path is null", "kind in ('folder', 'x')", "name > 'b'", "size_bytes = 100 or name = 'a.py'", "content is not null", "size_bytes is null",
])
def test_filters_agree_with_the_whole_table(spark, root, when):
    everything = tree.scan(spark, str(root)).collect()
    plain = spark.createDataFrame(everything, tree.SCHEMA).where(when)
    assert sorted(map(str, tree.scan(spark, str(root)).where(when).collect())) == sorted(map(str, plain.collect()))


def test_plan_shows_the_filters(spark, root, capsys):
    tree.scan(spark, str(root)).where("size_bytes > 5 and kind = 'file'").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(size_bytes,5), EqualTo(kind,file)]" in plan and ") Filter" not in plan


def test_only_the_needed_files_are_opened(spark, root, monkeypatch):
    listing = os.path.dirname(tree.list_tree(spark, str(root)).inputFiles()[0])
    opened, true_open = [], builtins.open
    monkeypatch.setattr(builtins, "open", lambda f, *a, **k: (opened.append(str(f)), true_open(f, *a, **k))[1])

    def read(columns, filters=()):
        opened.clear()
        reader = tree.TreeReader({"path": str(root), "listing": listing}, columns)
        assert list(reader.pushFilters(list(filters))) == []
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return rows, [os.path.relpath(f, root) for f in opened if f.startswith(str(root))]

    rows, files = read([c for c in tree.COLUMNS if c != "content"])
    assert len(rows) == 10 and files == []
    rows, files = read(tree.COLUMNS)
    assert sorted(files) == ["e é\n.py", "src/_hidden/.deep/c.js", "src/a.py", "src/b.PY"]
    rows, files = read(tree.COLUMNS, [tree.D.GreaterThan(("size_bytes",), 50), tree.D.EqualTo(("kind",), "file")])
    assert len(rows) == 1 and files == ["src/b.PY"]
