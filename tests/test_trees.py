"""Directory trees from disk to graph, reports and relational tables."""

import json
import random

import pytest

from sylva.functions.paths import glob_regex
from sylva.operators import relational as R
from sylva.operators.graph import cycles, merge_nodes
from sylva.plans import api
from sylva.plans.config import IGNORE, Config, ignore_patterns, load
from sylva.plans.render import RENDERERS


def tree(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_clean_tree(spark, tmp_path):
    names = ["src/__init__.py", "src/main.py", "src/config.py", "src/utils/__init__.py", "src/utils/helpers.py", "tests/__init__.py", "tests/test_main.py"]
    a = api.run_analysis(spark, tree(tmp_path / "clean", dict.fromkeys(names, "")))
    assert (a.folders.count(), a.files.count(), a.nodes.count()) == (4, 7, 11)
    assert {r["relation"]: r["count"] for r in a.edges.groupBy("relation").count().collect()} == {"contains": 7, "sibling": 1}
    assert {r["rel_path"]: r["weight_score"] for r in a.folders.collect()} == {".": 0.5, "src": 0.75, "tests": 0.4833, "src/utils": 0.3333}
    assert a.entropy.first()[0] == 0.8631


def test_cycle_report_and_round_trip(spark, tmp_path):
    root = tree(tmp_path / "c", {"a.py": "import b\n", "b.py": "import c\nimport os\n", "c.py": "import a\n", "d.txt": "import a"})
    a = api.run_analysis(spark, root)
    assert [set(r["cycle"]) for r in a.cycles.collect()] == [{"fs:file:a.py", "fs:file:b.py", "fs:file:c.py"}]
    assert api.main(spark, root, str(tmp_path / "out")) == 1
    assert json.loads((tmp_path / "out/structure_report.json").read_text())["critical"] == 1
    for fmt in ("csv", "parquet"):
        assert api.export_relational(a, fmt, str(tmp_path / fmt)).success
        merged, report = api.import_relational(spark, str(tmp_path / fmt), fmt)
        assert (merged.nodes.count(), merged.edges.count(), report.version) == (a.nodes.count(), 3, "1.0.0")
        again, _ = api.import_relational(spark, str(tmp_path / fmt), fmt, api.graph_of(a))
        assert again.stats == {"new_nodes": 0, "updated_nodes": a.nodes.count(), "added_edges": 0, "skipped_edges": 3}
        assert again.metadata["merge_report"] == again.stats and again.metadata["root_path"] == a.metadata["root_path"]
    assert not api.export_relational(a, "hdf5", str(tmp_path / "h")).success


def test_failures(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert not api.run_analysis_safe(spark, str(tmp_path / "empty"))["success"]
    assert api.main(spark, str(tmp_path / "none"), str(tmp_path / "o")) == 3
    with pytest.raises(ValueError):
        api.tables.export({}, "x", "nope")


def test_ignored_folders_errors_and_config(spark, tmp_path):
    names = ["src/a.py", "src/__pycache__/a.pyc", "node_modules/x/y.js", "src/deep/er/b.py", "notes.tmp", "src/.hidden/c.py"]
    root = tmp_path / "ig"
    tree(root, dict.fromkeys(names, ""))
    (root / ".treeignore").write_text("__pycache__\nnode_modules\n*.tmp\n")
    (root / "tree-config.json").write_text(json.dumps({"layer_rules": {"src/*": "core"}, "thresholds": {"structure": {"max_depth": 1}}, "max_file_size_mb": 1}))
    (root / "src" / "gone.py").symlink_to(root / "nowhere")
    config = load(root)
    assert config.layer_rules["src/*"] == "core" and config.max_file_mb == 1 and config.limit("structure", {})["max_depth"] == 1
    got = api.tree.scan(spark, str(root), config.ignore).collect()
    assert {r["rel_path"] for r in got if r["kind"] == "folder"} == {".", "src", "src/deep", "src/deep/er", "src/.hidden"}
    assert {r["rel_path"] for r in got if r["kind"] == "file"} == {"src/a.py", "src/deep/er/b.py", "src/.hidden/c.py", "src/gone.py", ".treeignore", "tree-config.json"}
    assert [r["rel_path"] for r in got if r["error"]] == ["src/gone.py"]
    (root / "tree-config.json").write_text("{broken")
    assert load(root).layer_rules == Config().layer_rules
    made = api.run_analysis_safe(spark, str(root))
    assert made["success"] and len(made["errors"]) == 1 and made["errors"][0].startswith("scan: ")


def test_many_folders_are_shared_out(spark, tmp_path):
    root = tree(tmp_path / "wide", {f"one/d{i:03}/s/f.py": "" for i in range(90)})
    got = api.tree.scan(spark, root)
    assert got.rdd.getNumPartitions() > 60
    assert got.where("kind = 'folder'").count() == 2 + 180 and got.where("kind = 'file'").select("rel_path").distinct().count() == 90 == got.where("kind = 'file'").count()


def test_languages_and_white_space(spark, tmp_path):
    files = {
        "a.py": "\tfrom util import y \t\nimport util\n", "util.py": "", "js/m.js": "import x from './n'\nrequire('../lib/p.ts')\nconst q = require('x')\n", "js/n.ts": "import {z} from \"../js/m\"\n",
        "lib/p.ts": "", "J.java": "import util;\nimport static a.b;\n", "g.go": '"./util"\nimport "fmt"\n', "c/x.c": '#include "./y.cpp"\n', "c/y.cpp": "#include <../util.py>\n", "r.rb": "require './util'\nrequire_relative 'x'\n", "p.php": "include './util';\n",
    }
    a = api.run_analysis(spark, tree(tmp_path / "ml", files))
    got = {(r["file_id"], r["line_number"]): (r["raw_statement"], r["resolved_path"]) for r in a.imports.collect()}
    assert got == {
        ("fs:file:a.py", 1): ("from util import y", "util.py"), ("fs:file:a.py", 2): ("import util", "util.py"), ("fs:file:js:m.js", 1): ("import x from './n'", "js/n.ts"), ("fs:file:js:m.js", 2): ("require('../lib/p.ts')", "lib/p.ts"),
        ("fs:file:js:n.ts", 1): ('import {z} from "../js/m"', "js/m.js"), ("fs:file:J.java", 1): ("import util;", "util.py"), ("fs:file:g.go", 1): ('"./util"', "util.py"), ("fs:file:c:x.c", 1): ('#include "./y.cpp"', "c/y.cpp"),
        ("fs:file:c:y.cpp", 1): ("#include <../util.py>", "util.py"), ("fs:file:r.rb", 1): ("require './util'", "util.py"), ("fs:file:p.php", 1): ("include './util';", "util.py"),
    }


def test_reports_and_hook(spark, tmp_path):
    root = tree(tmp_path / "rep", {"a.py": "import b\n", "b.py": "import a\n", "l1/l2/l3/l4/l5/l6/c.py": "", "t<x>.py": ""})
    a = api.run_analysis(spark, root)
    made = api.report(spark, a)
    for name, (_, render) in RENDERERS.items():
        text = render(made)
        assert all(i["insight_id"] in text for i in made["insights"]) and (name == "json" or "Traceability" in text and "Actions" in text)
    assert api.report(spark, a, active=["impact", "nope"])["active_extractors"] == ["impact"]
    assert {k: set(v) for k, v in api.raw_findings(a, ["structure", "dependency"]).items()} == {"structure": {"folder_tree_depths", "folder_weights", "global_entropy"}, "dependency": {"circular_deps"}}
    old = api.legacy_report(spark, a)
    assert [i["insight_id"] for i in old["insights"]] == ["INS-CYCLE-001", "INS-HOTSPOT-002", "INS-GODFOLDER-003", "INS-DEPTH-004"] and old["metadata"]["health_score"] == 50.0
    assert old["ranked_lists"]["most_depended_files"][0]["imported_by"] == 1 and old["ranked_lists"]["orphan_files"] == [{"id": "fs:file:l1:l2:l3:l4:l5:l6:c.py"}, {"id": "fs:file:t<x>.py"}]
    api.write_legacy_report(old, str(tmp_path / "legacy"))
    assert json.loads((tmp_path / "legacy/architectural_insights.json").read_text())["report_version"] == "1.1.0" and "Heaviest folders" in (tmp_path / "legacy/architectural_insights.md").read_text()
    api.write_graph(a, str(tmp_path / "graph"))
    about = json.loads(spark.read.text(str(tmp_path / "graph/metadata")).first()[0])
    assert about["aggregated_metrics"]["total_imports"] == 2 and about["metadata"]["root_path"] == root
    api.register("mine", lambda a, limits: api.N.dependency(a.cycles.selectExpr("cycle[0] as id"), {"cycles_allowed": limits["most"]}), {"most": 0})
    assert api.find_insights(spark, a, Config(), active=["mine"]).count() == 1
    assert api.Hook()(spark, root, {"x": 1}) == {"x": 1}
    assert api.Hook(True)(spark, str(tmp_path / "no"), {"x": 1})["metadata"]["analysed"] is False
    own = spark.createDataFrame([("fs:file:a.py", "mine", "physical_file", None, {"depth": "9", "note": '"n"'}), ("else", "e", "physical_file", None, {})], R.NODE)
    edges = api.graph_of(a)[1].where("relation = 'imports'").limit(1)
    got = api.Hook(True)(spark, root, {"nodes": own, "edges": edges, "metadata": {"analyzer": "host"}})
    node = got["nodes"].where("id = 'fs:file:a.py'").first()
    assert node["label"] == "mine" and node["physical_meta"]["depth"] == "1" and node["physical_meta"]["note"] == '"n"'
    assert got["nodes"].count() == a.nodes.count() + 1 and got["edges"].count() == a.edges.count() and got["metadata"]["merge_report"]["updated_nodes"] == 1


def nested(flat):
    out = {}
    for k, v in flat.items():
        at = out
        *way, last = k.split(".")
        for w in way:
            at = at.setdefault(w, {})
        at[last] = v
    return out


def deep_update(base, new):
    for k, v in new.items():
        if isinstance(base.get(k), dict) and isinstance(v, dict):
            deep_update(base[k], v)
        else:
            base[k] = v


def test_merge_by_brute_force(spark):
    r = random.Random(3)
    paths = ["a", "a.b", "a.b.c", "a.d", "e", "e.f"]

    def meta():
        flat = {}
        for k in r.sample(paths, 3):
            if not any(x.startswith(k + ".") or k.startswith(x + ".") for x in flat):
                flat[k] = str(r.randrange(100))
        return flat

    old, new = [(f"n{i}", f"old{i}", meta()) for i in range(8)], [(f"n{r.randrange(12)}", f"new{i}", meta(), i) for i in range(60)]
    want = {i: (label, nested(m)) for i, label, m in old}
    for i, label, m, _ in new:
        if i in want:
            deep_update(want[i][1], nested(m))
        else:
            want[i] = (label, nested(m))
    kind = "id string, label string, physical_meta map<string, string>"
    got = merge_nodes(spark.createDataFrame(old, kind), spark.createDataFrame([*new, (None, "x", {}, 99)], kind + ", ord int"), "ord").collect()
    assert {g["id"]: (g["label"], nested(g["physical_meta"])) for g in got} == want
    assert sum(g["repeats"] for g in got) + sum(g["merge_state"] == "new" for g in got) == 60


def test_reference_report(spark):
    none = {"files_identity": spark.createDataFrame([], "file_id string"), "folders_hierarchy": spark.createDataFrame([(None,)], "folder_id string")}
    assert not R.check_references(none).is_valid and R.check_references(none).errors
    some = {"files_identity": spark.createDataFrame([("f", "p"), ("g", "q"), ("h", None)], "file_id string, parent_folder_id string"), "folders_hierarchy": spark.createDataFrame([("p",)], "folder_id string"), "import_dependencies": spark.createDataFrame([("f", "g"), ("x", "g"), ("x", "g"), (None, "f")], "source_id string, target_id string")}
    got = R.check_references(some)
    assert got.is_valid and len(got.warnings) == 2 and got.stats == {"import_edges_total": 3, "import_edges_valid": 2, "files_with_valid_parent": 1}
    assert {r["rule"] for r in R.violations(None, None, {}).collect()} == {"root key missing: nodes", "root key missing: edges"}
    assert R.to_graph({})[0].count() == 0 and R.to_graph({"folders_hierarchy": some["folders_hierarchy"]})[1].count() == 0


def test_ddl_and_unknown_formats(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, True, 0.5, "1.0.0")], "file_id string, n bigint, b boolean, d double, schema_version string")
    assert api.tables.ddl("t", df).replace("\n", " ") == 'CREATE TABLE IF NOT EXISTS public.t (     "file_id" TEXT,     "n" BIGINT,     "b" BOOLEAN,     "d" DOUBLE PRECISION );'
    made = api.tables.export({"t": df, "empty": df.limit(0)}, str(tmp_path), "psql")
    assert made.success and made.stats == {"t": 1} and len(made.warnings) == 1 and "CREATE TABLE" in spark.read.text(str(tmp_path / "t.sql"), wholetext=True).first()[0]
    assert not api.tables.load(spark, "jdbc:postgresql://nowhere/x", "psql").success
    with pytest.raises(ValueError):
        api.tables.load(spark, "x", "nope")


def test_small_parts(spark, tmp_path):
    assert sorted(r["cycle"] for r in cycles(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "source string, target string")).collect()) == [["a", "b", "a"], ["c", "c"]]
    assert glob_regex("*.p[!x]?") == "(?s)^(?:.*\\.p[^x].)$"
    assert ignore_patterns(tmp_path / "none") == IGNORE
    (tmp_path / "i").write_text("# no\n\n*.pyc\n  # kept\n")
    assert ignore_patterns(tmp_path / "i") == ("*.pyc", "# kept")
    assert Config().overlay({"weight_coeffs": {"density": 1}}).weights["centrality"] == 0.2
