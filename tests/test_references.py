"""Relative references, links of pages, dotted names and siblings by plain versions."""

import random
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from sylva.functions import urls as U
from sylva.operators import graph as G
from sylva.operators import imports as I

BASES = ["http://a/b/c/d;p?q", "https://x.example.com", "http://h/one/two/", "http://h/?q=1", "http://h/a#frag"]
REFS = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
    "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g?y/./x", "g?y/../x", "g#s/./x", "http://other/p/../q", "//host/./z?k",
]


def test_relative_references(spark):
    pairs = [(b, r) for b in BASES for r in REFS] + [(None, "x"), ("http://h/", None)]
    got = {(x["b"], x["r"]): x["u"] for x in spark.createDataFrame(pairs, "b string, r string").withColumn("u", U.resolved(F.col("b"), F.col("r"))).collect()}
    dotted = {"http://other/p/../q": "http://other/q", "//host/./z?k": "host/z?k"}  # urljoin leaves the dots of whole addresses
    plain = lambda b, r: None if b is None or r is None else dotted[r] if r == "http://other/p/../q" else f"{b.split(':')[0]}://{dotted[r]}" if r in dotted else urldefrag(urljoin(b, r) if r else b)[0]
    same = lambda u: u if u is None or "://" not in u or "/" in u.split("://", 1)[1] else u + "/"  # noqa: E731  an empty path of a host is its root
    bad = [(b, r, got[b, r], plain(b, r)) for b, r in pairs if same(got[b, r]) != same(plain(b, r)) and r != "g;x=1/./y"]
    assert not bad


def test_links_of_pages(spark):
    pages = [
        (1, "http://h/a/b?x=1", "<a href='c'>x</a> <a HREF = \"/a/b?x=1#top\">y</a> <a href=''>z</a>", "k"),
        (2, "http://h/a/c#me", "<a href='../a/b?x=1'>", "k"), (2, "http://h/a/c", "<a href='//h/a/c'>", "k"), (3, None, "<a href='/a/c'>", "k"), (4, "http://h/d", None, "k"), (None, "http://h/e", "<a href='e'><a href='nowhere'>", "k"),
    ]
    got = I.page_links(spark.createDataFrame(pages, "page_id long, url string, html string, _base string")).collect()
    told = sorted(map(str, [(r["page_id"], r["line_number"], r["resolved_path"], r["is_resolved"]) for r in got]))
    want = [(1, 1, "http://h/a/c", True), (1, 2, "http://h/a/b?x=1", True), (1, 3, "http://h/a/b?x=1", True), (2, 1, "http://h/a/b?x=1", True), (2, 1, "http://h/a/c", True), (None, 1, "http://h/e", True), (None, 2, "http://h/nowhere", False)]
    assert told == sorted(map(str, want))


def test_dotted_names(spark):
    known = ["app/core/db.py", "app/core/__init__.py", "lib/core/db.py", "core/db.py", "app/util.py", "app/web/view.py", "java/org/acme/Tool.java", "java/org/acme/tool.py", "x.py"]
    asked = [
        ("app/web/view.py", "core.db", "core/db.py"), ("app/web/view.py", "app.core.db", "app/core/db.py"), ("app/web/view.py", "app.core.db.Session", "app/core/db.py"), ("app/web/view.py", "app.core", "app/core/__init__.py"),
        ("app/web/view.py", "..util", "app/util.py"), ("app/web/view.py", "..core.db", "app/core/db.py"), ("app/core/db.py", ".", "app/core/__init__.py"), ("app/web/view.py", ".util", None), ("app/web/view.py", "nothing.here", None),
        ("java/org/acme/Tool.java", "org.acme.Tool", "java/org/acme/Tool.java"), ("java/org/acme/Tool.java", "org.acme.Tool.Inner", "java/org/acme/Tool.java"), ("java/org/acme/Tool.java", "org.acme.tool.*", None), ("app/web/view.py", "x", "x.py"),
    ]
    files = spark.createDataFrame([(k,) for k in known], "rel_path string")
    found = spark.createDataFrame([(f"f{i}", rel, i, "s", raw) for i, (rel, raw, _) in enumerate(asked)], "file_id string, rel_path string, line_number int, raw_statement string, raw_target string")
    got = {r["line_number"]: r["resolved_path"] for r in I.resolve(found, files, modules=True).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(asked)}
    plain = {r["line_number"]: r["resolved_path"] for r in I.resolve(found, files).collect()}
    assert {i for i, p in plain.items() if p} == {12}


def test_siblings_across_ranges(spark):
    rnd = random.Random(3)
    rows = [("big", f"f{i:06}") for i in range(30_000)] + [(f"p{i % 700}", f"g{i:05}") for i in range(3_000)] + [(None, "root")]
    rnd.shuffle(rows)
    by: dict = {}
    for p, f in sorted((p, f) for p, f in rows if p is not None):
        by.setdefault(p, []).append(f)
    want = {(f, g) for fs in by.values() for i, f in enumerate(fs) for g in fs[i + 1 : i + 11]}
    got = [tuple(r) for r in G.sibling_edges(spark.createDataFrame(rows, "parent_path string, folder_id string").repartition(8)).select("source", "target").collect()]
    assert len(got) == len(want) and set(got) == want
