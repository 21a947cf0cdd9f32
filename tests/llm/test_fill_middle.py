"""Fill-in-the-middle against SQL and a plain version."""

import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import sylva.llm.fill_middle as fm
from sylva.llm.fill_middle import MARKS, OP11_SQL, fill_in_middle, op11_fill_in_middle, restored

DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def plain(i, text, unit="char", rate=90, spm=20):
    """By slices of a Python string, units by a pattern."""
    text = text or ""
    pattern = {"char": r"(?s).", "word": r"[ \t-\r]+|[^ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    units = re.findall(pattern, text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    want = db.execute(f"select {', '.join(COLUMNS)} from ({OP11_SQL})").fetchall()
    got = [tuple(r) for r in op11_fill_in_middle(spark, DATA).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in got} == {"plain", "psm", "spm"}


ODD = ["", None, "a", "ab", "  \n\t", "é\U0001f600中" * 50, "has <S> inside", "<P>", "ends with <", "<<<PSM>>>", "line\nline\n\nlast", "x " * 3_000, "áb\r\nc", "\u0085   word"]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_odd_texts_all_units(spark, unit, monkeypatch):
    rows = [(i, ODD[i % len(ODD)], "x") for i in range(20 * len(ODD))] + [(None, "no id"), (None, None), (5, "again"), (5, "again")]
    rows = [(*r, "x")[:3] for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    made = restored(fill_in_middle(df, unit=unit)).collect()
    got = sorted(map(str, [(r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in made]))
    want = sorted(map(str, [(i, *plain(i, t, unit), t or "") for i, t, _ in rows]))
    assert got == want


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(fm, "WINDOW", 7)
    text = "ab  c\n\ndéf \U0001f600 g\n" * 9
    for unit in fm.UNITS:
        for i in range(200):
            digest = hashlib.sha256(f"1:{i}".encode()).hexdigest()
            draws = tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
            made = fm.arranged(text.encode(), draws, unit, 90, 20, tuple(m.encode() for m in MARKS))
            assert (*made[:4], made[4].decode()) == plain(i, text, unit)


def test_broken_utf8_empty_table_and_bad_markers(spark):
    raw = b"ok \xff\xe2\x82 then \xc3\xa9 \xed\xa0\x80 end" * 5
    df = spark.createDataFrame([(i, bytearray(raw)) for i in range(40)], "doc_id long, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text"))
    made = restored(fill_in_middle(df)).select("form", F.col("text").cast("binary").alias("t"), "prefix_chars", "n").collect()
    assert all(bytes(r["t"]) == raw for r in made) and {r["form"] for r in made} >= {"psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "x", "y"), ("ab", "xaby", "z")):
        with pytest.raises(ValueError, match="markers"):
            fill_in_middle(df, marks=marks)
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(df, unit="page")


def test_other_id_types_and_rates(spark):
    df = spark.createDataFrame([("x1", "some text here"), ("x2", "more of it")], "doc_id string, text string")
    made = {r["id"]: r for r in fill_in_middle(df, rate=100, spm=100, marks=("[a]", "[b]", "[c]")).collect()}
    assert all(r["form"] == "spm" and r["output"].startswith("[b]") for r in made.values())
    assert {r["form"] for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
