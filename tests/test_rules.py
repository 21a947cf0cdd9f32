"""Many rules by one automaton against the chain of expressions."""

import random

import pytest
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.functions.rules import literal_of


def test_literals():
    want = {"src/*.py": ("src/", True), "*.py": (".py", False), "?": ("", False), "a[bc]def": ("def", False), "a[bc": ("a[bc", True), "[]x]": ("", False), "[!]]yy": ("yy", False), "exact": ("exact", True), "": ("", False), "a[!]": ("a[!]", True)}
    assert {g: literal_of(g) for g in want} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_first_match_equals_the_chain(spark, monkeypatch, seed):
    r = random.Random(seed)
    rules = {"".join(r.choice(["a", "b", "/", ".", "*", "?", "[ab]", "[!a]", "[", "]", "é", "😀", "+"]) for _ in range(r.randrange(1, 6))): r.choice([*P.LAYERS, "odd"]) for _ in range(120)}
    rules = {g: x for g, x in rules.items() if g.strip("*")}
    texts = ["".join(r.choice("ab/.é😀+[]\n\r ") for _ in range(r.randrange(7))) for _ in range(800)] + ["test/x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = lambda: {x["i"]: x["l"] for x in df.select("i", P.layer(F.col("t"), rules).alias("l")).collect()}
    plain = made()
    monkeypatch.setattr(P, "MANY_RULES", 0)
    assert made() == plain and len(set(plain.values())) > 3


def test_five_thousand_rules_in_one_pass(spark):
    names = [*P.LAYERS]
    rules = {f"d{i}/*": names[i % 6] for i in range(2_500)} | {f"*.x{i}": names[i % 5] for i in range(2_500)} | {"*": "external"}
    df = spark.range(0, 20_000, 1, 4).select("id", F.format_string("d%d/a/f.x%d", F.col("id") % 4_000, F.col("id") % 3_000).alias("p"))
    got = {x["id"]: x["l"] for x in df.select("id", P.layer(F.col("p"), rules).alias("l")).collect()}
    want = lambda i: names[i % 4_000 % 6] if i % 4_000 < 2_500 else names[i % 3_000 % 5] if i % 3_000 < 2_500 else "external"
    assert got == {i: want(i) for i in range(20_000)}
