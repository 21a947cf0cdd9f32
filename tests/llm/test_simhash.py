import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sylva.llm.components import components
from sylva.llm.simhash import Similar, allocate, clusters, fingerprint, fingerprints, near_dedup, op8_simhash_dedup, shingles

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The fingerprint by its definition, bit by bit."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(ids, near):
    """The smallest id reachable of each, over all pairs."""
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if best[j] < best[i] and near(i, j):
                    best[i], changed = best[j], True
    return best


def test_query_against_all_pairs(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in docs.items()}
    want = linked(sorted(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op8_simhash_dedup(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_crowded_values_and_chains(spark):
    rnd = random.Random(3)
    rows, base = [], [rnd.getrandbits(63) for _ in range(12)]
    for n in range(500):
        x = base[n % 3 if n % 2 else rnd.randrange(12)]
        for _ in range(rnd.randrange(6)):
            x ^= 1 << rnd.randrange(63)
        rows.append((n, x))
    want = linked([n for n, _ in rows], lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 2)
    got = {r["id"]: r["component_id"] for r in clusters(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert got == want


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    costs = [np.vstack([np.zeros((1, 20)), np.cumsum(rng.random((4, 20)), axis=0)]) for _ in range(3)]
    got = allocate(costs, 4)
    assert (got.sum(axis=1) == 4 - 3 + 1).all()
    for r in range(20):
        price = lambda ts: sum(costs[i][t + 1, r] for i, t in enumerate(ts))  # noqa: E731, B023
        every = [(a, b, c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == 2]
        assert price(got[r]) == pytest.approx(min(map(price, every)))


def test_defined_results(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One two", "d"), (4, "one  TWO", "e"), (None, "one two", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = fingerprints(docs).collect()
    assert len(got) == len(rows) and {r["fp"] for r in got if r["id"] in (1, 2, 3)} == {0}
    assert len({r["fp"] for r in got if r["id"] in (4, None)}) == 1
    out = clusters(fingerprints(docs)).collect()
    assert sorted((r["id"] or -1, r["component_id"]) for r in out) == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert clusters(fingerprints(docs.limit(0))).count() == 0


def test_very_long_text():
    text = "word other third " * 100_000
    f = shingles(text, 3)
    assert len(f) == 300_000 - 2
    assert fingerprint(f) == fingerprint(f[:3]) != 0


def prose(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnop", k=6)) for i in range(800)]


def test_near_dedup_against_all_pairs(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(25):
        words = prose(rnd, rnd.randrange(150, 300))
        texts.append(words)
        for _ in range(rnd.randrange(4)):
            copy = list(words)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(VOCABULARY)
            texts.append(copy)
    texts += [prose(rnd, 40) for _ in range(10)]
    rnd.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = {i for i, least in linked(range(len(texts)), near).items() if i == least}
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = near_dedup(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < len(texts)


def test_sketches_lose_no_link(spark):
    """Of a group of near copies around 0.8, the sketches keep every similar pair and leave out most others."""
    rnd = random.Random(4)
    base, texts = prose(rnd, 150), []
    for _ in range(120):
        copy = list(base)
        for _ in range(rnd.randrange(8)):
            copy[rnd.randrange(len(copy))] = rnd.choice(VOCABULARY)
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    similar = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    check = Similar(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text", 5, 0.8)
    table = spark.createDataFrame(pairs, "a long, b long")
    held = check.sets(table)
    side = lambda c: held.select(held["id"].alias(c), held["sketch"].alias(f"k{c}"))
    may = {(r["a"], r["b"]) for r in table.join(side("a"), "a").join(side("b"), "b").where(check.may("ka", "kb")).collect()}
    assert similar <= may and len(may) < len(similar) + (len(pairs) - len(similar)) / 3
    assert {(r["a"], r["b"]) for r in check.keep(table, held).collect()} == similar


def test_near_dedup_group_around_the_threshold(spark):
    """A crowded group of near copies, many of them below 0.8 to most others, gives the same documents as all pairs."""
    rnd = random.Random(5)
    base, texts = prose(rnd, 400), []
    for _ in range(60):
        copy = list(base)
        for _ in range(rnd.randrange(14)):
            copy[rnd.randrange(len(copy))] = rnd.choice(VOCABULARY)
        texts.append(" ".join(copy))
    sets = [set(shingles(t, 5)) for t in texts]
    prints = [fingerprint(list(set(shingles(t, 1)))) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = {i for i, least in linked(range(len(texts)), near).items() if i == least}
    got = near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == want and 1 < len(want) < len(texts)


def test_near_dedup_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "same words here"), (5, "SAME words\there"), (5, "same words here"), (6, "other words there"), (6, "other words there"), (None, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] or -1 for r in near_dedup(docs).collect()) == [1, 4, 6]
    assert near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_of_shared_null_and_string_ids(spark):
    """Texts are told apart, not ids: a unique text under a shared id stays, of copies without an id one does."""
    rnd = random.Random(8)
    t, u, v, w = (" ".join(prose(rnd, 60)) for _ in range(4))
    rows = [("4", t), ("5", t), ("5", u), ("5", u.upper()), (None, v), (None, v + " more"), (None, w), ("9", w), ("4", "other " + v)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["text"][:20]) for r in got) == sorted([("4", t[:20]), ("5", u.upper()[:20]), ("4", ("other " + v)[:20]), ("9", w[:20])])
    longs = spark.createDataFrame([(int(i) if i else None, x) for i, x in rows], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][:20]) for r in near_dedup(longs.repartition(3)).collect()) == sorted((int(r["doc_id"]), r["text"][:20]) for r in got)


def test_splits_of_crowded_values_change_nothing(spark, monkeypatch):
    import sylva.llm.simhash as simhash

    monkeypatch.setattr(simhash, "SPLIT", 7)
    test_crowded_values_and_chains(spark)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    links = {frozenset(e) for e in edges}
    want = linked(ids, lambda i, j: frozenset((i, j)) in links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(ids)
    assert {(got[i], got[j]) for i in ids for j in ids if got[i] == got[j]} and all((got[i] == got[j]) == (want[i] == want[j]) for i in ids for j in ids)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _copies(kind, words, new):
    n = len(words)
    if kind == "appended":
        return words + new(max(1, n // 5 - 1))
    if kind == "cut":
        return words[: -max(1, n * 15 // 100)]
    if kind == "block":
        at, m = n // 3, max(1, n * 9 // 100)
        return words[:at] + new(m) + words[at + m :]
    return words[: n - 1] + new(1)


@pytest.mark.parametrize("kind,lengths", [("appended", (120, 400)), ("cut", (120, 400)), ("block", (120, 400)), ("last word", (16, 40))])
def test_near_copies_by_kind_of_edit(spark, kind, lengths):
    r = random.Random(kind)
    new = lambda n: ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 9))) for _ in range(n)]
    rows = []
    for i in range(0, 400, 2):
        words = new(r.randint(*lengths))
        rows += [(i, " ".join(words)), (i + 1, " ".join(_copies(kind, words, new)))]
    alike = 0
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = set(shingles(a, 5)), set(shingles(b, 5))
        alike += len(x & y) >= 0.8 * len(x | y)
    assert alike > 150
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept - (len(rows) - alike) <= 1


def test_near_dedup_of_any_columns(spark):
    """Columns of internal names, and maps, which have no order."""
    df = spark.sql("select * from values (1, 'some words that are the same', map('b', 1), 'x', 1L), (1, 'some words that are the same', map('a', 1), 'y', 2L), (2, 'quite another text of words', null, 'z', 3L) as t(doc_id, text, m, _node, _stay)").withColumn("_many", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("_n", F.lit(3))
    got = near_dedup(df).collect()
    assert sorted((r["doc_id"], str(r["m"]), r["_node"], r["_many"], r["_row"]) for r in got) == [(1, "{'a': 1}", "y", 1, 2), (2, "None", "z", 1, 2)]
