"""Dense parts of crowded groups: few pairs are compared, and components stay those of all pairs."""

import random

import numpy as np
import pytest

import sylva.llm.minhash as mh
import sylva.llm.simhash as sh
from sylva.llm.crowds import tree

from .test_minhash import edited, plain, run
from .test_simhash import linked


def _texts(seed, others, dense, share):
    """Texts far from each other around one base, and a group of near copies of one of them."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(5_000)}" for _ in range(200)]
    one = edited(rng, base, share)
    texts = [" ".join(edited(rng, base, share)) for _ in range(others)] + [" ".join(edited(rng, one, 0.006)) for _ in range(dense)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_trees_span_what_is_possible(seed):
    rng = np.random.default_rng(seed)
    n, s = 60, 0.8
    sketches, sizes, comps = rng.integers(0, 1 << 64, (4, 16), np.uint64)[rng.integers(0, 4, n)], rng.integers(50, 60, n), rng.integers(0, 30, n)
    sketches ^= np.where(rng.random((n, 16)) < 0.5, np.uint64(1) << rng.integers(0, 64, (n, 16)).astype(np.uint64), np.uint64(0))
    differ = lambda i, j: max(int(np.bitwise_count(sketches[i] ^ sketches[j]).sum()), abs(int(sizes[i]) - int(sizes[j])))
    may = lambda i, j: differ(i, j) * (1 + s) <= (sizes[i] + sizes[j]) * (1 - s) + 1e-6
    got = tree(sketches, sizes, comps, s)
    assert all(comps[i] != comps[j] and may(i, j) for i, j in got) and 0 < len(got) < n
    ties = {frozenset(p) for p in got}
    assert linked(range(n), lambda i, j: comps[i] == comps[j] or frozenset((i, j)) in ties) == linked(range(n), lambda i, j: comps[i] == comps[j] or may(i, j))


def test_minhash_compares_few_pairs_of_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(mh, "ROUNDS", 1)
    asked, real = [], mh.Sets.similar
    monkeypatch.setattr(mh.Sets, "similar", lambda self, pairs: asked.append(pairs.count()) or real(self, pairs))
    rows = list(enumerate(_texts(11, 600, 120, 0.04)))
    assert run(spark, rows) == plain(rows, 3, 85)
    assert sum(asked) < 2_000, asked  # of 7,140 pairs of the group


def test_near_dedup_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    """1,000 near copies, an eighth of whose pairs are links: what is compared by whole sets is not near their square."""
    asked, real = [], sh.Similar.keep
    monkeypatch.setattr(sh.Similar, "keep", lambda self, pairs, held: asked.append(pairs.count()) or real(self, pairs, held))
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base, texts = [rnd.choice(vocabulary) for _ in range(400)], []
    for _ in range(1000):
        copy = list(base)
        for _ in range(rnd.randrange(2, 16)):
            copy[rnd.randrange(400)] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    sets = [set(map(hash, sh.shingles(t, 5))) for t in texts]

    def near(i, j):
        both = len(sets[i] & sets[j])
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

    links = {(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)}
    want = {i for i, least in linked(range(len(texts)), lambda i, j: (max(i, j), min(i, j)) in links).items() if i == least}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in sh.near_dedup(docs).collect()} == want
    assert sum(asked) < 20_000, asked
