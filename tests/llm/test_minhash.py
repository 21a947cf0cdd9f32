"""One-permutation near-dedup against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import sylva.llm.minhash as mh
from sylva.llm.minhash import near_duplicates, op13_minhash_dedup, shingle_set, signature, sketch


def plain_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def plain(rows, k, percent):
    """Each row's set size and the smallest id that links reach, by counting shared shingles of all rows."""
    sets, owner, up = [plain_set(t, k) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in owner[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                up[top(i)] = top(j)
        for s in own:
            owner[s].append(i)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return sorted(map(str, [(x, len(s), least.get(top(i)) if s else x) for i, ((x, _), s) in enumerate(zip(rows, sets, strict=True))]))


def run(spark, rows, k=3, percent=85, **more):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node long")
    out = near_duplicates(df, k=k, percent=percent, **more).collect()
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in out)
    return sorted(map(str, [(r["id"], r["n"], r["component_id"]) for r in out]))


def test_query_against_all_pairs(spark):
    data = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op13_minhash_dedup(spark, data).collect()
    assert sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got])) == plain(rows, 3, 85)
    assert 0 < sum(not r["kept"] for r in got) < len(got) / 2 and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def edited(rng, words, share):
    out = list(words)
    for _ in range(round(len(words) * share)):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_groups_chains_short_and_odd_texts(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3_000)}"
    texts = ["", None, " \n\t ", "one", "ONE", "two words", "Two\twords", "two  words ", "three words here", "É é x", "é é x", "a b a b a b a b", "a b a b"]
    for size in (4, 7, 12, 30, 80, 300, 2_000):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts += [" ".join(edited(rng, base, share)) for share in (0, 0, 0.01, 0.02, 0.03, 0.05)]
            texts += [" ".join(base[: round(size * c)]) for c in (0.84, 0.86, 0.9, 0.95)] + [" ".join([*base, word()])]
    chain = [word() for _ in range(200)]
    for _ in range(60):  # each a link of the next, far from the first
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows, 3, 85)
    assert run(spark, rows, 5, 80) == plain(rows, 5, 80)


def test_crowded_buckets(spark, monkeypatch):
    """Near copies of one text that often are no links of each other, beside a group that is."""
    monkeypatch.setattr(mh, "SPLIT", 32)
    rng = random.Random(2)
    base, other = [[f"b{rng.randrange(500)}" for _ in range(150)] for _ in range(2)]
    texts = [" ".join(edited(rng, base, 0.03)) for _ in range(150)] + [" ".join(edited(rng, other, 0.007)) for _ in range(150)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == plain(rows, 3, 85)


def test_null_shared_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "only here at all"), (7, "a b c d e"), (7, "quite another text then"), (7, "a b c d e"), (3, "quite another text then"), (None, None), (2, ""), (2, "")]
    assert run(spark, rows) == plain(rows, 3, 85)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert run(spark, [(1, None), (2, "")]) == plain([(1, None), (2, "")], 3, 85)


def test_sets_of_equal_first_bits(spark, monkeypatch):
    """Sets whose first 64 bits agree stay apart."""
    real = mh._print
    monkeypatch.setattr(mh, "_print", lambda h: (real(h)[0] % 3, real(h)[1]))
    rows = [(i, f"text number {i // 2} of them all and more {i // 2}") for i in range(40)]
    held = mh._distinct(mh.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3)).select("node").collect()
    assert len({r["node"] for r in held}) in (3, 20)  # 3: workers of an own process have the real one


def test_pieces_and_similarity_of_signatures(monkeypatch):
    text = ("Word été x\x0by\x1cz " * 400).encode()
    whole = shingle_set(text, 3)
    monkeypatch.setattr(mh, "PIECE", 50)
    assert shingle_set(text, 3).tolist() == whole.tolist() and len(whole) == len(plain_set(text.decode(), 3))
    rng = np.random.default_rng(3)
    drawn = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    for size in (3, 20, 400):
        gaps = []
        for _ in range(600):
            x = np.unique(drawn(size))
            y = np.unique(np.append(x[size // 5 :], drawn(size // 5 + 1)))
            gaps.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)) - (signature(x, 192) == signature(y, 192)).mean())
            assert sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(sketch(x), sketch(y), strict=True)) <= len(np.setxor1d(x, y))
        assert abs(np.mean(gaps)) < 0.02


@pytest.mark.parametrize("percent", [80, 85])
def test_met_pairs(percent):
    """Pairs just at the similarity meet in a bucket, with the stated probability; large and small sets."""
    rng, missed = np.random.default_rng(percent), 0
    for _ in range(2_000):
        size = int(rng.choice([6, 20, 150]))
        own = rng.integers(0, 1 << 64, 2 * size, np.uint64)
        part = int((1 - percent / 100) * size)  # of the union, on one side alone
        missed += not set(mh.bands(np.unique(own[:size]))) & set(mh.bands(np.unique(own[part:size])))
    assert missed <= (1 if percent == 85 else 3)
