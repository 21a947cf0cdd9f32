import random

import corpus_pipeline as p
from sylva.llm.toxicity import features

DATA = "/root/testdata/sf0.01"


def shingle_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages_on_planted_documents(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    passage = [prose(60) for _ in range(5)]
    rows = [(i, prose(rnd.randrange(60, 200)), "en", ["a", "b", None][i % 3], 1) for i in range(120)]
    toxic = [(200 + i, prose(60) + " zzvile zzfilth zzvile", "en", "a", 1) for i in range(20)]
    copies = [(300 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "b", 1) for i in range(20)]
    leaks = [(400 + i, prose(30) + " " + t + " " + prose(30), "en", "a", 1) for i, t in enumerate(passage)]
    spark.createDataFrame(rows + toxic + copies + leaks, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passage)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in p.STAGES:
        docs = p.cut(stage(spark, docs, str(tmp_path)))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert set(p.COLUMNS) <= set(docs.columns)
    clean = {r[0] for r in rows}
    assert kept[0] == clean | {r[0] for r in copies + leaks}
    assert kept[1] == clean | {r[0] for r in leaks}
    assert kept[2] == kept[3] == clean
    per = docs.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] for r in per)
    assert {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()} == clean


def test_no_pair_of_near_copies_stays(spark):
    """On a generated table, the kept documents hold few pairs that all pairs call near copies, and no group is lost."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    all_of = {r["doc_id"]: shingle_sets(r["text"]) for r in docs.collect()}
    kept = {r["doc_id"] for r in p.simhash(spark, docs, DATA).collect()}
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    ids = sorted(all_of)
    best = {i: i for i in ids}

    def top(i):
        while best[i] != i:
            i = best[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = len(all_of[i]), len(all_of[j])
            if 5 * min(a, b) >= 4 * max(a, b) and near(all_of[i], all_of[j]):
                x, y = top(i), top(j)
                best[max(x, y)] = min(x, y)
    want = {i for i in ids if top(i) == i}
    assert want <= kept and len(kept - want) <= 0.01 * len(ids)


def test_stages_on_null_repeated_and_odd_rows(spark, tmp_path):
    """Each stage by its definition on rows without ids, with shared ids, repeated, empty, and on no rows."""
    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 9))) for _ in range(n))
    bad, leak = prose(30) + " zzvile zzfilth zzvile", prose(30)
    train = [(i, prose(30) + (" zzvile zzfilth zzvile" if i % 2 else ""), "en", "a", 1) for i in range(1000, 1060)]
    odd = [(None, bad, "en", "a", 1), (7, bad, "en", "a", 1), (7, prose(20), "en", "b", 1), (None, prose(3), "en", "a", 3), (None, prose(50), "en", "b", 50)]
    odd += [(8, leak, "en", "a", 1), (8, prose(25), "en", "a", 1), (None, "x " + leak, "en", None, 1), (9, None, None, None, None), (None, "", "de", "b", 0)]
    odd += [(10, prose(12), "en", "a", 1)] * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, 1, i % 2) for i in range(1000, 1060)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, where = spark.createDataFrame(train + odd, schema), str(tmp_path)
    texts = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    want = lambda rows: sorted((str(r[0]), str(r[1])) for r in rows)
    assert texts(p.toxicity(spark, docs, where)) == want([r for r in train + odd if "zzvile" not in (r[1] or "")])
    some = spark.createDataFrame(odd, schema)
    assert texts(p.decontamination(spark, some, where)) == want([r for r in odd if leak not in (r[1] or "")])
    got = texts(p.simhash(spark, some, where))
    keep = {r[1]: r for r in reversed(odd) if r[1]}
    keep[bad] = odd[1]
    del keep["x " + leak]
    assert got == want([*keep.values(), odd[8]])
    mixed = p.mixing(spark, some, where).collect()
    size = lambda t: len((t or "").split())
    assert want([(r["doc_id"], r["text"]) for r in mixed]) == want(odd)
    assert all(r["size"] == size(r["text"]) and r["taken"] == r["copies"] * r["size"] for r in mixed)
    for source in ("a", "b", None):
        own = [r for r in mixed if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(size(t[1]) for t in odd if t[3] == source)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), where).count() == 0


def test_features():
    assert features(None) == features("") == set()
    assert {"word", "word+", "^word"} <= features("Word WORD words")
