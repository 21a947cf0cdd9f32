import random

import numpy as np
import pytest

import sylva.llm.decontaminate as decontaminate
from sylva.llm.decontaminate import EDITS, STEP, WINDOW, Windows, aligned, contaminated, folded, op2_decontaminate

random.seed(5)
WORDS = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 9))) for _ in range(500)]
prose = lambda n: " ".join(random.choice(WORDS) for _ in range(n))


def distance(window, text):
    """Least edits of window against any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(s, n):
    for _ in range(n):
        i = random.randrange(len(s))
        s = random.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]])
    return s


def test_same_as_plain_alignment():
    items = [(i, prose(20)) for i in range(6)]
    texts = [prose(15)[:90], ""] + [prose(12) + " " + edited(items[i % 6][1], n) + " " + prose(5) for i, n in enumerate(range(0, 24, 2))] + [items[0][1].upper(), prose(40)]
    w = Windows(items, 96, 0.08)
    data = [folded(t) for t in texts]
    got = {(d, k) for d, k, *_ in w.find(data)}
    want = {(d, k) for d, t in enumerate(data) for k, x in enumerate(w.text) if distance(x, t) <= w.budget[k]}
    assert got == want and want


def test_excerpts_at_any_offset():
    item = prose(80)
    data = folded(item)
    w = Windows([(0, item)], 96, 0.08)
    before, after = folded(prose(12) + " "), folded(" " + prose(12))
    texts = [before + data[at : at + n] + after for n in (96, 103, 120) for at in range(len(data) - n)]
    assert {d for d, *_ in w.find(texts)} == set(range(len(texts)))
    texts = [before + data[at : at + 20] + b"#" + data[at + 21 : at + 60] + b"##" + data[at + 62 : at + 100] + b"#" + data[at + 100 : at + 103] + after for at in range(len(data) - 103)]
    assert {d for d, *_ in w.find(texts)} == set(range(len(texts)))


def test_last_text_and_short_texts():
    item = prose(12)[:40]
    texts = [folded(item)] * 5 + [b""] * 3 + [folded(item)]
    assert {d for d, *_ in Windows([(0, item)], 96, 0.08).find(texts)} == {0, 1, 2, 3, 4, 8}


def test_aligned():
    """On a band that holds all diagonals it is the plain table, on a narrow one that of the band."""
    row = lambda b: np.frombuffer(b, np.uint8)
    place = lambda w, t, first, width: tuple(int(x[0]) for x in aligned(row(w)[None], np.array([first]), row(t), np.array([0]), np.array([len(t)]), width))
    assert place(b"abcdefgh", b"xxabcdefghyy", -3, 10) == (0, 10)
    assert place(b"abcdefgh", b"xxabcXefghyy", -3, 10)[0] == 1
    assert place(b"abcdefgh", b"xxabcdefghyy", 5, 2)[0] > 2
    for _ in range(300):
        text = "".join(random.choices("abc", k=random.randrange(1, 30)))
        window = "".join(random.choices("abc", k=random.randrange(1, 12)))
        assert place(window.encode(), text.encode(), -12, 12 + len(text) + 1)[0] == distance(window, text)


def test_nulls_repeats_and_empty_tables(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from all of them"
    docs = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (2, None, "z"), (None, "a " + item, "w"), (3, "", "v")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    got = contaminated(docs, bench)
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got.collect()) == [(0, 7), (1, 7), (1, 7)]
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("text", ["x" * 200_000, "é" * 50_000])
def test_very_long_text(text):
    item = prose(20)
    assert {d for d, *_ in Windows([(0, item)], 96, 0.08).find([folded(text + " " + item + " " + text)])} == {0}


def brute(docs, items, shortest=24):
    """{(doc, item): (windows, fewest edits)} by the plain table of every window in every text."""
    out = {}
    for d, text in docs:
        data = folded(text or "")
        for key, item in items:
            whole = folded(item or "").strip()
            if len(whole) < shortest:
                continue
            last = max(0, len(whole) - WINDOW)
            for at in sorted({*range(0, last + 1, STEP), last}):
                w = whole[at : at + WINDOW]
                budget = max(0, min(int(len(w) * EDITS), (len(w) + 1) // 8 - 2))
                if len(data) >= len(w) - budget and (e := distance(w, data)) <= budget:
                    n, least = out.get((d, key), (0, 99))
                    out[d, key] = n + 1, min(least, e)
    return out


def test_query_against_plain_tables(spark, tmp_path):
    """op2's query on a small fixture: edited excerpts, short items, repeats, shared passages, periodic texts."""
    rnd = random.Random(11)
    items = [(i, prose(rnd.randrange(14, 24))) for i in range(6)] + [(6, "tiny one"), (7, "twenty four letters here"), (8, "ab cd ef gh " * 12), (9, None), (10, "")]
    items += [(11, items[0][1][:60] + prose(9))]
    docs = [(i, prose(4) + " " + edited(items[i % 6][1], i // 2)[rnd.randrange(12) :] + " " + prose(3)) for i in range(14)]
    docs += [(20, None), (21, ""), (22, prose(30)), (23, "so TWENTY\tfour letters here it is"), (24, "x ab cd ef gh " + "ab cd ef gh " * 30), (25, prose(2) + items[1][1][30:130]), (None, items[2][1])]
    spark.createDataFrame([(i, t, "o") for i, t in docs], "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["edits"]) for r in op2_decontaminate(spark, str(tmp_path)).collect()}
    want = brute(docs, items)
    assert got == want and {(23, 7), (24, 8), (None, 2)} <= set(want) and len({e for _, e in want.values()}) > 3


def test_short_items_where_asked(spark):
    docs, items = [(1, "it is a tiny one here"), (2, "it is a tiny two")], [(6, "tiny one"), (7, "is a tiny t")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = contaminated(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), shortest=8).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["edits"]) for r in got} == brute(docs, items, 8) == {(1, 6): (1, 0), (2, 7): (1, 0)}


def test_runs_of_counts_change_nothing(monkeypatch):
    item = prose(30)
    texts = [folded(prose(20) + " " + edited(item, 3) + " " + item) for _ in range(3)] + [folded("ab cd ef " * 60)]
    windows = Windows([(0, item), (1, "ab cd ef " * 20)], 96, 0.08)
    whole = sorted(windows.find(texts))
    for size in (1, 50, 700):
        monkeypatch.setattr(decontaminate, "RUN", size)
        assert sorted(windows.find(texts)) == whole


def test_memory_of_repetitive_texts():
    """A phrase repeated over 140 kB of text and in an item takes some megabytes and seconds."""
    import time
    import tracemalloc

    phrase = "the quick brown fox jumps over it; "
    windows = Windows([(0, phrase * 60)], 96, 0.08)
    tracemalloc.start()
    began = time.time()
    assert {w for _, w, *_ in windows.find([folded(phrase * 4_000)])} == set(range(len(windows.text)))
    assert tracemalloc.get_traced_memory()[1] < 300e6 and time.time() - began < 90
    tracemalloc.stop()


def test_items_of_any_type_of_id(spark):
    text = "the quick brown fox jumps over the lazy dog and then runs far away from all of them, again and again, until night"
    docs = spark.createDataFrame([(1, "before it " + text + " after it")], "doc_id long, text string")
    for kind in ("tinyint", "smallint", "int", "bigint", "double", "decimal(9,2)", "string", "date"):
        bench = spark.sql(f"select cast({'date' if kind == 'date' else ''}{'\'2020-01-02\'' if kind == 'date' else '7'} as {kind}) as item_id, '{text}' as text union all select null, 'quite another item that stands nowhere in these documents, however long one looks for it in there'")
        got = contaminated(docs, bench).collect()
        assert len(got) == 1 and got[0]["item_id"] == bench.where("item_id is not null").first()["item_id"]
