import numpy as np

from sylva.llm.toxicity import GRADED, RIDGE, SURE, TIMES, Severity, features, fit, op1_toxicity, score, train

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Fitted on four fifths of the labels, judged on the rest."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = score(docs, train(docs, labels.where("doc_id % 5 <> 0"))).select("doc_id", "toxic")
    known = labels.where("doc_id % 5 = 0").selectExpr("doc_id", "toxic as label")
    n = {(r["label"], r["toxic"]): r["count"] for r in judged.join(known, "doc_id").groupBy("label", "toxic").count().collect()}
    found, missed, wrong, clean = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0), n.get((0, False), 0)
    print("held out: found", found, "missed", missed, "wrongly flagged", wrong, "clean", clean)
    assert found >= 0.8 * (found + missed)
    assert wrong <= 0.01 * (wrong + clean)


def test_fit_orders_grades():
    rows = [np.array([0])] * 20 + [np.array([0, 1])] * 20 + [np.array([2])] * 40
    grades = np.array([1] * 20 + [2] * 20 + [0] * 40)
    w, (t1, t2) = fit(rows, grades, np.ones(80), 3)
    assert t1 < t2
    eta = np.array([w[r].sum() for r in rows])
    assert ((eta > t1) == (grades >= 1)).all() and ((eta > t2) == (grades >= 2)).all()


def test_gradient_is_that_of_the_likelihood():
    """No move from the fitted point makes the likelihood better."""
    rows, grades = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], int), np.array([0]), np.array([1]), np.array([], int)], np.array([1, 2, 0, 0, 0, 1, 2])
    w, (t1, t2) = fit(rows, grades, np.ones(7), 2, steps=4_000, ridge=1e-2)

    def loss(w, t1, t2):
        eta = np.array([w[r].sum() for r in rows])
        s1, s2 = 1 / (1 + np.exp(t1 - eta)), 1 / (1 + np.exp(t2 - eta))
        p = np.where(grades == 0, 1 - s1, np.where(grades == 1, s1 - s2, s2))
        return -np.log(p).mean() + 1e-2 * (w**2).sum() / 2 / 2**0.5

    at = loss(w, t1, t2)
    for d in (-0.05, 0.05):
        assert loss(w + [d, 0], t1, t2) > at - 1e-4 and loss(w + [0, d], t1, t2) > at - 1e-4
        assert loss(w, t1 + d, t2) > at - 1e-4 and loss(w, t1, t2 + d) > at - 1e-4


def test_nulls_repeats_and_empty_tables(spark):
    bad, good = "you vile wretch vile filth", "a calm day by the sea"
    rows = [(i, bad if i % 4 == 0 else good, 1.5) for i in range(80)] + [(100, None, 1.0), (101, "", 1.0), (102, "123 !!", 1.0), (None, bad, 1.0), (0, bad, 2.0), (103, (good + " ") * 20_000 + bad, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == len(rows)
    flagged = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got if r["toxic"])
    assert flagged == sorted([-1, 0, 0, *range(4, 80, 4), 103])
    assert all(0 <= r["expected_severity"] <= 2 for r in got)
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        assert score(docs, train(docs, some)).where("toxic").count() == 0
    assert score(docs.limit(0), Severity({}, (50.0, 60.0))).count() == 0


def test_query_against_plain_version(spark):
    """op1 on the small tables against features, grades and design counted by hand, fitted by plain gradient steps."""
    path = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    grade = {r["doc_id"]: (0 if not r["toxic"] else 1 if r["quality"] else 2) for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = {i: features(docs[i]) for i in grade if i in docs}
    n = [sum(grade[i] == 0 for i in rows), sum(grade[i] > 0 for i in rows)]
    names = []
    for f in sorted(set().union(*rows.values())):
        n0, n1 = (sum(f in rows[i] for i in rows if (grade[i] > 0) == k) for k in (False, True))
        p0, p1, h0, h1 = n0 / n[0], n1 / n[1], (n0 + 0.5) / (n[0] + 1), (n1 + 0.5) / (n[1] + 1)
        toward = n1 >= 3 and p1 >= TIMES * (n0 + 0.5) / n[0] and p1 - h0 >= SURE * (p1 * (1 - p1) / n[1] + h0 / n[0]) ** 0.5
        against = n0 >= 3 and p0 >= TIMES * (n1 + 0.5) / n[1] and p0 - h1 >= SURE * (p0 * (1 - p0) / n[0] + h1 * (1 - h1) / n[1]) ** 0.5
        if toward or against:
            names.append(f)
    index = {f: k for k, f in enumerate(names)}
    ids = sorted(rows, key=lambda i: (grade[i], int(grade[i] > 0), sorted(index[f] for f in rows[i] if f in index)))
    w, (t1, t2) = fit([np.array(sorted(index[f] for f in rows[i] if f in index), int) for i in ids], np.array([grade[i] for i in ids]), np.ones(len(ids)), len(names), ridge=RIDGE, split=GRADED)
    got = {r["doc_id"]: (r["expected_severity"], r["grade"], r["toxic"]) for r in op1_toxicity(spark, path).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        eta = sum(w[index[f]] for f in features(text) if f in index)
        p1, p2 = 1 / (1 + np.exp(t1 - eta)), 1 / (1 + np.exp(t2 - eta))
        assert abs(got[i][0] - (p1 + p2)) < 1e-6 and got[i][1] == int(p1 >= 0.5) + int(p2 >= 0.5) and got[i][2] == (p1 >= 0.5)


def test_weights_of_either_sign_and_graded_severity(spark):
    """Words of harmless rows speak against toxicity, and rows of bad quality are more severe."""
    rows = [(i, "calm sea" if i % 3 == 0 else "vile wretch" if i % 3 == 1 else "vile wretch filth scum") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 < 2), int(i % 3 > 0)) for i in range(120)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    assert model.weights["calm"] < 0 < model.weights["vile"] and model.weights["filth"] > 0
    got = {r["doc_id"]: (r["expected_severity"], r["grade"]) for r in score(docs, model).collect()}
    assert [got[i][1] for i in range(3)] == [0, 1, 2] and got[0][0] < got[1][0] < got[2][0]
