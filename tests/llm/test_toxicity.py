"""Held-out accuracy, and FTRL against a plain loop."""

import math

import numpy as np

from knotwork.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = X.score(docs, X.train(docs, labels))
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    good, bad = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    hits = sum(r.predicted and r.toxic for r in rows)
    precision, recall = hits / max(1, sum(r.predicted for r in rows)), hits / len(good)
    print("auc", auc, "precision", precision, "recall", recall, len(rows))
    assert auc > 0.97 and precision > 0.95 and recall > 0.7  # 3,200 labelled rows


def test_learn_matches_plain():
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 30, 6))) for _ in range(200)]
    at, value = X.learn(rows, epochs=2, seed=3)
    z, n = {}, {}
    w = lambda i: 0.0 if abs(z.get(i, 0)) <= X.L1 else -(z[i] - math.copysign(X.L1, z[i])) / ((X.BETA + math.sqrt(n[i])) / X.ALPHA + X.L2)
    order = np.random.default_rng(3)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            y, f = rows[k]
            p = 1 / (1 + math.exp(-sum(w(i) for i in f)))
            for i, wi in [(i, w(i)) for i in f]:
                s = (math.sqrt(n.get(i, 0) + (p - y) ** 2) - math.sqrt(n.get(i, 0))) / X.ALPHA
                z[i] = z.get(i, 0) + p - y - s * wi
                n[i] = n.get(i, 0) + (p - y) ** 2
    want = {int(i): w(i) for i in z if w(i)}
    assert set(want) == set(at.tolist()) and all(abs(want[int(i)] - v) < 1e-9 for i, v in zip(at, value))


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a bad bad day"), (4, "a day " * 50_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = X.score(docs, X.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = X.train(docs.limit(0), labels.limit(0))
    assert len(none[0]) == 0 and X.score(docs.limit(0), none).count() == 0
    assert {r.score for r in X.score(docs, none).collect()} == {0.5}
