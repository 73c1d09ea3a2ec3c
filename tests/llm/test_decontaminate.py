"""Leaks planted and leaks in the documents, against word windows compared one by one."""

import random
import re

import duckdb
import numpy as np

from knotwork.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_documents(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    grams = {}
    for i, text in items:
        words = plain(text)
        for k in range(len(words) - 4):
            grams.setdefault(tuple(words[k : k + 5]), set()).add(i)
    share = {}
    for d, text in docs:
        words = plain(text)
        seen = {}
        for g in {tuple(words[k : k + 5]) for k in range(len(words) - 4)}:
            for i in grams.get(g, ()):
                seen[i] = seen.get(i, 0) + 1
        for i, n in seen.items():
            share[d, i] = n / sum(i in s for s in grams.values())
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {p for p, s in share.items() if s >= 0.6} <= got
    assert all(share.get(p, 0) > 0.2 for p in got)


def test_paraphrases(spark, monkeypatch):
    monkeypatch.setattr(D, "WINDOWS", 20)
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "a"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, say(rng.randint(20, 70))) for i in range(30)]
    rows, want = [], set()
    for d in range(300):
        words = say(rng.randint(0, 300))
        if d % 10 == 3:
            i, own = items[d // 10]
            own = [f"v{rng.randrange(4000)}" if rng.random() < 0.12 else w for w in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
            want.add((d, i))
        rows.append((d, " ".join(words)))
    rows += [(1000, None), (1001, ""), (None, " ".join(items[0][1])), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == want
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_case_and_marks(spark):
    item = "Élan vieux çà et là, Ähre über Öl und Straßen; ждёт ночь над тихой рекой."
    docs = spark.createDataFrame([(1, "ANFANG!! " + item.upper().replace(" ", "!! ")), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item.replace("ß", "ss"))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()] == [(1, 5)]


def test_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 20)
        w = rng.random(6)[a]
        best = np.zeros((13, 21))
        for i in range(12):
            for j in range(20):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + w[i] if a[i] == b[j] else 0)
        assert abs(D.weighted_lcs(a, w, b) - best[-1, -1] / w.sum()) < 1e-9


def test_space_is_exact_where_rank_allows(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"t{k}" for k in rng.integers(0, 40, 50))) for i in range(60)], "_id long, _text string")
    terms = np.unique(D.item_words(" ".join(f"t{k}" for k in range(40))))
    passages = D._passages(docs, terms).cache()
    own, weights = np.arange(len(terms)), rng.random(len(terms)) + 0.5
    dense = []
    for r in docs.collect():
        place = np.searchsorted(terms, D.item_words(r._text))
        for lo in range(0, len(place), D.STRIDE):
            dense.append(np.bincount(place[lo : lo + 2 * D.STRIDE], minlength=len(terms)) * weights)
    dense = np.array(dense)
    basis = rng.standard_normal((len(terms), 7)).astype(np.float32)
    assert np.allclose(D._sketch(passages, own, weights, basis, False), dense.T @ (dense @ basis), rtol=1e-3, atol=0.05)
    assert np.allclose(D._sketch(passages, own, weights, basis, True), (dense @ basis).T @ (dense @ basis), rtol=1e-3, atol=0.05)
    space = D.latent_space(passages, own, weights, np.zeros((1, len(terms)), np.float32), np.ones(len(terms)))
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)


def test_recall_of_reworded_items(spark):
    """Every planted item that the confirm rule accepts in any passage is found, reworded as it may be."""
    rng = random.Random(6)
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 300 AND 4000 ORDER BY doc_id LIMIT 400").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()
    corpus = [w for _, t in docs[:50] for w in t.split()]
    rows = list(docs)
    for n in range(4):
        for k, (_, text) in enumerate(items):
            answer = D.answer_of(text)
            head, tail = text[: text.rindex(answer)], text[text.rindex(answer) :]
            new = (lambda: f"zq{rng.randrange(10**6)}") if n % 2 else (lambda: rng.choice(corpus))
            own = [new() if rng.random() < (0.4, 0.4, 0.5, 0.5)[n] else w for w in head.split()]
            words = docs[(n * len(items) + k) % len(docs)][1].split()
            at = rng.randint(0, len(words))
            rows.append((100_000 + len(rows), " ".join([*words[:at], *own, tail, *words[at:]])))
    words = {d: D.item_words(t) for d, t in rows}
    often, total = {}, 0
    for own in words.values():
        for lo in range(0, len(own), D.STRIDE):
            total += 1
            for w in set(own[lo : lo + D.STRIDE].tolist()):
                often[w] = often.get(w, 0) + 1
    weigh = lambda x: np.array([max(0.0, np.log((total + 1) / (often.get(w, 0) + 0.5))) for w in x.tolist()])
    want = set()
    for n, (d, _) in enumerate(rows[len(docs) :]):
        i, text = items[n % len(items)]
        item, answer = D.item_words(text), D.item_words(D.answer_of(text))
        for lo in range(0, len(words[d]), D.STRIDE):
            part = words[d][max(0, lo - len(item)) : lo + 2 * D.STRIDE + len(item)]
            lcs = D.weighted_lcs(item, weigh(item), part)
            if lcs >= D.LCS or lcs >= D.LCS_WITH_ANSWER and D.weighted_lcs(answer, weigh(answer), part) >= D.ANSWER:
                want.add((d, i))
    assert len(want) > len(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).collect()}
    assert not want - got, (len(want - got), len(want))


def test_leak_without_its_rarest_words(spark):
    rng = random.Random(8)
    docs = [[f"f{rng.randrange(500)}" for _ in range(160)] for _ in range(300)]
    items = []
    for i in range(10):
        rare = [k % 2 == 0 and k < 36 for k in range(40)]
        items.append([f"{'u' if r else 'm'}{i}x{k}" for k, r in enumerate(rare)])
        for w in items[-1]:
            for d in rng.sample(range(20, 300), 3 if w[0] == "u" else 6):
                docs[d][rng.randrange(160)] = w
        own = [f"z{rng.randrange(10**6)}" if w[0] == "u" else w for w in items[-1]]
        docs[i][50:50] = own
    rows = [(d, " ".join(w)) for d, w in enumerate(docs)]
    bench = [(i, " ".join(w[:36]) + ". " + " ".join(w[36:])) for i, w in enumerate(items)]
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(10)}
    assert all(D.LCS_WITH_ANSWER <= r.lcs < D.LCS and r.answer == 1 and 0 <= r.cosine <= 1 for r in got)
