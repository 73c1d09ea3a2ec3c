"""Near duplicates against all pairs."""

import math
import random
import re

import duckdb

from knotwork.llm import near_dedup as N
from knotwork.llm.graphs import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, percent=80, words=4):
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in sets.items():
        near = {}
        for g in s:
            for j in by[g]:
                near[j] = near.get(j, 0) + 1
        for j, k in near.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = N.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_families(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "A b C"), (7, "a b c d")]
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(60 if base == 0 else 8):
            copy = list(words)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows) + rng.randrange(3) * 10_000, " ".join(copy)))
    check(spark, rows)


def test_documents(spark):
    con = duckdb.connect()
    rows = con.execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    check(spark, rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400, 450: 400}


def test_signatures_lose_fewer_pairs_than_bands():
    n = 2 * N.PERMUTATIONS
    equal = N.PERCENT / 100 + (1 - N.PERCENT / 100) / 256  # values of eight bits also meet by chance
    lost = sum(math.comb(n, k) * equal**k * (1 - equal) ** (n - k) for k in range(n + 1) if k / n < N.ALIKE)
    assert lost < (1 - (N.PERCENT / 100) ** N.ROWS) ** (n // N.ROWS)
