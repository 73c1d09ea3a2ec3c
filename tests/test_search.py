"""Text, vector and hybrid search against brute force and hand-made cases."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from helpers import graph, people, rows
from knotwork.model import EMBEDDING_CACHE
from knotwork.operators import search as H
from knotwork.operators import text as X
from knotwork.operators import vector as V
from knotwork.session import collapse


def plain_bm25(docs, query, k):
    words = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    scores = {}
    for term in set(re.findall(r"\w+", query.lower())):
        df = sum(term in w for w in words.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for i, w in words.items():
            f = w.count(term)
            if f:
                scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
    ranked = sorted((-round(s, 9), i) for i, s in scores.items())[:k]
    return [(i, -s) for s, i in ranked]


@pytest.mark.parametrize("seed", range(3))
def test_bm25_with_and_without_hot_terms(spark, seed):
    """Frequent terms, shared term sets and ties: the bounded route gives the full answer."""
    rng = random.Random(seed)
    common, rare = ["the", "of", "user", "note"], [f"w{i}" for i in range(40)]
    docs = []
    for i in range(150):
        size = rng.randrange(1, 12)
        docs.append((f"d{i:03d}", " ".join(rng.choices(common, k=size) + rng.choices(rare, k=rng.randrange(4)))))
    docs += [(f"copy{i:02d}", "the user") for i in range(30)]
    queries = [(f"q{i}", " ".join(rng.sample(common, rng.randrange(5)) + rng.sample(rare, rng.randrange(3)))) for i in range(20)]
    queries += [("hot", "the of user note"), ("one", "user"), ("none", "zzz"), ("empty", "  ")]
    queries += [(f"again{i}", "the user w1") for i in range(8)] + [("same", queries[0][1])]
    df = spark.createDataFrame(docs, "id string, text string")
    index = X.build_text_index(df)
    asked = spark.createDataFrame(queries, "query_id string, text string")
    for hot_df in (10_000, 20):
        got = {}
        for r in X.bm25_topk(asked, index, 7, hot_df).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.id, pytest.approx(r.score, abs=1e-6)))
        for name, text in queries:
            assert plain_bm25(docs, text, 7) == got.get(name, []), (name, text, hot_df)


def test_scoped_bm25(spark):
    docs = spark.createDataFrame(
        [("a1", "alpha beta", "A"), ("a2", "alpha", "A"), ("b1", "alpha alpha", "B")], "id string, text string, owner string"
    )
    asked = spark.createDataFrame([("q", "alpha", "A"), ("r", "alpha", "B"), ("s", "alpha", "C")], "query_id string, text string, owner string")
    for hot_df in (10_000, 0):
        out = X.bm25_topk(asked, X.build_text_index(docs), 5, hot_df)
        assert rows(out, "query_id", "id", "rank") == [("q", "a1", 2), ("q", "a2", 1), ("r", "b1", 1)]


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red apple"), ("b", "green apple pie"), ("c", "car")], "id string, text string")
    asked = spark.createDataFrame([("q", "green apple")], "query_id string, text string")
    index = X.build_text_index(docs)
    index.save(str(tmp_path / "index"))
    back = X.load_text_index(spark, str(tmp_path / "index"))
    want = rows(X.bm25_topk(asked, index, 5), "id", "score", "rank")
    assert rows(X.bm25_topk(asked, back, 5), "id", "score", "rank") == want and len(want) == 2


HOSTILE = ["AND OR NOT", '"quoted', "a* NEAR(b)", "nul\x00byte", "x" * 20_000, "", "   ", "';--", "col:val"]


def test_hostile_queries(spark):
    index = X.build_text_index(spark.createDataFrame([("d", "and or not near")], "id string, text string"))
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(HOSTILE)], "query_id string, text string")
    assert rows(X.bm25_topk(asked, index, 3), "query_id", "id") == [("0", "d"), ("2", "d")]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_topk_is_exact(spark, metric):
    """Clusters, a third of copies and tiny blocks: pruning loses nothing."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 4
    points = np.vstack([centres[i % 6] + rng.normal(size=8) * 0.2 for i in range(200)] + [centres[0]] * 100)
    points = np.float32(points)
    asked = np.float32(np.vstack([points[:20], rng.normal(size=(10, 8))]))
    vectors = spark.createDataFrame([(f"v{i:03d}", p.tolist()) for i, p in enumerate(points)], "id string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i:02d}", p.tolist()) for i, p in enumerate(asked)], "query_id string, embedding array<float>")
    block, V.BLOCK_ROWS = V.BLOCK_ROWS, 16
    try:
        got = {}
        for r in V.vector_topk(queries, vectors, 9, metric).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.id, pytest.approx(r.score, abs=2e-6)))
    finally:
        V.BLOCK_ROWS = block
    p, a = points.astype(float), asked.astype(float)
    if metric == "cosine":
        near = (a / np.linalg.norm(a, axis=1)[:, None]) @ (p / np.linalg.norm(p, axis=1)[:, None]).T
    else:
        near = -np.linalg.norm(a[:, None] - p[None], axis=2)
    near = np.round(near, 9)
    for i in range(len(asked)):
        order = sorted(range(len(p)), key=lambda j: (-near[i, j], j))[:9]
        assert [near[i, j] for j in order] == [s for _, s in got[f"q{i:02d}"]]
        if i < 20 and metric == "cosine":
            assert len({x for x, _ in got[f"q{i:02d}"]}) == 9


def test_vector_ties_go_to_lowest_id(spark):
    vectors = spark.createDataFrame([(f"v{i:03d}", [1.0, 0.0]) for i in range(50)] + [("w", [1.0, 0.0, 0.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    assert rows(V.vector_topk(queries, vectors, 3), "id", "rank") == [("v000", 1), ("v001", 2), ("v002", 3)]


def ranks(spark, items):
    return spark.createDataFrame([("q", i, r) for i, r in items], "query_id string, id string, rank int")


def test_fusion(spark):
    out = H.rrf_fuse(ranks(spark, [("a", 1), ("b", 2)]), ranks(spark, [("c", 1), ("a", 2)]), 0.5)
    got = {r.id: r.score for r in out.collect()}
    assert got == {
        "a": pytest.approx(0.5 / 61 + 0.5 / 62), "b": pytest.approx(0.5 / 62), "c": pytest.approx(0.5 / 61)
    }
    with pytest.raises(ValueError):
        H.rrf_fuse(ranks(spark, [("a", 1)]), ranks(spark, [("a", 1)]), 1.5)


def test_boost_is_capped(spark):
    g = graph(spark, facts=[(f"o{i}", "many", "x") for i in range(10)] + [("best", "one", "x")])
    scores = spark.createDataFrame([("q", f"o{i}", 0.004) for i in range(10)] + [("q", "best", 1 / 61)], "query_id string, id string, score double")
    none = spark.createDataFrame([], "query_id string, id string, score double")
    got = {r.id: r.score for r in H.boost_from_observations(none, scores, g.observations, 0.5).collect()}
    assert got["many"] <= got["one"] == pytest.approx(0.5 / 61)


def test_type_filter_before_truncation(spark):
    names = [(f"n{i:03d}", f"alpha alpha note {i}", "note") for i in range(200)]
    g = graph(spark, names + [(f"p{i}", f"alpha person {i} with a long tail of words", "person") for i in range(3)])
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, text string")
    out = H.search_entities(g, asked, 3, ["person"], hot_df=50)
    assert rows(out, "id") == [("p0",), ("p1",), ("p2",)]


def test_edges_attached_are_capped(spark):
    g = people(spark, ["hub"] + [f"leaf{i:02d}" for i in range(25)], [("hub", f"leaf{i:02d}", "knows", i / 30) for i in range(25)])
    asked = spark.createDataFrame([("q", "hub")], "query_id string, text string")
    (r,) = H.search_entities(g, asked, 1).collect()
    assert len(r.relationships) == 20 and r.relationships_truncated and r.relationship_count == 25
    assert r.relationships[0].connected_entity == "leaf24"


def test_observations_attached(spark):
    g = graph(spark, [("e1", "Ada", "person")], facts=[(f"o{i}", "e1", f"fact {i}", i) for i in range(5)])
    asked = spark.createDataFrame([("q", "ada")], "query_id string, text string")
    (r,) = H.search_entities(g, asked, include_observations=True, observations_cap=3).collect()
    assert [o.id for o in r.observations] == ["o4", "o3", "o2"]
    assert r.observation_count == 5 and r.observations_truncated


def test_search_found_by_observation_only(spark):
    g = graph(spark, [("e1", "Ada", "person"), ("e2", "Bob", "person")], facts=[("o1", "e2", "plays the zither")])
    asked = spark.createDataFrame([("q", "zither")], "query_id string, text string")
    assert rows(H.search_entities(g, asked), "id") == [("e2",)]
    assert H.search_entities(g, asked, boost=False).count() == 0
    assert H.search_entities(g, asked, min_score=0.1).count() == 0


def test_suggestions_mark_linked(spark):
    g = graph(
        spark,
        [("e1", "red apple", "fruit"), ("e2", "green apple", "fruit"), ("e3", "apple pie", "dish")],
        [("r1", "e2", "e1", "like")],
    )
    out = H.suggest_connections(g, spark.createDataFrame([("e1",)], "id string"), 5)
    got = {r.suggested_id: (r.already_connected, r.unconnected_count, r.already_connected_count) for r in out.collect()}
    assert got == {"e2": (True, 1, 1), "e3": (False, 1, 1)}


def plain_mentions(names, own, text):
    names = sorted((n for n in names if n.lower() != (own or "").lower()), key=len, reverse=True)
    pattern = re.compile(r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])" % "|".join(map(re.escape, names)), re.I)
    return [(m.start(), m.end(), m.group().lower()) for m in pattern.finditer(text)]


@pytest.mark.parametrize("most", [X.NAMES_BYTES, 0])
def test_mentions_against_regex(spark, monkeypatch, most):
    monkeypatch.setattr(X, "NAMES_BYTES", most)
    names = ["Go", "C++", "C", "New York", "New York City", "York City Hall", "a.b", "Ünal", "O'Brien", "node_1", "+"]
    rng = random.Random(3)
    pieces = names + [n.upper() for n in names] + ["going", "x", "C+++", ",", "(", "new", "york", "_Go", "é", "city hall"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", ", ", "\n"]) for _ in range(25)) for _ in range(40)]
    g = graph(
        spark,
        [(f"e{i}", n, "t") for i, n in enumerate(names)],
        facts=[(f"o{i:02d}", "e0" if i % 2 else "e4", t) for i, t in enumerate(texts)],
    )
    got = {}
    for r in X.link_mentions(g).collect():
        got.setdefault(r.observation_id, []).append((r.start, r.end, r.entity_name.lower()))
    for i, text in enumerate(texts):
        want = plain_mentions(names, "Go" if i % 2 else "New York City", text)
        assert sorted(got.get(f"o{i:02d}", [])) == want, text


@pytest.mark.parametrize("most", [X.NAMES_BYTES, 0])
def test_places_of_mentions_in_odd_texts(spark, monkeypatch, most):
    """Letters that grow in lower case, names with blanks around, null texts, no names and no texts."""
    monkeypatch.setattr(X, "NAMES_BYTES", most)
    g = graph(
        spark, [("e1", "Ankara", "t"), ("e2", "İzmir Bay", "t"), ("e3", " blank ", "t"), ("e4", "", "t")],
        facts=[("o1", "x", "İİ ankara"), ("o2", "x", "in İzmir bay."), ("o3", "x", "a blank b"), ("o4", "x", None), ("o5", "x", "")],
    )
    assert rows(X.link_mentions(g), "observation_id", "start", "end", "entity_id") == [("o1", 3, 9, "e1"), ("o2", 3, 12, "e2")]
    assert X.link_mentions(graph(spark, facts=[("o1", "x", "text")])).count() == 0
    assert X.link_mentions(graph(spark, [("e1", "Ankara", "t")])).count() == 0


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)
    base = V.hashed_words(8)

    def encode(texts):
        calls.add(len(texts))
        return base(texts)

    from knotwork.model import EMBEDDING_CACHE

    empty = spark.createDataFrame([], EMBEDDING_CACHE)
    texts = spark.createDataFrame([(str(i), f"text {i % 3}") for i in range(9)], "id string, text string")
    vectors, cache = V.embed_texts(texts, encode, empty, "m", "2024-01-01")
    assert vectors.count() == 9 and cache.count() == 2 and calls.value == 3
    more = texts.union(spark.createDataFrame([("x", "fresh")], "id string, text string"))
    vectors, later = V.embed_texts(more, encode, cache, "m", "2025-01-01")
    assert vectors.count() == 10 and later.count() == 4 and calls.value == 4
    assert rows(later.selectExpr("year(last_used) y").distinct(), "y") == [(2025,)]
    other, both = V.embed_texts(texts, encode, later, "n", "2026-01-01")
    assert both.count() == 7
    kept = V.prune_cache(both, 3)
    assert rows(kept, "model_name") == [("n",)] * 3

    def broken(texts):
        return base(texts)[:-1]

    with pytest.raises(Exception, match="encoder gave shape"):
        V.embed_texts(texts, broken, empty, "m", "2024-01-01")


def test_vectors_of_several_dimensions(spark):
    vectors = [("a3", [1.0, 0.0, 0.0], "p"), ("b3", [0.9, 0.1, 0.0], "q"), *[(f"c{i}", [1.0, float(i)], "p") for i in range(6)]]
    v = spark.createDataFrame(vectors, "id string, embedding array<float>, owner string")
    asked = [("three", [1.0, 0.0, 0.0], "p"), ("two", [1.0, 0.0], "p"), ("five", [1.0] * 5, "p"), ("none", [], "p")]
    q = spark.createDataFrame(asked, "query_id string, embedding array<float>, owner string")
    got = V.vector_topk(q.drop("owner"), v.drop("owner"), 2)
    assert rows(got, "query_id", "id", "rank") == [("three", "a3", 1), ("three", "b3", 2), ("two", "c0", 1), ("two", "c1", 2)]
    got = V.vector_topk(q, v, 2)
    assert rows(got, "query_id", "id", "rank") == [("three", "a3", 1), ("two", "c0", 1), ("two", "c1", 2)]


def test_copies_follow_the_visits_of_a_cell(spark, monkeypatch):
    """A cell that few queries visit is copied for those only, however many queries there are."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 4)
    v = spark.createDataFrame([(f"v{i}", [float(i), 1.0], "a" if i < 8 else "b") for i in range(12)], "id string, embedding array<float>, cell string")
    pairs = spark.createDataFrame([(f"q{i:02}", [1.0, float(i)], "a" if i else "b") for i in range(20)], "query_id string, embedding array<float>, cell string")
    cells = v.groupBy("cell").count().withColumnRenamed("count", "n")
    got = V._scan(pairs, v, cells, 2, "cosine")
    assert got.groupBy("query_id").count().count() == 20
    best = {r.query_id: r.id for r in V._best(got, 1).collect()}
    assert best["q00"] == "v11" and best["q01"] in {f"v{i}" for i in range(8)}


def test_a_query_is_one_row_however_many_cells_it_visits():
    """Where nothing is ruled out a query names all cells as bits of their groups; slices stay small."""
    rng = np.random.default_rng(4)
    pivots, size = rng.normal(size=(600, 8)), np.full(600, 40)
    grouping = V.Grouping.of("", V._near_groups(pivots, size))
    assert max(size[m].sum() for m in grouping.members) <= V.BLOCK_ROWS and sum(map(len, grouping.members)) == 600
    batch = V._frame(query_id=[f"q{i}" for i in range(4000)], embedding=list(rng.normal(size=(4000, 8))))
    batch["bound"] = np.inf
    run = V._choose(pivots, np.ones(600), size, grouping, 5, "cosine", False)
    frames = list(run([batch]))
    assert sum(map(len, frames)) == 4000 and max(map(len, frames)) * 600 <= V.STRIP_SCORES
    cells = [np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8)).sum() for f in frames for bits in f["opened"]]
    assert set(cells) == {599}  # all but the nearest, which was searched first


def test_runs_that_are_no_name_stay_in_their_task(spark, monkeypatch):
    """Of a long text only runs whose mark is set leave the task, in short frames; no name is missed."""
    monkeypatch.setattr(X, "SPAN_ROWS", 10)
    names = spark.createDataFrame([("blue moon",), ("été",), ("n_1",)], "span string")
    marked = spark.sparkContext.broadcast(X._marks(names))
    text = " ".join(f"w{i}" for i in range(3000)) + " Blue Moon, ÉTÉ; n_1 blue moons" + " blue moon" * 25
    frames = list(X._spans(X._runs([1, 2, 3], marked))([pd.DataFrame({"id": ["t"], "text": [text]})]))
    found = pd.concat(frames)
    assert max(map(len, frames)) <= 10 and len(found) < 300
    assert (found["span"] == "blue moon").sum() == 26 and {"été", "n_1"} <= set(found["span"])


def test_words_fold_marks_and_split_at_underscores(spark):
    docs = spark.createDataFrame([("1", "Café au lait"), ("2", "cafe\u0301 noir"), ("3", "the status_code"), ("4", "Größe ÉTÉ")], "id string, text string")
    index = X.build_text_index(docs)
    asked = spark.createDataFrame([("c", "cafe"), ("s", "status"), ("e", "été"), ("g", "große")], "query_id string, text string")
    assert rows(X.bm25_topk(asked, index, 5), "query_id", "id") == [("c", "1"), ("c", "2"), ("e", "4"), ("g", "4"), ("s", "3")]


def test_postings_lie_with_their_document(spark):
    """Adding up what documents score moves no posting; ids and owners may be null or repeat."""
    docs = spark.createDataFrame(
        [("a", "red red fox", "x"), ("a", "red", "x"), (None, "fox", None), ("b", None, "y")], "id string, text string, owner string"
    )
    index = X.build_text_index(docs)
    summed = index.postings.groupBy("id", "term").agg(F.sum("part"))
    assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id or "", r.owner or "", r.term) for r in index.postings.collect())
    assert got == [("", "", "fox"), ("a", "x", "fox"), ("a", "x", "red"), ("a", "x", "red")]


def test_index_of_asked_owners(spark):
    """Weights come from all documents, postings are written for the asked owners only, also for rows without one."""
    docs = spark.createDataFrame(
        [(f"d{i}", f"common w{i % 5} w{i % 3}", f"o{i % 10}") for i in range(60)] + [("n1", "common w1", None), ("n2", "w9", None), ("d1", "common w1 w1", "o1")],
        "id string, text string, owner string",
    )
    asked = spark.createDataFrame([("q1", "common w1", "o1"), ("q2", "w2 w0", "o7"), ("q3", "w9 w1", None)], "query_id string, text string, owner string")
    some = X.build_text_index(docs, asked.select("owner"))
    assert {r.owner for r in some.postings.select("owner").distinct().collect()} == {"o1", "o7", None}
    found = lambda index: sorted(map(str, X.bm25_topk(asked, index, 4).collect()))
    assert found(some) == found(X.build_text_index(docs)) and len(found(some)) > 8


def test_vectors_between_steps_are_packed(spark):
    """Vectors and request batches lie packed between steps, those of repeated ids included."""
    texts = spark.createDataFrame([("a", "red ring"), ("a", "red ring"), ("c", "blue")], "id string, text string")
    none = spark.createDataFrame([], EMBEDDING_CACHE)
    made, cache = V.embed_texts(texts, V.hashed_words(8), none, "m", "2024-01-01")
    assert any(".zstd.parquet" in f for f in made.inputFiles())
    assert sorted(r.id for r in made.collect()) == ["a", "a", "c"] and cache.count() == 2
    own, standing = collapse(texts.withColumnRenamed("id", "query_id"), ["text"])
    assert any(".zstd.parquet" in f for f in own.inputFiles()) and standing is None
