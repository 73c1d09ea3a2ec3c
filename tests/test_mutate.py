"""Batch mutations against the same requests applied one at a time, and hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import NOW, graph, people, rows
from knotwork.operators import mutate as M

BATCH = "request_id string, seq long, name string, entity_type string, description string, properties string"


def fold(name):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in name)


def append(old, new):
    new = new.strip()
    return f"{old}\n{new}".strip() if new and new not in old else old


def props(df, *key):
    return {tuple(r[c] for c in key): json.loads(r.properties) for r in df.collect()}


def test_case_variant_upsert(spark):
    g = graph(spark)
    batch = spark.createDataFrame(
        [("1", 1, "Alice", "Person", "original", "{}"), ("2", 2, " alice\n", "person", "lowercase variant", "{}")], BATCH
    )
    after, status = M.upsert_entities(g, batch, NOW)
    assert rows(after.entities, "name", "entity_type", "description") == [("Alice", "person", "original\nlowercase variant")]
    assert rows(status, "request_id", "status") == [("1", "created"), ("2", "merged")]
    again, status = M.upsert_entities(after, batch, NOW)
    assert rows(again.entities, "id", "name", "description") == rows(after.entities, "id", "name", "description")
    assert rows(status, "status") == [("merged",)] * 2


def test_same_name_other_type_and_accents(spark):
    batch = spark.createDataFrame(
        [("1", 1, "Mercury", "person", "", "{}"), ("2", 2, "Mercury", "project", "", "{}"),
         ("3", 3, "ÉVA", "person", "", "{}"), ("4", 4, "éva", "person", "", "{}"), ("5", 5, " ", "x", "", "{}")], BATCH
    )
    after, status = M.upsert_entities(graph(spark), batch, NOW)
    assert after.entities.count() == 4
    assert rows(status.filter("status = 'rejected'"), "request_id", "reason") == [("5", "name is empty")]


def test_upserts_equal_one_at_a_time(spark):
    rng = random.Random(1)
    old = [(f"e{i}", n, "t", d, p) for i, (n, d, p) in enumerate([("Ada", "first", '{"a": 1}'), ("Bob", "", "{}"), ("Cy", "x y", '{"z": null}')])]
    g = graph(spark, old)
    table = {(fold(n), t): [i, n, d, json.loads(p)] for i, n, t, d, p in old}
    batch = []
    for seq in range(60):
        name = rng.choice(["Ada", "ADA", "bob", "Dee", "dee", "Eve", "eVe"])
        text = rng.choice(["", "one", "two words", "two", " one ", "x"])
        p = {rng.choice("abc"): rng.choice([1, "1", None, [1, {"k": 2}], 2.5])}
        batch.append((str(seq), seq, name, "t", text, json.dumps(p)))
        key = (fold(name), "t")
        if key in table:
            row = table[key]
            row[2], row[3] = append(row[2], text), {**row[3], **p}
        else:
            table[key] = [None, name, text, p]
    after, _ = M.upsert_entities(g, spark.createDataFrame(rng.sample(batch, 60), BATCH), NOW)
    got = {(fold(r.name), r.entity_type): r for r in after.entities.collect()}
    assert set(got) == set(table)
    for key, (i, name, text, p) in table.items():
        assert (got[key].name, got[key].description, json.loads(got[key].properties)) == (name, text, p)
        assert i is None or got[key].id == i


EDGES = "request_id string, seq long, source string, target string, relationship_type string, weight double, properties string"


def test_edge_upsert(spark):
    g = people(spark, ["Alice", "Bob"])
    batch = spark.createDataFrame(
        [("1", 1, "alice", "Bob", " Knows ", 0.5, '{"context": "w"}'), ("2", 2, "Alice", "BOB", "knows", 0.9, '{"since": 2020}'),
         ("3", 3, "Alice", "Nobody", "knows", 0.9, None), ("4", 4, "Alice", "Bob", "knows", 1.5, None)], EDGES
    )
    after, status = M.upsert_relationships(g, batch, NOW)
    assert rows(after.relationships, "source_id", "target_id", "relationship_type", "weight") == [("Alice", "Bob", "knows", 0.9)]
    assert props(after.relationships, "source_id") == {("Alice",): {"context": "w", "since": 2020}}
    assert rows(status, "request_id", "status") == [("1", "created"), ("2", "updated"), ("3", "not_found"), ("4", "rejected")]
    lower = spark.createDataFrame([("5", 1, "Alice", "Bob", "knows", 0.1, '{"since": 1}')], EDGES)
    again, _ = M.upsert_relationships(after, lower, NOW)
    assert rows(again.relationships, "weight") == [(0.9,)]
    assert rows(again.relationships, "id") == rows(after.relationships, "id")


def test_add_observations_replay(spark):
    g = people(spark, ["Ada"])
    batch = spark.createDataFrame(
        [("1", 1, "ada", " same "), ("2", 2, "Ada", "same"), ("3", 3, "Eve", "x"), ("4", 4, "Ada", " ")],
        "request_id string, seq long, entity_name string, content string",
    )
    after, status = M.add_observations(g, batch, NOW)
    assert rows(after.observations, "entity_id", "content") == [("Ada", "same")] * 2
    assert rows(status, "request_id", "status") == [("1", "added"), ("2", "added"), ("3", "not_found"), ("4", "rejected")]
    again, _ = M.add_observations(after, batch, NOW)
    assert again.observations.count() == 2


def test_update_entities(spark):
    g = people(spark, ["Ada", "Bob", "Cy"])
    patches = spark.createDataFrame(
        [("1", 1, "ada", "ADA", None, '{"a": 1}', None), ("2", 2, "Bob", "cy", None, None, None), ("3", 3, "Ada", None, "d", '{"a": 2, "b": null}', " Robot "),
         ("4", 4, "Zed", "Q", None, None, None), ("5", 5, "Cy", None, None, None, None)],
        "request_id string, seq long, name string, new_name string, description string, properties string, entity_type string",
    )
    after, status = M.update_entities(g, patches, NOW)
    assert rows(status, "request_id", "status") == [("1", "updated"), ("2", "conflict"), ("3", "updated"), ("4", "not_found"), ("5", "unchanged")]
    assert rows(after.entities, "id", "name", "entity_type", "description") == [
        ("Ada", "ADA", "robot", "d"), ("Bob", "Bob", "person", ""), ("Cy", "Cy", "person", "")
    ]
    assert props(after.entities.filter("id = 'Ada'"), "id") == {("Ada",): {"a": 2, "b": None}}


def test_update_relationships(spark):
    g = people(spark, "ab", [("a", "b", "x", 0.5), ("a", "b", "y", 0.5)])
    patches = spark.createDataFrame(
        [("1", 1, "a", "b", "X", 0.7, None), ("2", 2, "a", "b", "x", None, "y"), ("3", 3, "a", "b", "y", 1.2, None), ("4", 4, "b", "a", "x", 0.1, None), ("5", 5, "a", "b", "y", None, " Z ")],
        "request_id string, seq long, source string, target string, relationship_type string, new_weight double, new_type string",
    )
    after, status = M.update_relationships(g, patches, NOW)
    assert rows(status, "request_id", "status") == [("1", "updated"), ("2", "conflict"), ("3", "rejected"), ("4", "not_found"), ("5", "updated")]
    assert rows(after.relationships, "relationship_type", "weight") == [("x", 0.7), ("z", 0.5)]


def test_delete_cascade(spark):
    g = people(spark, ["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "c")], facts=[("o1", "a", "x"), ("o2", "b", "y")], vectors=[("a", [1.0]), ("b", [1.0])])
    asked = spark.createDataFrame([("1", 1, "A"), ("2", 2, "a"), ("3", 3, "nope")], "request_id string, seq long, name string")
    after, status = M.delete_entities(g, asked)
    assert rows(status, "request_id", "status") == [("1", "deleted"), ("2", "not_found"), ("3", "not_found")]
    assert [df.count() for df in after.tables().values()] == [2, 2, 1, 1, 0]


def test_delete_relationships_and_observations(spark):
    g = people(spark, "abc", [("a", "b", "x"), ("a", "b", "y"), ("b", "a", "x"), ("a", "c", "x"), ("a", "c", "y")], facts=[("o1", "a", "t"), ("o2", "b", "t")])
    asked = spark.createDataFrame([("1", 1, "a", "b", None), ("2", 2, "a", "c", "X")], "request_id string, seq long, source string, target string, relationship_type string")
    after, status = M.delete_relationships(g, asked)
    assert rows(after.relationships, "source_id", "target_id", "relationship_type") == [("a", "c", "y"), ("b", "a", "x")]
    assert rows(status, "request_id", "deleted") == [("1", 2), ("2", 1)]
    asked = spark.createDataFrame([("1", 1, "a", "o1"), ("2", 2, "a", "o2")], "request_id string, seq long, entity_name string, observation_id string")
    after, status = M.delete_observations(g, asked)
    assert rows(after.observations, "id") == [("o2",)]
    assert rows(status, "request_id", "status") == [("1", "deleted"), ("2", "not_found")]


def test_update_observation_ownership(spark):
    g = people(spark, "ab", facts=[("o1", "a", "old"), ("o2", "b", "old")])
    asked = spark.createDataFrame([("1", 1, "a", "o1", " new "), ("2", 2, "a", "o2", "new")], "request_id string, seq long, entity_name string, observation_id string, content string")
    after, status = M.update_observations(g, asked)
    assert rows(after.observations, "id", "content") == [("o1", "new"), ("o2", "old")]
    assert sorted(map(tuple, status.select("request_id", "status", "old_content", "new_content").collect()))[0] == ("1", "updated", "old", "new")


def test_compaction(spark):
    g = people(spark, "ab", facts=[(f"o{i}", "a", "t") for i in range(4)] + [("x", "b", "t")])
    schema = "request_id string, seq long, entity_name string, keep_ids array<string>, new_observations array<string>"
    asked = spark.createDataFrame([("1", 1, "A", ["o0", "o1", "o0"], ["sum"]), ("2", 2, "b", ["o0"], ["no"])], schema)
    after, status = M.compact_observations(g, asked, NOW)
    assert rows(status, "request_id", "status", "before", "deleted", "kept", "added", "after") == [
        ("1", "compacted", 4, 2, 2, 1, 3), ("2", "rejected", 1, 0, 0, 0, 1)
    ]
    assert rows(after.observations, "entity_id", "content") == [("a", "sum"), ("a", "t"), ("a", "t"), ("b", "t")]


# --- merging --------------------------------------------------------------------------------

PAIRS = "request_id string, seq long, source_id string, target_id string"


@pytest.mark.parametrize("pair", [("Bobby", "Bob"), ("Bob", "Bobby")])
def test_merge_drops_edges_of_the_pair(spark, pair):
    g = people(spark, ["Bob", "Bobby"], [("Bobby", "Bob", "alias_of"), ("Bob", "Bobby", "alias_of"), ("Bobby", "Bobby", "alias_of")])
    g = g.replace(relationships=g.relationships.filter(f"not (source_id = target_id and source_id = '{pair[1]}')"))
    after, status = M.merge_entities(g, spark.createDataFrame([("1", 1, *pair)], PAIRS), NOW)
    assert after.relationships.count() == 0 and rows(after.entities, "id") == [(pair[1],)]


def test_merge_combines_duplicates(spark):
    g = people(spark, ["Bob", "Bobby", "Carol"], [("Bob", "Carol", "knows", 0.4, '{"since": 1, "k": "old"}'), ("Bobby", "Carol", "knows", 0.9, '{"via": 2, "k": "new"}'), ("Carol", "Bobby", "likes")], facts=[("o", "Bobby", "t")])
    after, status = M.merge_entities(g, spark.createDataFrame([("1", 1, "Bobby", "Bob")], PAIRS), NOW)
    assert rows(after.relationships, "id", "source_id", "target_id", "weight") == [("r000", "Bob", "Carol", 0.9), ("r002", "Carol", "Bob", 1.0)]
    assert props(after.relationships.filter("id = 'r000'"), "id") == {("r000",): {"since": 1, "via": 2, "k": "new"}}
    assert rows(status, "status", "moved_observations", "redirected_relationships", "removed_duplicate_relationships") == [("merged", 1, 1, 1)]
    assert rows(after.observations, "entity_id") == [("Bob",)]


def merge_plainly(entities, edges, owners, requests):
    """Requests one after the other: entities id → text, edges key → (id, weight, properties)."""
    status = {}
    for request, _, s, t in sorted(requests, key=lambda r: r[1]):
        if s == t:
            status[request] = "self_merge"
            continue
        if s not in entities or t not in entities:
            status[request] = "not_found"
            continue
        status[request] = "merged"
        text = entities.pop(s)
        if text and text not in entities[t]:
            entities[t] = f"{entities[t]}\n{text}".strip()
        for o, owner in owners.items():
            owners[o] = t if owner == s else owner
        for key in [k for k in sorted(edges, key=lambda k: edges[k][0]) if s in k[:2]]:
            i, w, p = edges.pop(key)
            a, b = (t if x == s else x for x in key[:2])
            if a == b:
                continue
            new = (a, b, key[2])
            if new in edges:
                j, v, q = edges[new]
                edges[new] = (j, max(v, w), {**q, **p})
            else:
                edges[new] = (i, w, p)
    return status


@pytest.mark.parametrize("seed", range(5))
def test_merges_equal_one_at_a_time(spark, seed):
    """Random merges with chains, repeats, cycles and shared targets."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(10)]
    texts = {n: rng.choice(["", "x", "long x text", n]) for n in names}
    edges = {}
    for i in range(30):
        key = (rng.choice(names), rng.choice(names), rng.choice("ab"))
        edges.setdefault(key, (f"r{i:03d}", rng.randrange(10) / 10, {rng.choice("pq"): i}))
    owners = {f"o{i}": rng.choice(names) for i in range(12)}
    requests = [(f"m{i}", i, rng.choice(names), rng.choice(names)) for i in range(7)]
    g = graph(
        spark,
        [(n, n, "t", texts[n]) for n in names],
        [(i, s, t, k, w, json.dumps(p)) for (s, t, k), (i, w, p) in edges.items()],
        [(o, owner, "text") for o, owner in owners.items()],
    )
    after, status = M.merge_entities(g, spark.createDataFrame(rng.sample(requests, 7), PAIRS), NOW)
    want = merge_plainly(texts, edges, owners, requests)
    assert dict(rows(status, "request_id", "status")) == want
    assert dict(rows(after.entities, "id", "description")) == texts
    assert dict(rows(after.observations, "id", "entity_id")) == owners
    got = {(r.source_id, r.target_id, r.relationship_type): (r.weight, json.loads(r.properties)) for r in after.relationships.collect()}
    assert got == {k: (w, p) for k, (_, w, p) in edges.items()}


def test_a_chain_of_merges_is_one_pass(spark, monkeypatch):
    """Chains of ten in both orders and a cycle: as one at a time, and no table is written however long they are."""
    names = [f"n{i:02d}" for i in range(24)]
    texts = {n: f"text {n}" for n in names}
    edges = {(a, b, "t"): (f"r{i:03d}{j:03d}", (i + j) % 10 / 10, {f"p{(i + j) % 3}": i}) for i, a in enumerate(names) for j, b in enumerate(names) if (i * 7 + j * 3) % 5 == 0}
    owners = {f"o{n}": n for n in names}
    up = [(f"u{i}", i, names[i], names[i + 1]) for i in range(10)]
    down = [(f"d{i}", 100 - i, names[11 + i], names[12 + i]) for i in range(9)]
    ring = [("x1", 200, "n21", "n22"), ("x2", 201, "n22", "n23"), ("x3", 202, "n23", "n21")]
    requests = up + down + ring
    g = graph(
        spark, [(n, n, "t", texts[n]) for n in names], [(i, s, t, k, w, json.dumps(p)) for (s, t, k), (i, w, p) in edges.items()],
        [(o, n, "text") for o, n in owners.items()],
    )
    cuts, real = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df: cuts.append(df.columns) or real(df))
    after, status = M.merge_entities(g, spark.createDataFrame(requests, PAIRS), NOW)
    assert not any("content" in c or "embedding" in c or "created_at" in c and "states" not in c for c in cuts)
    assert len(cuts) < 40
    want = merge_plainly(texts, edges, owners, requests)
    assert dict(rows(status, "request_id", "status")) == want
    assert dict(rows(after.entities, "id", "description")) == texts
    assert dict(rows(after.observations, "id", "entity_id")) == owners
    got = {(r.source_id, r.target_id, r.relationship_type): (r.id, r.weight, json.loads(r.properties)) for r in after.relationships.collect()}
    assert got == edges
    moved = dict(rows(status, "request_id", "moved_observations"))
    assert [moved[f"u{i}"] for i in range(10)] == list(range(1, 11))


def test_merges_count_edges_as_one_at_a_time(spark):
    """What a merge reports does not depend on which other requests share its batch."""
    rng = random.Random(9)
    names = [f"n{i}" for i in range(8)]
    keys = sorted({(rng.choice(names), rng.choice(names)) for _ in range(40)})
    requests = [("a", 1, "n0", "n1"), ("b", 2, "n2", "n3"), ("c", 3, "n1", "n3"), ("d", 4, "n3", "n4")]
    g = people(spark, names, keys)
    counts = ["request_id", "status", "moved_observations", "redirected_relationships", "removed_duplicate_relationships"]
    _, together = M.merge_entities(g, spark.createDataFrame(requests, PAIRS), NOW)
    single = []
    for r in requests:
        g, status = M.merge_entities(g, spark.createDataFrame([r], PAIRS), NOW)
        single += rows(status, *counts)
        g = g.replace(**{n: M.cut(df) for n, df in g.tables().items()})
    assert rows(together, *counts) == sorted(single)


def test_add_entities_with_observations(spark):
    g = people(spark, ["Ada"])
    batch = spark.createDataFrame(
        [("1", 1, "ADA", "person", "d", ["one", " "]), ("2", 2, "Ada", "robot", "", ["two"]), ("3", 3, "Cy", "robot", "x", [])],
        "request_id string, seq long, name string, entity_type string, description string, observations array<string>",
    )
    after, status, hints = M.add_entities(g, batch, NOW)
    ids = dict(rows(status, "request_id", "id"))
    assert ids["1"] == "Ada" and rows(after.observations, "entity_id", "content") == sorted([("Ada", "one"), (ids["2"], "two")])
    assert rows(hints, "name", "missing_description", "missing_observations") == [("Ada", True, False), ("Cy", False, True)]
    with pytest.raises(ValueError, match="nmae"):
        M.upsert_entities(g, batch.withColumnRenamed("name", "nmae"), NOW)


def two_graphs(spark):
    g = people(spark, ["Ada", "Bob"], [("Ada", "Bob")])
    twin = lambda df, *ids: df.withColumns({"graph_id": F.lit("b"), **{c: F.concat(F.lit("b-"), c) for c in ids}})
    return g.replace(
        entities=g.entities.unionByName(twin(g.entities, "id").withColumn("updated_at", F.lit(NOW).cast("timestamp"))),
        relationships=g.relationships.unionByName(twin(g.relationships, "id", "source_id", "target_id")),
    )


def test_named_graphs_keep_apart(spark):
    g = two_graphs(spark)
    one = lambda schema, *values: spark.createDataFrame([("1", 1, *values)], "request_id string, seq long, " + schema)
    after, _ = M.add_observations(g, one("entity_name string, content string", "ada", "fact"), NOW, "main")
    assert rows(after.observations, "graph_id", "entity_id") == [("main", "Ada")]
    after, status = M.add_observations(g, one("entity_id string, content string", "b-Ada", "fact"), NOW, "main")
    assert rows(status, "status") == [("not_found",)] and after.observations.count() == 0
    after, _ = M.upsert_relationships(g, one("source string, target string, relationship_type string", "Ada", "Bob", "likes"), NOW, "main")
    assert rows(after.relationships.filter("relationship_type = 'likes'"), "graph_id", "source_id") == [("main", "Ada")]
    assert after.relationships.count() == 3
    after, _ = M.update_entities(g, one("name string, new_name string", "Ada", "Eve"), NOW, "main")
    assert rows(after.entities, "id", "name") == [("Ada", "Eve"), ("Bob", "Bob"), ("b-Ada", "Ada"), ("b-Bob", "Bob")]
    clash = g.replace(entities=g.entities.withColumn("name", F.when(F.col("id") == "b-Bob", "Eve").otherwise(F.col("name"))))
    _, status = M.update_entities(clash, one("name string, new_name string", "Ada", "Eve"), NOW, "main")
    assert rows(status, "status") == [("updated",)]  # a name of another graph is no conflict
    after, _ = M.update_relationships(g, one("source string, target string, relationship_type string, new_weight double", "Ada", "Bob", "knows", 0.25), NOW, "main")
    assert rows(after.relationships, "source_id", "weight") == [("Ada", 0.25), ("b-Ada", 1.0)]
    after, _ = M.delete_entities(g, one("name string", "Ada"), "main")
    assert rows(after.entities, "id") == [("Bob",), ("b-Ada",), ("b-Bob",)]
    after, _ = M.delete_relationships(g, one("source string, target string", "Ada", "Bob"), "main")
    assert rows(after.relationships, "source_id") == [("b-Ada",)]
    both = spark.createDataFrame([("1", 1, "b-Bob", "Ada"), ("2", 2, "Bob", "Ada")], "request_id string, seq long, source_id string, target_id string")
    after, status = M.merge_entities(g, both, NOW)  # never across graphs
    assert rows(status, "request_id", "status") == [("1", "not_found"), ("2", "merged")]
    after, status = M.merge_entities(g, one("source string, target string", "Bob", "Ada"), NOW, "main")
    assert rows(after.entities, "id") == [("Ada",), ("b-Ada",), ("b-Bob",)] and rows(status, "status") == [("merged",)]


def test_delete_relationships_in_one_join(spark):
    """Edges that stay are told in one join; an edge without a type goes where all types are asked for."""
    g = people(spark, ["a", "b", "c"], [("a", "b"), ("a", "b", "likes"), ("a", "b", None), ("b", "c"), ("b", "c", "likes"), ("b", "c", "likes"), ("b", "c", None), ("c", "a")])
    asked = [("1", 1, "a", "b", None), ("2", 2, "b", "c", " Likes"), ("3", 3, "c", "b", None), ("4", 4, "a", "b", "knows"), ("5", 5, "x", "b", None), ("6", 6, "c", "a", "hates")]
    requests = spark.createDataFrame(asked, "request_id string, seq int, source string, target string, relationship_type string")
    after, status = M.delete_relationships(g, requests)
    assert rows(after.relationships, "id") == [("r003",), ("r006",), ("r007",)]
    assert rows(status, "request_id", "deleted") == [("1", 3), ("2", 2), ("3", 0), ("4", 1), ("5", 0), ("6", 0)]
    plan = after.relationships._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
