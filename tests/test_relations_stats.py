"""Lists, profiles, resolution, statistics, scalars."""

import pytest
from pyspark.sql import functions as F

from helpers import graph, people, rows
from knotwork.functions import scalars as S
from knotwork.operators import relations as R
from knotwork.operators import resolve as N
from knotwork.operators import stats as A

REQUEST = "request_id string, name string"


def test_ambiguous_name_takes_newest(spark):
    g = graph(spark, [("p", "Mercury", "planet", "", "{}", -100), ("j", "Mercury", "project", "", "{}", 0), ("e", "mercury", "element", "", "{}", 50)])
    asked = spark.createDataFrame([("1", "Mercury", None), ("2", "Mercury", "planet"), ("3", "MERCURY", None), ("4", "Venus", None)], REQUEST + ", entity_type string")
    out = N.resolve_names(g.entities, asked)
    assert rows(out.fillna("-", "entity_id"), "request_id", "entity_id", "match_count", "status") == [
        ("1", "j", 3, "ambiguous"), ("2", "p", 3, "ambiguous"), ("3", "e", 3, "ambiguous"), ("4", "-", 0, "not_found")
    ]


def test_suggestions(spark):
    g = people(spark, ["red car", "red bus", "blue car", "100%_done"])
    asked = spark.createDataFrame([("1", "red car x"), ("2", "00%_d"), ("3", "zzz")], REQUEST)
    out = N.suggest_names(g, asked, 2)
    assert rows(out, "request_id", "rank", "suggestion") == [("1", 1, "red car"), ("1", 2, "blue car"), ("2", 1, "100%_done")]


def test_degrees(spark):
    g = people(spark, ["hub", "b", "a", "lone"], [("hub", "a"), ("hub", "b"), ("hub", "hub"), ("a", "hub", "likes")])
    assert rows(A.degrees(g), "id", "degree") == [("a", 2), ("b", 1), ("hub", 5), ("lone", 0)]
    assert [r.id for r in A.most_connected(g, 3).collect()] == ["hub", "a", "b"]
    assert rows(A.undirected_degrees(g), "id", "degree") == [("a", 1), ("b", 1), ("hub", 4), ("lone", 0)]
    assert rows(A.graph_density(g), "nodes", "edges", "max_degree", "density") == [(4, 3, 4, 0.5)]
    assert rows(A.graph_density(people(spark, "x")), "density") == [(0.0,)]
    (empty,) = A.graph_density(graph(spark)).collect()
    assert empty.nodes == 0 and empty.density == 0


def test_touching_self_loop_once(spark):
    g = people(spark, "ab", [("a", "a"), ("a", "b"), ("b", "a")])
    ids = spark.createDataFrame([("a",)], "id string")
    assert rows(R.relationships_of(g, ids), "id", "direction") == [("r000", "outgoing"), ("r001", "outgoing"), ("r002", "incoming")]
    assert rows(R.relationships_of(g, ids, "outgoing", [" KNOWS "]), "id") == [("r000",), ("r001",)]
    assert rows(R.relationships_of(g, ids, "incoming"), "id") == [("r000",), ("r002",)]
    assert rows(R.induced_edges(g, ids), "id") == [("r000",)]
    with pytest.raises(ValueError):
        R.touching(g.relationships, ids, "sideways")


def test_profile_caps(spark):
    g = graph(spark, [("e", "E", "t")], facts=[(f"o{i:02d}", "e", "x", i) for i in range(55)])
    asked = spark.createDataFrame([("1", "e"), ("2", "none")], REQUEST)
    out = {r.request_id: r for r in R.entity_profiles(g, asked).collect()}
    assert (len(out["1"].observations), out["1"].observation_count, out["1"].observations_truncated) == (50, 55, True)
    assert out["1"].observations[0].id == "o54" and out["1"].relationship_count == 0
    assert out["2"].status == "not_found" and out["2"].name is None


def test_audit(spark):
    full = graph(spark, [("e", "E", "t", "d", '{"k": 1}')], facts=[("o", "e", "x")])
    assert rows(A.audit_summary(A.audit_entities(full)), "quality_score", "disconnected") == [(75.0, 1)]
    pair = people(spark, ["Alice", "Bob"], [("Alice", "Bob")])
    (r,) = A.audit_summary(A.audit_entities(pair)).collect()
    assert (r.disconnected, r.low_connection, r.missing_description) == (0, 2, 2)
    (none,) = A.audit_summary(A.audit_entities(graph(spark))).collect()
    assert none.quality_score == 100.0 and none.scanned == 0
    odd = graph(spark, [("1", "a", "t", " \n", "not json"), ("2", "b", "t", "d", "[1]"), ("3", "c", "t", "d", '{"a": null}')])
    assert rows(A.audit_entities(odd), "id", "missing_description", "empty_properties") == [("1", True, True), ("2", False, True), ("3", False, False)]


def test_hotspot_action(spark):
    g = graph(spark, [("e", "E", "t", "d")], facts=[(f"o{i}", "e", "x") for i in range(20)])
    out = A.graph_health(g)
    assert rows(out.filter("section = 'hotspots'"), "key", "value") == [("e", "20")]
    assert rows(out.filter("section = 'actions'"), "key", "value") == [("compact_observations", "E=20"), ("consolidate_observations", "20.0")]


def test_topk_flag(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "g string, v int")
    out = R.topk_with_flag(df, ["g"], [F.col("v").desc()], 2)
    assert rows(out, "g", "v", "rank", "total", "truncated") == [("a", 3, 2, 5, True), ("a", 4, 1, 5, True), ("b", 1, 1, 1, False)]


def test_scalars(spark):
    df = spark.createDataFrame([(" \t x y \n", '{"b": 1.50, "a": "1", "n": null, "e": "", "d": {"k": [1]}}')], "s string, p string")
    c = df.select(
        S.strip(F.col("s")).alias("strip"), S.nocase(F.lit("ÀB")).alias("nocase"),
        S.props_json(S.props_map(F.col("p"))).alias("json"),
        S.props_json(S.nonempty_props(F.col("p"))).alias("nonempty"),
        S.overlay_props(F.col("p"), F.lit('{"a": 1}')).alias("over"),
        S.props_json(S.props_map(F.lit("[1"))).alias("bad"),
        S.append_text(F.lit("ab"), F.lit(" b ")).alias("same"), S.append_text(F.lit(""), F.lit("x")).alias("first"),
        S.tolerant_double(F.lit("x"), 1.0).alias("d"), S.tokens(F.lit("Don't_stop Été 42")).alias("tokens"),
    ).first()
    assert c.strip == "x y" and c.nocase == "Àb"
    assert c.json == '{"a":"1","b":1.5,"d":{"k":[1]},"e":"","n":null}'
    assert c.nonempty == '{"a":"1","b":1.5,"d":{"k":[1]}}'
    assert c.over == '{"a":1,"b":1.5,"d":{"k":[1]},"e":"","n":null}'
    assert (c.bad, c.same, c.first, c.d) == ("{}", "ab", "x", 1.0)
    assert c.tokens == ["don", "t", "stop", "ete", "42"]


def test_unknown_fields_are_rejected(spark):
    df = spark.createDataFrame([("a", 1)], "name string, nmae int")
    with pytest.raises(ValueError, match="nmae"):
        R.reject_unknown_columns(df, "name id")


def test_large_sorted_limit(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    order = [F.col("a").desc(), F.col("id").asc()]
    want = rows(df.orderBy(*order).limit(333), "a", "id")
    monkeypatch.setattr(R, "HEAP_ROWS", 10)
    assert rows(R.page_of(df, order, 333), "a", "id") == want
    assert R.page_of(df, order, 5000).count() == 1000


def test_deep_and_open_pages(spark, monkeypatch):
    monkeypatch.setattr(R, "HEAP_ROWS", 5)
    df = spark.range(100).repartition(7)
    order = [F.col("id").desc()]
    whole = list(range(99, -1, -1))
    for limit, offset in ((3, 0), (10, 0), (10, 40), (None, 0), (None, 30), (200, 95), (5, 200), (0, 3)):
        got = sorted((r.id for r in R.page_of(df, order, limit, offset).collect()), reverse=True)
        assert got == whole[offset : None if limit is None else offset + limit]


def test_bars_in_ids_are_no_duplicates(spark):
    g = people(spark, ["a", "b", "c", "a|b", "b|c"], [("a|b", "c"), ("a", "b|c")])
    assert R.find_duplicate_keys(g).count() == 0


def test_audit_reads_tables_once(spark, tmp_path):
    g = graph(spark, [("1", "a", "x"), ("2", "b", "x"), ("3", "c", "y")], [("r1", "1", "2"), ("r2", "2", "2"), ("r3", None, "1")], [("f", "1", "text")])
    path = str(tmp_path / "edges")
    g.relationships.write.parquet(path)
    g = g.replace(relationships=spark.read.parquet(path))
    reads = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    flags = A.audit_entities(g)
    assert reads(flags) == 1
    assert rows(flags, "id", "rel_count") == [("1", 1), ("2", 2), ("3", 0)]
    offenders = A.audit_offenders(flags, 1)
    assert "edges" not in offenders._jdf.queryExecution().executedPlan().toString()
    assert rows(offenders.filter("category = 'missing_observations'"), "id", "total", "truncated") == [("2", 2, True)]
