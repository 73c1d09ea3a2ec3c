"""Shapes of physical plans that keep the operators fit for large tables."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import people
from knotwork.operators import mutate as M
from knotwork.operators import relations as R
from knotwork.operators import stats as A
from knotwork.operators import text as X
from knotwork.operators import traverse as T
from knotwork.plans.queries import QUERIES
from knotwork.sources import fixtures

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def g(spark):
    return fixtures.graph_from_tables(spark, SF)


SINGLE_PLAN = [
    "degrees", "undirected_degrees", "audit_entities", "with_names", "relationships_of", "induced_edges",
    "resolve_names", "observations_of", "orphans", "duplicate_keys", "upsert_entities", "upsert_relationships",
    "delete_entities", "delete_relationships", "update_entities", "merge_entities", "find_connections",
    "bm25_topk", "search_observations_scoped", "suggest_names", "mention_links",
]


@pytest.mark.parametrize("name", SINGLE_PLAN)
def test_no_pairwise_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_small_requests_leave_the_edges_in_place(spark, g):
    """A few ids meet the edge table in broadcast joins: edges read from disk are not shuffled."""
    ids = g.entities.filter("entity_type = 'region'").select("id")
    edges = g.replace(relationships=spark.read.parquet(f"{SF}/nation.parquet").select(
        F.lit("main").alias("graph_id"), F.col("n_name").alias("id"),
        F.concat(F.lit("nation:"), "n_nationkey").alias("source_id"),
        F.concat(F.lit("region:"), "n_regionkey").alias("target_id"),
        F.lit("in_region").alias("relationship_type"), F.lit(1.0).alias("weight"),
    ))
    plan = plan_of(R.touching(edges.relationships, ids))
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
    gone, _ = M.delete_entities(g, spark.createDataFrame([("1", 1, "ASIA")], "request_id string, seq long, name string"))
    plan = plan_of(gone.observations)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scan_reads_only_needed_columns(spark, g):
    plan = plan_of(A.type_distribution(g.relationships, "relationship_type"))
    customer = next(line for line in plan.splitlines() if "customer.parquet" in line)
    assert "ReadSchema: struct<>" in customer
    plan = plan_of(g.observations.filter("source = 'en'").select("id"))
    assert re.search(r"PushedFilters: \[IsNotNull\(lang\), EqualTo\(lang,en\)", plan)


def test_top_k_is_cut_before_the_shuffle(spark, g):
    out = R.topk_with_flag(g.observations, ["entity_id"], [F.col("created_at").desc(), F.col("id")], 5)
    assert "WindowGroupLimit" in plan_of(out)
    index = X.build_text_index(X.entity_documents(g))
    asked = spark.createDataFrame([("q", "red ring")], "query_id string, text string")
    assert "WindowGroupLimit" in plan_of(X.bm25_topk(asked, index, 5))
    assert "TakeOrderedAndProject" in plan_of(A.most_connected(g))


def test_written_steps_are_not_shuffled_again(spark, monkeypatch):
    g = people(spark, "abc", [("a", "b"), ("b", "c"), ("b", "b2")])
    start = spark.createDataFrame([("a",)], "from_id string").hint("shuffle_hash")
    plan = plan_of(T.written_steps(g).meet(start))
    assert plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(T, "HUB_EDGES", 1)
    steps = T.written_steps(g)
    assert {r.from_id: r.slots for r in steps.hubs.collect()} == {"b": 3}
    assert steps.frame.filter("from_id = 'b' and slot > 2").count() == 0


def test_checkpoint_folder_follows_the_session(spark):
    from knotwork import session

    session.ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before


def test_one_seed_leaves_the_edges_in_place(spark, g, monkeypatch):
    """No traversal from a few seeds shuffles or writes the edge table."""
    written = []
    monkeypatch.setattr(T, "written_steps", lambda *a: written.append(a))
    seeds = g.entities.filter("entity_type = 'region'").selectExpr("id query_id", "id")
    reached, _ = T.bfs(g, seeds, 2, node_budget=None)
    assert reached.count() > 5 and not written
    T.find_connections(g, seeds, 2, node_budget=None).count()
    T.get_subgraph(g, seeds.select("id"), 1)[0].count()
    assert not written


def test_single_keys_leave_the_tables_in_place(spark, g):
    stored = spark.read.parquet(f"{SF}/nation.parquet").select(
        F.lit("main").alias("graph_id"), F.col("n_name").alias("id"),
        F.concat(F.lit("nation:"), "n_nationkey").alias("source_id"),
        F.concat(F.lit("region:"), "n_regionkey").alias("target_id"), F.lit("in_region").alias("relationship_type"),
    )
    edges = g.replace(relationships=stored)
    keys = spark.createDataFrame([("nation:1", "region:1", "in_region")], "source_id string, target_id string, relationship_type string")
    assert "hashpartitioning" not in plan_of(R.lookup_edges(edges, keys))
