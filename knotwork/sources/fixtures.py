"""Build a graph from the relational, event and text tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.scalars import embedding_text
from knotwork.model import Graph

BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(BASE_EPOCH) + seconds.cast("long"))


def _key(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _entities(df, graph_id, kind, key, name, description=None, properties=None, at=None):
    at = _at(F.col(key)) if at is None else at
    return df.select(
        F.lit(graph_id).alias("graph_id"),
        _key(kind, key).alias("id"),
        name.alias("name"),
        F.lit(kind).alias("entity_type"),
        (F.lit("") if description is None else description).alias("description"),
        (F.lit("{}") if properties is None else properties).alias("properties"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def _edges(df, kind, source, target, weight, at):
    return df.select(
        F.lit("main").alias("graph_id"),
        F.concat_ws(">", source, F.lit(kind), target).alias("id"),
        source.alias("source_id"),
        target.alias("target_id"),
        F.lit(kind).alias("relationship_type"),
        weight.cast("double").alias("weight"),
        F.lit("{}").alias("properties"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def graph_from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """Lazy graph over the data folder: unused tables and columns are pruned by Catalyst."""
    t = lambda name: table(spark, sf_dir, name)
    customer, supplier, part, orders = t("customer"), t("supplier"), t("part"), t("orders")
    nation, region, lineitem = t("nation"), t("region"), t("lineitem")
    documents, turns, events = t("documents"), t("conversations"), t("events")

    order_time = F.col("o_orderdate").cast("timestamp")
    acctbal = lambda c: F.to_json(F.struct(F.col(c).alias("acctbal")))
    string = lambda c: F.col(c).cast("string")
    entities = [
        _entities(region, "main", "region", "r_regionkey", F.col("r_name")),
        _entities(nation, "main", "nation", "n_nationkey", F.col("n_name")),
        _entities(
            customer, "main", "customer", "c_custkey", F.col("c_name"),
            F.col("c_mktsegment"), acctbal("c_acctbal"),
        ),
        _entities(
            supplier, "main", "supplier", "s_suppkey", F.col("s_name"), None, acctbal("s_acctbal")
        ),
        _entities(
            part, "main", "part", "p_partkey",
            F.concat(F.col("p_name"), F.lit(" #"), string("p_partkey")),
            F.concat_ws(" ", "p_brand", "p_type"),
            F.to_json(F.struct(F.col("p_size").alias("size"))),
        ),
        _entities(
            orders, "main", "order", "o_orderkey",
            F.concat(F.lit("Order#"), string("o_orderkey")),
            F.col("o_orderpriority"), None, order_time,
        ),
        _entities(
            documents.groupBy("source").agg(F.lit(0).alias("zero")),
            "text", "source", "source", F.col("source"), None, None, _at(F.lit(0)),
        ),
        _entities(
            turns.select("conv_id").distinct(), "text", "conversation", "conv_id",
            F.concat(F.lit("Conversation "), string("conv_id")),
        ),
        _entities(
            events.select("user_id").distinct(), "text", "user", "user_id",
            F.concat(F.lit("User "), string("user_id")),
        ),
    ]

    contains = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    supplies = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("d"))
    one, zero = F.lit(1.0), _at(F.lit(0))
    relationships = [
        _edges(nation, "in_region", _key("nation", "n_nationkey"), _key("region", "n_regionkey"), one, zero),
        _edges(customer, "in_nation", _key("customer", "c_custkey"), _key("nation", "c_nationkey"), one, zero),
        _edges(supplier, "in_nation", _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), one, zero),
        _edges(orders, "placed", _key("customer", "o_custkey"), _key("order", "o_orderkey"), one, order_time),
        _edges(
            contains, "contains", _key("order", "l_orderkey"), _key("part", "l_partkey"),
            F.col("q") / 50, _at(F.col("l_orderkey")),
        ),
        _edges(
            supplies, "supplies", _key("supplier", "l_suppkey"), _key("part", "l_partkey"),
            1 - F.col("d"), _at(F.col("l_partkey")),
        ),
    ]

    def facts(df, obs_id, owner, content, source, at):
        return df.select(
            F.lit("text").alias("graph_id"),
            obs_id.alias("id"),
            owner.alias("entity_id"),
            content.alias("content"),
            source.alias("source"),
            at.alias("created_at"),
        )

    observations = [
        facts(
            documents, _key("doc", "doc_id"), _key("source", "source"),
            F.col("text"), F.col("lang"), _at(F.col("doc_id")),
        ),
        facts(
            turns,
            F.concat_ws(":", F.lit("turn"), string("conv_id"), string("turn")),
            _key("conversation", "conv_id"), F.col("text"), F.col("role"), _at(F.col("turn")),
        ),
        facts(
            events, _key("event", "event_id"), _key("user", "user_id"),
            F.concat_ws(" ", F.col("event_type"), string("value")),
            F.lit("events"), F.col("ts").cast("timestamp"),
        ),
    ]

    def union_all(frames):
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionAll(frame)
        return out

    vectors = t("embeddings").select(
        F.lit("text").alias("graph_id"),
        _key("doc", "vec_id").alias("id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.concat(F.lit("given-"), string("label")).alias("model_name"),
    )
    return Graph.of(
        spark,
        entities=union_all(entities),
        relationships=union_all(relationships),
        observations=union_all(observations),
        observation_embeddings=vectors,
    )


def entity_texts(g: Graph) -> DataFrame:
    """``(id, text)`` of every entity, the text its vector is made from."""
    return g.entities.select(
        "id", embedding_text(F.col("name"), F.col("entity_type"), F.col("description")).alias("text")
    )
