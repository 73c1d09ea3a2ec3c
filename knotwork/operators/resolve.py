"""Names to entities: resolution cascade, suggestions for misses, ambiguity report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import nocase
from knotwork.model import Graph
from knotwork.operators.grams import GramIndex, build_gram_index, first_names
from knotwork.operators.text import TextIndex, bm25_topk, build_text_index, entity_documents
from knotwork.session import broadcast_if_small, cut, sized

NAME_ROW_BYTES = 160


def resolve_names(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve ``requests(request_id, name[, entity_type])`` to one entity each.

    Preference: exact name and type, exact name, name in any case; within a tier the newest, then
    the lowest id. ``match_count`` is the number of entities sharing the name in any case. Requests
    are reduced to distinct names, which filter the entities before anything is shuffled, and entities
    to one row per spelling, so neither a much-used name nor a much-asked one piles up in a task.
    """
    if "entity_type" not in requests.columns:
        requests = requests.withColumn("entity_type", F.lit(None).cast("string"))
    wanted = cut(
        requests.select(F.col("name").alias("want"), F.col("entity_type").alias("want_type")).distinct()
    )
    rows = wanted.count()
    wanted = wanted.withColumn("folded", nocase(F.col("want")))
    asked = broadcast_if_small(wanted.select("folded").distinct(), rows, NAME_ROW_BYTES)
    newest = F.struct(-F.unix_micros("updated_at"), F.col("id"))
    spellings = (
        entities.select(nocase(F.col("name")).alias("folded"), "name", "entity_type", "updated_at", "id")
        .join(asked, "folded", "left_semi")
        .groupBy("folded", "name", "entity_type")
        .agg(F.min(newest).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    tier = (
        F.when((F.col("name") == F.col("want")) & (F.col("entity_type") == F.col("want_type")), 0)
        .when(F.col("name") == F.col("want"), 1)
        .otherwise(2)
    )
    chosen = (
        wanted.join(spellings, "folded")
        .groupBy("want", "want_type")
        .agg(
            F.min(F.struct(tier.alias("tier"), "best", "name", "entity_type")).alias("pick"),
            F.sum("n").alias("match_count"),
        )
        .select(
            "want", "want_type", "match_count",
            F.col("pick.best.id").alias("entity_id"),
            F.col("pick.name").alias("entity_name"),
            F.col("pick.entity_type").alias("resolved_type"),
            F.col("pick.tier").alias("tier"),
        )
    )
    joined = requests.join(
        chosen,
        (requests["name"] == chosen["want"])
        & requests["entity_type"].eqNullSafe(chosen["want_type"]),
        "left",
    ).drop("want", "want_type")
    status = (
        F.when(F.col("entity_id").isNull(), "not_found")
        .when(F.col("match_count") > 1, "ambiguous")
        .otherwise("ok")
    )
    return joined.withColumns(
        {"match_count": F.coalesce("match_count", F.lit(0)), "status": status}
    )


def suggest_names(
    g: Graph, misses: DataFrame, k: int = 5, index: TextIndex | None = None, grams: GramIndex | None = None
) -> DataFrame:
    """Up to ``k`` entity names for each unresolved ``misses(request_id, name)``.

    The best ``k`` entities of a full-text search over name, description and type come first, a name once, at the rank
    of its best entity. A request without a hit falls back to the first ``k`` names that contain it. Only
    distinct requests are searched; ``index`` and ``grams`` are stored indexes of the same entities.
    """
    wanted = cut(misses.select(F.col("name").alias("want")).distinct())
    index = build_text_index(entity_documents(g)) if index is None else index
    asked = wanted.select(F.col("want").alias("query_id"), F.col("want").alias("text"))
    hits = sized(bm25_topk(asked, index, k).select(F.col("query_id").alias("want"), "id", "rank"))
    named = g.entities.select("id", F.col("name").alias("suggestion")).join(hits, "id")
    best = named.groupBy("want", "suggestion").agg(F.min("rank").alias("rank"))
    unmatched = cut(wanted.join(hits.select("want").distinct(), "want", "left_anti"))
    if not unmatched.isEmpty():
        grams = build_gram_index(g, ["name"]) if grams is None else grams
        best = best.unionByName(first_names(grams, unmatched, k).withColumnRenamed("name", "suggestion"))
    return misses.select("request_id", "name").join(best, F.col("name") == F.col("want")).drop("want")


def ambiguous_names(g: Graph) -> DataFrame:
    """Names, in any case, that belong to more than one entity."""
    return (
        g.entities.groupBy("graph_id", nocase(F.col("name")).alias("folded_name"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
        )
        .filter("n > 1")
    )
