"""Counts, distributions, degrees, health and audit."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import blank, props_map
from knotwork.model import Graph
from knotwork.operators.relations import recent_first, topk_with_flag, total_of
from knotwork.session import packed

#: Thresholds of the health report's suggested actions (fixed values).
MANY_ENTITIES = 500
HOTSPOT_OBSERVATIONS = 15
MANY_OBSERVATIONS_PER_ENTITY = 10


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def graph_counts(g: Graph) -> DataFrame:
    """``(table, n)`` for the three tables."""
    rows = [
        df.agg(count_rows("n")).select(F.lit(name).alias("table"), "n")
        for name, df in g.tables().items()
        if not name.endswith("embeddings")
    ]
    return functools.reduce(DataFrame.unionAll, rows)


def observation_counts(g: Graph) -> DataFrame:
    return g.observations.groupBy("entity_id").agg(count_rows("observation_count"))


def graph_catalog(g: Graph) -> DataFrame:
    """Named graphs with their three row counts."""
    tagged = functools.reduce(
        DataFrame.unionAll,
        [
            df.select("graph_id", F.lit(name).alias("t"))
            for name, df in g.tables().items()
            if not name.endswith("embeddings")
        ],
    )
    n = lambda t: F.count(F.when(F.col("t") == t, 1)).alias(t)
    return tagged.groupBy("graph_id").agg(n("entities"), n("relationships"), n("observations"))


def type_distribution(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(count_rows("n")).orderBy(F.desc("n"), column)
    return out if k is None else out.limit(k)


def degrees(g: Graph) -> DataFrame:
    """Edge ends per entity: isolated entities have 0, a self-loop counts twice."""
    ends = g.relationships.select(F.col("source_id").alias("id")).unionAll(
        g.relationships.select("target_id")
    )
    counted = ends.groupBy("id").agg(count_rows("degree"))
    return g.entities.select("id", "name", "entity_type").join(counted, "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )


def most_connected(g: Graph, k: int = 10) -> DataFrame:
    """Top ``k`` by degree, then name; each task keeps ``k`` rows only."""
    return degrees(g).orderBy(F.desc("degree"), "name", "id").limit(k)


def undirected_pairs(g: Graph) -> DataFrame:
    """Simple undirected edges ``(a, b)``: parallel and reversed edges collapse."""
    return g.relationships.select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    ).distinct()


def undirected_degrees(g: Graph) -> DataFrame:
    """Degree in the simple undirected graph; a self-loop adds 2."""
    pairs = undirected_pairs(g)
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))
    counted = ends.groupBy("id").agg(count_rows("degree"))
    return g.entities.select("id", "name").join(counted, "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )


def neighbours(g: Graph) -> DataFrame:
    """Distinct ``(id, neighbour_id)`` rows, one per member of each neighbour set."""
    pairs = undirected_pairs(g)
    return pairs.toDF("id", "neighbour_id").unionAll(
        pairs.filter("a <> b").select(F.col("b"), F.col("a"))
    )


def graph_density(g: Graph) -> DataFrame:
    """One row: nodes, simple edges, density and the largest simple degree."""
    by_node = undirected_degrees(g).agg(
        count_rows("nodes"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        (F.sum("degree") / 2).cast("long").alias("edges"),
    )
    n = F.col("nodes").cast("double")
    return by_node.withColumn(
        "density", F.when(n < 2, F.lit(0.0)).otherwise(F.col("edges") / (n * (n - 1) / 2))
    )


def recent_entities(g: Graph, k: int = 10) -> DataFrame:
    return g.entities.orderBy(*recent_first()).limit(k)


def entities_by_type(g: Graph) -> DataFrame:
    """Entities in display order (type, name, id) with the size of their type.

    One row per entity, range-sorted: a type that holds most of the graph spreads over many tasks,
    which one array per type would not.
    """
    sizes = g.entities.groupBy("entity_type").agg(count_rows("type_size"))
    rows = g.entities.select("entity_type", "name", "id")
    return rows.join(sizes, "entity_type").orderBy("entity_type", "name", "id")


def _section(df: DataFrame, section: str, key: Column, value: Column, order: list[Column]) -> DataFrame:
    """Small top-k frame as ``(section, rank, key, value)`` rows."""
    rank = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order))
    return df.select(
        F.lit(section).alias("section"), rank.cast("int").alias("rank"),
        key.cast("string").alias("key"), value.cast("string").alias("value"),
    )


def _count_section(g: Graph) -> DataFrame:
    return _section(graph_counts(g), "counts", F.col("table"), F.col("n"), [F.col("table")])


def _types_section(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    top = type_distribution(df, column, k)
    return _section(
        top, column + "s", F.col(column), F.col("n"), [F.desc("n"), F.col(column).asc()]
    )


def graph_summary(g: Graph, k: int = 10) -> DataFrame:
    """Counts, type distributions, most connected and most recent entities, in long form."""
    connected = most_connected(g, k)
    recent = recent_entities(g, k)
    parts = [
        _count_section(g),
        _types_section(g.entities, "entity_type"),
        _types_section(g.relationships, "relationship_type"),
        _section(
            connected, "most_connected", F.col("id"), F.col("degree"),
            [F.desc("degree"), F.col("name").asc(), F.col("id").asc()],
        ),
        _section(recent, "recent", F.col("id"), F.col("name"), recent_first()),
    ]
    return functools.reduce(DataFrame.unionAll, parts)


def hotspots(g: Graph, k: int = 5) -> DataFrame:
    """Entities with the most observations."""
    counted = observation_counts(g).withColumnRenamed("entity_id", "id")
    return (
        g.entities.select("id", "name", "entity_type")
        .join(counted, "id")
        .orderBy(F.desc("observation_count"), "id")
        .limit(k)
    )


def health_actions(g: Graph) -> DataFrame:
    """Suggested actions, ``(section, rank, key, value)``, from a one-row frame of metrics."""
    undescribed = g.entities.filter("coalesce(description, '') = ''")
    top = hotspots(g, 1)
    metrics = g.entities.agg(count_rows("entities")).withColumns(
        {
            "observations": total_of(g.observations),
            "undescribed": total_of(undescribed),
            "hot_name": top.agg(F.first("name")).scalar(),
            "hot_count": top.agg(F.first("observation_count")).scalar(),
        }
    )
    mean = F.col("observations") / F.nullif(F.col("entities"), F.lit(0))
    share = F.col("undescribed") / F.nullif(F.col("entities"), F.lit(0))
    actions = F.array(
        F.when(F.col("entities") > MANY_ENTITIES, F.struct(
            F.lit("prune_entities").alias("key"), F.col("entities").cast("string").alias("value"))),
        F.when(F.col("hot_count") > HOTSPOT_OBSERVATIONS, F.struct(
            F.lit("compact_observations").alias("key"),
            F.concat_ws("=", "hot_name", "hot_count").alias("value"))),
        F.when(F.col("undescribed") > 0, F.struct(
            F.lit("add_descriptions").alias("key"),
            F.col("undescribed").cast("string").alias("value"))),
        F.when(mean > MANY_OBSERVATIONS_PER_ENTITY, F.struct(
            F.lit("consolidate_observations").alias("key"),
            F.format_string("%.1f", mean).alias("value"))),
        F.when(share > 0.1, F.struct(
            F.lit("describe_many").alias("key"),
            F.format_string("%.1f", share * 100).alias("value"))),
    )
    return (
        metrics.select(F.posexplode(F.filter(actions, lambda a: a.isNotNull())))
        .select(
            F.lit("actions").alias("section"), (F.col("pos") + 1).alias("rank"),
            F.col("col.key").alias("key"), F.col("col.value").alias("value"),
        )
    )


def graph_health(g: Graph) -> DataFrame:
    """Counts, top types, observation hotspots, undescribed entities and suggested actions."""
    undescribed = g.entities.filter("coalesce(description, '') = ''")
    parts = [
        _count_section(g),
        _types_section(g.entities, "entity_type"),
        _section(
            hotspots(g), "hotspots", F.col("id"), F.col("observation_count"),
            [F.desc("observation_count"), F.col("id").asc()],
        ),
        _section(
            undescribed.orderBy(*recent_first()).limit(10), "missing_descriptions",
            F.col("id"), F.col("name"), recent_first(),
        ),
        _section(
            undescribed.agg(count_rows("n")), "missing_description_count",
            F.lit("n"), F.col("n"), [F.col("n").asc()],
        ),
        health_actions(g),
    ]
    return functools.reduce(DataFrame.unionAll, parts)


FLAGS = (
    "disconnected", "missing_description", "missing_observations", "empty_properties",
    "low_connection",
)


def audit_entities(g: Graph, scan_limit: int | None = None) -> DataFrame:
    """Per entity: edge count (self-loop once), observation count and the five quality flags."""
    rows = g.entities
    if scan_limit is not None:
        rows = rows.orderBy("entity_type", "name", "id").limit(scan_limit)
    # Both ends of an edge are made as it is read: edges are gone through once.
    apart = F.col("source_id") != F.col("target_id")
    ends = F.when(apart, F.array("source_id", "target_id")).otherwise(F.array("source_id"))
    edges = g.relationships.select(F.explode(ends).alias("id")).groupBy("id").agg(count_rows("rel_count"))
    facts = observation_counts(g).select(F.col("entity_id").alias("id"), F.col("observation_count").alias("obs_count"))
    return (
        rows.join(edges, "id", "left")
        .join(facts, "id", "left")
        .withColumns(
            {
                "rel_count": F.coalesce("rel_count", F.lit(0)),
                "obs_count": F.coalesce("obs_count", F.lit(0)),
            }
        )
        .select(
            "graph_id", "id", "name", "entity_type", "rel_count", "obs_count",
            (F.col("rel_count") == 0).alias("disconnected"),
            blank(F.col("description")).alias("missing_description"),
            (F.col("obs_count") == 0).alias("missing_observations"),
            (F.size(props_map(F.col("properties"))) == 0).alias("empty_properties"),
            (F.col("rel_count") == 1).alias("low_connection"),
        )
    )


def audit_summary(flags: DataFrame) -> DataFrame:
    """One row: offenders per category and the quality score in percent."""
    sums = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in FLAGS]
    out = flags.agg(count_rows("scanned"), *sums)
    issues = functools.reduce(Column.__add__, [F.col(c) for c in FLAGS[:4]])
    score = F.when(F.col("scanned") == 0, F.lit(100.0)).otherwise(
        F.round(100 * (1 - issues / (F.col("scanned") * 4)), 1)
    )
    return out.withColumn("quality_score", score)


def audit_offenders(flags: DataFrame, k: int = 30) -> DataFrame:
    """First ``k`` offenders of each category by type and name, with the category's size.

    Offenders are written packed: choosing and counting them does not flag all entities twice.
    """
    some = functools.reduce(Column.__or__, [F.col(c) for c in FLAGS])
    flags = packed(flags.filter(some).select("id", "name", "entity_type", *FLAGS))
    categories = F.filter(
        F.array(*[F.when(F.col(c), F.lit(c)) for c in FLAGS]), lambda c: c.isNotNull()
    )
    rows = flags.select(
        F.explode(categories).alias("category"), "id", "name", "entity_type"
    )
    order = [F.col("entity_type").asc(), F.col("name").asc(), F.col("id").asc()]
    return topk_with_flag(rows, ["category"], order, k)
