"""Listing, lookup, enrichment, integrity and profile operators over the three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import blank, nocase, norm_type, strip
from knotwork.model import Graph
from knotwork.session import cut, shuffle_partitions, sized


def recent_first() -> list[Column]:
    return [F.col("updated_at").desc(), F.col("id").asc()]


def heaviest_first() -> list[Column]:
    return [F.col("weight").desc(), F.col("updated_at").desc(), F.col("id").asc()]


def _type_list(types) -> list[str]:
    """Normalised, non-empty type names; an empty list means no filter."""
    return [t.strip().lower() for t in (types or []) if t and t.strip()]


def of_types(df: DataFrame, types, column: str = "entity_type") -> DataFrame:
    wanted = _type_list(types)
    return df.filter(F.col(column).isin(wanted)) if wanted else df


def total_of(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


#: Rows up to this place in an order are found by one heap per task; what lies deeper, by ranges.
HEAP_ROWS = 10_000


def page_of(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in a total order, however deep or many.

    A deep or open page sorts by range, counts the rows of each range and keeps whole ranges; only the
    two ranges that its ends fall into are cut, so no task holds more than a range.
    """
    if limit is not None and offset + limit <= HEAP_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    if limit is None and not offset:
        return df
    parts = shuffle_partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    end = offset + limit if limit is not None else sum(r.n for r in sizes)
    out, seen, whole = ranged.limit(0), 0, []
    for row in sizes:  # one row per range
        lo, hi = max(offset - seen, 0), min(end - seen, row.n)
        seen += row.n
        if lo == 0 and hi == row.n:
            whole.append(row["_range"])
        elif lo < hi:
            inside = ranged.filter(F.col("_range") == row["_range"]).orderBy(*order)
            out = out.unionAll(inside.offset(lo).limit(hi - lo))
    return out.unionAll(ranged.filter(F.col("_range").isin(whole))).drop("_range")


def topk_with_flag(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Best ``k`` rows per group with ``rank``, the group's ``total`` and a ``truncated`` flag.

    The rank filter stands alone over its window, so each partition drops all but ``k`` rows of a
    group before the shuffle; the totals come from a map-side combined count.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    best = df.withColumn("rank", rank).filter(F.col("rank") <= k)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    return best.join(totals, by).withColumn("truncated", F.col("total") > k)


def list_entities(g: Graph, entity_type=None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Newest first page of entities with the filtered ``total``."""
    rows = of_types(g.entities, [entity_type] if entity_type else None)
    return page_of(rows, recent_first(), limit, offset).withColumn("total", total_of(rows))


def with_names(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """Edges with the name and type of both ends."""
    edges = g.relationships if edges is None else edges
    ends = g.entities.select("id", "name", "entity_type")
    source = ends.toDF("source_id", "source_name", "source_type")
    target = ends.toDF("target_id", "target_name", "target_type")
    return edges.join(source, "source_id").join(target, "target_id")


def touching(
    edges: DataFrame, ids: DataFrame, direction: str = "both", types=None
) -> DataFrame:
    """Edges with an end in ``ids(id)``: columns of the edge plus ``entity_id`` and ``direction``.

    One equi join per side; the incoming side leaves out self-loops, so each appears once.
    """
    if direction not in ("both", "outgoing", "incoming"):
        raise ValueError(f"unknown direction {direction!r}")
    edges = of_types(edges, types, "relationship_type")
    wanted = sized(ids.select(F.col("id").alias("entity_id")).distinct())
    out = edges.withColumn("entity_id", F.col("source_id")).join(wanted, "entity_id")
    out = out.withColumn("direction", F.lit("outgoing"))
    loops_out = edges if direction == "incoming" else edges.filter("source_id <> target_id")
    back = loops_out.withColumn("entity_id", F.col("target_id")).join(wanted, "entity_id")
    back = back.withColumn("direction", F.lit("incoming"))
    if direction == "outgoing":
        return out
    return back if direction == "incoming" else out.unionByName(back)


def relationships_of(g: Graph, ids: DataFrame, direction: str = "both", types=None) -> DataFrame:
    return with_names(g, touching(g.relationships, ids, direction, types))


def list_relationships(
    g: Graph,
    ids: DataFrame | None = None,
    relationship_type: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """Page of edges, newest first; heaviest first when scoped to entities ``ids(id)``."""
    kinds = [relationship_type] if relationship_type else None
    if ids is None:
        rows, order = of_types(g.relationships, kinds, "relationship_type"), recent_first()
    else:
        rows, order = touching(g.relationships, ids, "both", kinds), heaviest_first()
    return with_names(g, page_of(rows, order, limit, offset)).withColumn("total", total_of(rows))


def induced_edges(g: Graph, ids: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Edges whose two ends are both in ``ids(id)``."""
    edges = g.relationships if edges is None else edges
    wanted = sized(ids.select("id").distinct())
    return edges.join(wanted.toDF("source_id"), "source_id", "left_semi").join(
        wanted.toDF("target_id"), "target_id", "left_semi"
    )


def graph_view(g: Graph, types=None, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Newest entities of the chosen types and the edges among them.

    Both frames carry the unfiltered totals; ``left_out`` counts the matching entities not shown.
    """
    matching = of_types(g.entities, types)
    nodes = matching.orderBy(*recent_first()).limit(limit)
    totals = {
        "total_entities": total_of(g.entities),
        "total_relationships": total_of(g.relationships),
    }
    left_out = F.greatest(total_of(matching) - F.lit(limit), F.lit(0))
    edges = with_names(g, induced_edges(g, nodes))
    return nodes.withColumns({**totals, "left_out": left_out}), edges.withColumns(totals)


def name_contains(g: Graph, text: str, limit: int | None = 20, in_type: bool = True) -> DataFrame:
    """Case-insensitive substring search in names (and types); ``%`` and ``_`` are plain text."""
    needle = F.lower(F.lit(text))
    hit = F.lower("name").contains(needle)
    if in_type:
        hit = hit | F.lower("entity_type").contains(needle)
    rows = g.entities.filter(hit).orderBy("name", "id")
    return rows if limit is None else rows.limit(limit)


def screen_batch(batch: DataFrame) -> DataFrame:
    """Which added entities lack a description or observations (array column)."""
    return batch.select(
        "name",
        "entity_type",
        (F.coalesce("description", F.lit("")) == "").alias("missing_description"),
        (F.coalesce(F.size("observations"), F.lit(0)) <= 0).alias("missing_observations"),
    ).filter("missing_description or missing_observations")


def lookup(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids(id)``."""
    return df.join(sized(ids.select(F.col("id").alias(column)).distinct()), column, "left_semi")


def lookup_edges(g: Graph, keys: DataFrame) -> DataFrame:
    """Edges by their ``(source_id, target_id, relationship_type)`` key."""
    keys = keys.withColumn("relationship_type", norm_type(F.col("relationship_type")))
    on = ["source_id", "target_id", "relationship_type"]
    return g.relationships.join(sized(keys.select(*on).distinct()), on, "left_semi")


def observations_of(g: Graph, ids: DataFrame, per_entity_limit: int | None = None) -> DataFrame:
    """Observations of the entities ``ids(id)``, newest first, with owner name and type."""
    rows = lookup(g.observations, ids, "entity_id")
    newest = [F.col("created_at").desc(), F.col("id").asc()]
    if per_entity_limit is not None:
        rows = topk_with_flag(rows, ["entity_id"], newest, per_entity_limit)
    owner = g.entities.select(
        F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "entity_type"
    )
    return rows.join(owner, "entity_id")


def owned(g: Graph, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``requests(observation_id, entity_id, …)`` into owned rows and misses."""
    on = ["observation_id", "entity_id"]
    keys = g.observations.select(F.col("id").alias("observation_id"), "entity_id")
    keys = cut(keys.join(sized(requests.select(*on).distinct()), on, "left_semi"))
    return requests.join(keys, on, "left_semi"), requests.join(keys, on, "left_anti")


def find_orphans(g: Graph) -> DataFrame:
    """Edges and observations that point at entities which do not exist."""
    known = g.entities.select("id")

    def missing(df, table, column):
        gone = df.join(known.toDF(column), column, "left_anti")
        return gone.select(
            F.lit(table).alias("table"), "id", F.lit(column).alias("column"),
            F.col(column).alias("missing_id"),
        )

    return (
        missing(g.relationships, "relationships", "source_id")
        .unionAll(missing(g.relationships, "relationships", "target_id"))
        .unionAll(missing(g.observations, "observations", "entity_id"))
    )


def find_duplicate_keys(g: Graph) -> DataFrame:
    """Unique-key violations: entities by (folded name, type), edges by (source, target, type)."""
    entities = g.entities.groupBy(
        "graph_id", nocase(F.col("name")).alias("key1"), F.col("entity_type").alias("key2")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    edges = g.relationships.groupBy("graph_id", "source_id", "target_id", "relationship_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    )
    edges = edges.select(
        "graph_id", F.concat_ws("|", "source_id", "target_id").alias("key1"),
        F.col("relationship_type").alias("key2"), "n", "first_id",
    )
    return (
        entities.withColumn("table", F.lit("entities"))
        .unionAll(edges.withColumn("table", F.lit("relationships")))
        .filter("n > 1")
    )


def nested_edges(g: Graph, ids: DataFrame, cap: int) -> DataFrame:
    """Per entity: its heaviest ``cap`` edges as an array, the true count and the cut flag.

    The cap is taken on ids alone and names are attached to what is left; at most ``cap`` rows of
    an entity ever meet in one task.
    """
    best = topk_with_flag(touching(g.relationships, ids), ["entity_id"], heaviest_first(), cap)
    other = F.when(F.col("direction") == "outgoing", F.col("target_id")).otherwise(
        F.col("source_id")
    )
    names = g.entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    item = F.struct(
        "rank", "relationship_type", "direction",
        F.col("other_name").alias("connected_entity"), "weight",
    )
    return (
        best.withColumn("other_id", other)
        .join(names, "other_id")
        .groupBy("entity_id")
        .agg(
            F.array_sort(F.collect_list(item)).alias("relationships"),
            F.max("total").alias("relationship_count"),
            F.max("truncated").alias("relationships_truncated"),
        )
    )


def nested_observations(g: Graph, ids: DataFrame, cap: int) -> DataFrame:
    """Per entity: its newest ``cap`` observations as an array, the true count and the cut flag."""
    rows = lookup(g.observations, ids, "entity_id")
    newest = [F.col("created_at").desc(), F.col("id").asc()]
    item = F.struct("rank", "id", "content", "source", "created_at")
    return (
        topk_with_flag(rows, ["entity_id"], newest, cap)
        .groupBy("entity_id")
        .agg(
            F.array_sort(F.collect_list(item)).alias("observations"),
            F.max("total").alias("observation_count"),
            F.max("truncated").alias("observations_truncated"),
        )
    )


def entity_profiles(g: Graph, requests: DataFrame, cap: int = 50) -> DataFrame:
    """Profile per resolved request: the entity, capped nested lists and the true counts."""
    from knotwork.operators.resolve import resolve_names

    resolved = resolve_names(g.entities, requests)
    ids = resolved.filter("entity_id is not null").select(F.col("entity_id").alias("id")).distinct()
    profile = (
        lookup(g.entities, ids)
        .withColumnRenamed("id", "entity_id")
        .join(nested_edges(g, ids, cap), "entity_id", "left")
        .join(nested_observations(g, ids, cap), "entity_id", "left")
        .withColumns(
            {
                "relationship_count": F.coalesce("relationship_count", F.lit(0)),
                "observation_count": F.coalesce("observation_count", F.lit(0)),
                "relationships_truncated": F.coalesce("relationships_truncated", F.lit(False)),
                "observations_truncated": F.coalesce("observations_truncated", F.lit(False)),
            }
        )
    )
    return resolved.select("request_id", "entity_id", "status", "match_count").join(
        profile, "entity_id", "left"
    )


# --- validation -----------------------------------------------------------------------------


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def _optional(df: DataFrame, **defaults) -> DataFrame:
    """Fill in the columns a request may leave out."""
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def reject_unknown_columns(df: DataFrame, allowed: str) -> None:
    """Misspelt fields must not be dropped silently; the error names them."""
    unknown = sorted(set(df.columns) - set(allowed.split()))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")


def validate_entities(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalise entity requests; rows with an empty name or type go to the rejected frame."""
    df = _optional(df, description=F.lit(""), properties=F.lit("{}"))
    df = df.withColumns(
        {
            "name": strip(F.col("name")),
            "entity_type": norm_type(F.col("entity_type")),
            "description": F.coalesce("description", F.lit("")),
            "properties": F.coalesce("properties", F.lit("{}")),
        }
    )
    reason = F.when(blank(F.col("name")), "name is empty").when(
        blank(F.col("entity_type")), "entity_type is empty"
    )
    return _split(df, reason)


def validate_relationships(df: DataFrame, ends=("source_id", "target_id")) -> tuple[DataFrame, DataFrame]:
    """Normalise edge requests: ends and type non-empty, weight in [0, 1] and 1.0 by default."""
    df = _optional(df, weight=F.lit(1.0), properties=F.lit("{}"))
    df = df.withColumns(
        {
            **{end: strip(F.col(end)) for end in ends},
            "relationship_type": norm_type(F.col("relationship_type")),
            "weight": F.coalesce(F.col("weight").cast("double"), F.lit(1.0)),
            "properties": F.coalesce("properties", F.lit("{}")),
        }
    )
    reason = (
        F.when(blank(F.col(ends[0])), f"{ends[0]} is empty")
        .when(blank(F.col(ends[1])), f"{ends[1]} is empty")
        .when(blank(F.col("relationship_type")), "relationship_type is empty")
        .when(~F.col("weight").between(0.0, 1.0) | F.isnan("weight"), "weight is outside [0, 1]")
    )
    return _split(df, reason)


def validate_observations(df: DataFrame, owner: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """Normalise observation requests: content and owner non-empty."""
    df = _optional(df, source=F.lit(""))
    df = df.withColumns(
        {"content": strip(F.col("content")), "source": F.coalesce("source", F.lit(""))}
    )
    reason = F.when(blank(F.col("content")), "content is empty").when(
        blank(F.col(owner)), f"{owner} is empty"
    )
    return _split(df, reason)
