"""Continuous ingest: micro-batches of records applied with the batch merge rules."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from knotwork.functions.scalars import strip
from knotwork.model import Graph
from knotwork.operators.mutate import EDGE_KEY, ends_of, new_observations, owners_of, upsert_entities, upsert_relationships
from knotwork.session import cut, packed
from knotwork.sources.tables import (
    BUCKETS,
    StaleSnapshot,
    buckets_of,
    check_graph_id,
    load_graph,
    read_manifest,
    read_text,
    save_graph,
)

#: One record of any kind; ``kind`` is entity, relationship or observation.
RECORD = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("relationship_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("content", T.StringType()),
    ]
)


#: Table each kind of record goes to.
TABLE_OF = {"entity": "entities", "relationship": "relationships", "observation": "observations"}


#: How often a batch starts over because other writers were faster.
ATTEMPTS = 100


def apply_records(
    g: Graph,
    records: DataFrame,
    now,
    graph_id: str = "main",
    near: Callable[[str, DataFrame], DataFrame] | None = None,
) -> tuple[Graph, DataFrame, DataFrame]:
    """Entities first, then edges and observations by entity name.

    Returns the graph with its entities and edges, the added observations by themselves, and the
    statuses. Tables the records do not concern are passed on as they are. ``near(table, keys)`` may give
    the rows of edges or observations that can have one of the keys, once the names are resolved.
    """
    kinds = {r.kind for r in records.select("kind").distinct().filter(F.col("kind").isin(*TABLE_OF)).collect()}
    of = lambda kind, *columns: records.filter(F.col("kind") == kind).select(
        "request_id", "seq", *columns
    )
    fresh, statuses = g.observations.limit(0), []
    if "entity" in kinds:
        g, status = upsert_entities(g, of("entity", "name", "entity_type", "description", "properties"), now, graph_id)
        g = g.replace(entities=packed(g.entities))
        statuses.append(status)
    if "relationship" in kinds:
        edges = of("relationship", "source", "target", "relationship_type", "weight", "properties")
        if near is not None:
            g = g.replace(relationships=near("relationships", ends_of(g, edges, graph_id).select(*EDGE_KEY)))
        g, status = upsert_relationships(g, edges, now, graph_id)
        statuses.append(status)
    if "observation" in kinds:
        facts = of("observation", F.col("name").alias("entity_name"), "content", "source")
        if near is not None:
            g = g.replace(observations=near("observations", owners_of(g, facts, graph_id).select("entity_id")))
        fresh, status = new_observations(g, facts, now, graph_id)
        statuses.append(status)
    shown = [s.select("request_id", "seq", "status", "reason") for s in statuses]
    none = records.select("request_id", "seq", F.lit("").alias("status"), F.lit("").alias("reason")).limit(0)
    return g, fresh, functools.reduce(DataFrame.unionByName, shown, none)


def _names(records: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """The names that records of some kinds hold, as given and without the white space around them."""
    found = [records.filter(F.col("kind") == kind).select(F.col(c).alias("name")) for kind, cs in columns.items() for c in cs]
    names = functools.reduce(DataFrame.unionAll, found).filter("name is not null")
    return names.unionAll(names.select(strip(F.col("name")))).distinct()


def _write_batch(records: DataFrame, store: str, stream: str, number: int, now, graph_id: str) -> None:
    """Write what one micro-batch changes, reading and replacing only the buckets that its records fall into.

    Of observations the added rows are written only.
    """
    spark = records.sparkSession
    manifest = read_manifest(spark, store)
    count = manifest["buckets"] if manifest else BUCKETS
    named = {"entity": ["name"], "relationship": ["source", "target"], "observation": ["name"]}
    touched = {"entities": buckets_of("entities", _names(records, {"entity": ["name"]}), count)}
    read = {"entities": buckets_of("entities", _names(records, named), count)}
    nothing = dict.fromkeys(("relationships", "observations", "entity_embeddings", "observation_embeddings"), frozenset())
    before = load_graph(spark, store, only=nothing | read)

    def near(table: str, keys: DataFrame) -> DataFrame:
        touched[table] = buckets_of(table, keys, count)
        return getattr(load_graph(spark, store, only=nothing | {"entities": frozenset(), table: touched[table]}), table)

    after, fresh, status = apply_records(before, records, now, graph_id, near)
    changed = {name for name in ("entities", "relationships") if touched.get(name)}
    version = f"{stream}-{number}"
    status.write.mode("overwrite").parquet(f"{store}/status/{version}")
    save_graph(after, store, version, changed, {"observations": fresh}, (stream, number), touched)


def stream_id(spark, checkpoint: str) -> str:
    """The id that Spark gave the stream when it made the checkpoint."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def ingest_stream(
    stream: DataFrame, store: str, checkpoint: str, now, graph_id: str = "main", **trigger
) -> StreamingQuery:
    """Apply a stream of ``RECORD`` rows to the snapshots in ``store``, whoever wrote them.

    Every micro-batch writes a snapshot named after its stream and number, and the manifest last. The
    manifest holds the last batch of every stream: a batch that is replayed after a failure finds
    itself there and does nothing, or starts from the snapshot before it; either way its rows count
    once, and streams with checkpoints of their own do not hide one another's batches. Of two streams
    that finish a batch at the same time one fails and goes on from its checkpoint when restarted.
    ``now`` maps a batch number to its time.
    """
    check_graph_id(graph_id)

    def apply(batch: DataFrame, number: int) -> None:
        spark, records = batch.sparkSession, None
        own = stream_id(spark, checkpoint)
        for attempt in range(ATTEMPTS):
            done = read_manifest(spark, store)
            if done is not None and done["streams"].get(own, -1) >= number:
                return
            records = cut(batch) if records is None else records
            try:
                return _write_batch(records, store, own, number, now(number), graph_id)
            except StaleSnapshot:
                if attempt + 1 == ATTEMPTS:
                    raise

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
