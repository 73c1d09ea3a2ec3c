"""Batch mutations: the tables and a batch of requests give the next tables and a status per request.

Requests carry ``request_id`` and ``seq``; a batch has the effect of its requests one at a time in
``seq`` order. Names are resolved against the tables as they are before the batch. ``now`` is the
time stamped on what changes, given by the caller so that a repeated job writes the same rows.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import (
    append_text,
    new_id,
    nocase,
    norm_type,
    overlay_props,
    props_json,
    props_map,
    strip,
)
from knotwork.model import ENTITY, OBSERVATION, RELATIONSHIP, Graph
from knotwork.operators.relations import (
    reject_unknown_columns,
    screen_batch,
    validate_entities,
    validate_observations,
    validate_relationships,
)
from knotwork.operators.resolve import resolve_names
from knotwork.session import cut, packed, sized

#: Fields a request may have.
ENTITY_FIELDS = "request_id seq id name entity_type description properties observations"
EDGE_FIELDS = "request_id seq id source target source_id target_id relationship_type weight properties"
FACT_FIELDS = "request_id seq id entity_name entity_id content source"

EDGE_KEY = ["source_id", "target_id", "relationship_type"]


def _stamp(now) -> Column:
    return F.lit(now).cast("timestamp")


def _with(df: DataFrame, **defaults: Column) -> DataFrame:
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _fold_props(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Overlay the ``properties`` of each key's rows in order, as ``new_properties``.

    Where a key has several rows, the last value of every single property is picked by an aggregate
    that combines map-side, so a key with very many rows is never gathered; only its distinct property
    names are. Keys with one row, the usual case, keep what they have.
    """
    filled = rows.filter(F.size(props_map(F.col("properties"))) > 0).select(*keys, order, "properties")
    counted = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("properties").alias("properties"))
    single = counted.filter("n = 1").select(
        *keys, props_json(props_map(F.col("properties"))).alias("new_properties")
    )
    several = filled.join(sized(counted.filter("n > 1").select(*keys)), keys, "left_semi")
    last = (
        several.select(*keys, order, F.explode(props_map(F.col("properties"))).alias("k", "v"))
        .groupBy(*keys, "k")
        .agg(F.max_by(F.to_json(F.col("v")), order).alias("v"))
    )
    entries = F.array_sort(F.collect_list(F.struct("k", "v")))
    parsed = F.transform_values(F.map_from_entries(entries), lambda _, v: F.parse_json(v))
    folded = last.groupBy(*keys).agg(F.to_json(parsed).alias("new_properties"))
    return single.unionByName(folded)


def _overlay(old: Column, new: Column) -> Column:
    return F.when(new.isNull(), old).when(old == "{}", new).otherwise(overlay_props(old, new))


def within(g: Graph, graph_id: str | None) -> Graph:
    """What a request for one named graph may see of entities and edges; None is all graphs."""
    if graph_id is None:
        return g
    own = F.col("graph_id") == graph_id
    return g.replace(entities=g.entities.filter(own), relationships=g.relationships.filter(own))


def _resolve_column(g: Graph, requests: DataFrame, name: str, out: str, type_column: str | None = None) -> DataFrame:
    """Add the id that the names in column ``name`` resolve to; distinct names are resolved once."""
    asked = requests.select(
        F.col(name).alias("name"),
        *([F.col(type_column).alias("entity_type")] if type_column else []),
    ).distinct()
    asked = asked.withColumn("request_id", F.lit(""))
    found = resolve_names(g.entities, asked)
    if type_column:
        right = found.select(
            F.col("name").alias("_name"), F.col("entity_type").alias("_type"), F.col("entity_id").alias(out)
        )
        on = (requests[name] == right["_name"]) & requests[type_column].eqNullSafe(right["_type"])
        return requests.join(right, on, "left").drop("_name", "_type")
    right = found.select(F.col("name").alias("_name"), F.col("entity_id").alias(out))
    return requests.join(right, requests[name] == right["_name"], "left").drop("_name")


def _left_and_new(table: DataFrame, incoming: DataFrame, key: list[str], present: DataFrame) -> DataFrame:
    """A full outer join that leaves the table in place when ``incoming`` is small enough to broadcast.

    Rows of the table take up their incoming part; incoming keys that are not ``present`` follow as new rows.
    """
    kept = table.join(incoming, key, "left")
    fresh = incoming.join(present, key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


# --- upserts --------------------------------------------------------------------------------


def upsert_entities(g: Graph, batch: DataFrame, now, graph_id: str = "main") -> tuple[Graph, DataFrame]:
    """Add or merge ``batch(request_id, seq, name, entity_type[, description, properties, id])``.

    Rows meet on the name in any case and the type. The first keeps id, name and creation time;
    descriptions are appended unless already contained; later properties win. Status: created,
    merged or rejected, with the surviving id.
    """
    reject_unknown_columns(batch, ENTITY_FIELDS)
    good, bad = validate_entities(batch)
    good = packed(_with(good, id=F.lit(None).cast("string")).withColumn("folded", nocase(F.col("name"))))
    key = ["folded", "entity_type"]
    texts = good.groupBy(*key, "description").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("name", "id"), "seq").alias("head")
    )
    incoming = texts.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("seq", "description"))).alias("texts"),
        F.min_by("head", "seq").alias("head"),
        F.min("seq").alias("first_seq"),
    )
    incoming = sized(incoming.join(_fold_props(good, key), key, "left"))
    here = g.entities.filter(F.col("graph_id") == graph_id)
    elsewhere = g.entities.filter(F.col("graph_id") != graph_id)
    old = here.withColumn("folded", nocase(F.col("name")))
    matched = packed(old.join(incoming.select(*key), key, "left_semi").select(*key, F.col("id").alias("old_id")))
    both = _left_and_new(old, incoming, key, matched.select(*key))
    is_old, touched = F.col("id").isNotNull(), F.col("first_seq").isNotNull()
    fresh_id = F.coalesce("head.id", new_id(F.lit(graph_id), F.col("folded"), F.col("entity_type")))
    base = F.when(is_old, F.coalesce("description", F.lit(""))).otherwise(F.col("texts")[0]["description"])
    rest = F.when(is_old, F.col("texts")).otherwise(F.slice("texts", 2, F.greatest(F.size("texts"), F.lit(1))))
    text = F.aggregate(rest, base, lambda acc, t: append_text(acc, t["description"]))
    stamp = _stamp(now)
    merged = both.select(
        F.lit(graph_id).alias("graph_id"),
        F.when(is_old, F.col("id")).otherwise(fresh_id).alias("id"),
        F.when(is_old, F.col("name")).otherwise(F.col("head.name")).alias("name"),
        "entity_type",
        F.when(touched, text).otherwise(F.col("description")).alias("description"),
        F.when(is_old, _overlay(F.col("properties"), F.col("new_properties")))
        .otherwise(F.coalesce("new_properties", F.lit("{}"))).alias("properties"),
        F.when(is_old, F.col("created_at")).otherwise(stamp).alias("created_at"),
        F.when(touched, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    known = incoming.select(*key, "first_seq", "head").join(matched, key, "left").select(
        *key, "first_seq", F.col("old_id").isNotNull().alias("existed"), F.coalesce("old_id", fresh_id).alias("id")
    )
    outcome = F.when(~F.col("existed") & (F.col("seq") == F.col("first_seq")), "created").otherwise("merged")
    status = good.drop("id").join(known, key).select(
        "request_id", "seq", "id", outcome.alias("status"), F.lit(None).cast("string").alias("reason")
    )
    failed = bad.select(
        "request_id", "seq", F.lit(None).cast("string").alias("id"), F.lit("rejected").alias("status"), "reason"
    )
    return g.replace(entities=elsewhere.unionByName(merged)), status.unionByName(failed)


def _split_ends(g: Graph, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve ``source`` and ``target`` names, or check given ids; rows with a missing end fail."""
    if "source_id" in requests.columns:
        ends = requests.select(F.col("source_id").alias("id")).unionAll(requests.select("target_id")).distinct()
        ids = packed(g.entities.select("id").join(sized(ends), "id", "left_semi"))
        with_s = requests.join(ids.withColumnsRenamed({"id": "_s"}), F.col("source_id") == F.col("_s"), "left")
        with_t = with_s.join(ids.withColumnsRenamed({"id": "_t"}), F.col("target_id") == F.col("_t"), "left")
        found = with_t.withColumns({"source_id": F.col("_s"), "target_id": F.col("_t")}).drop("_s", "_t")
    else:
        names = requests.select(F.col("source").alias("name")).unionAll(requests.select("target")).distinct()
        known = resolve_names(g.entities, names.withColumn("request_id", F.lit("")))
        known = packed(known.select("name", "entity_id"))
        found = requests.join(known.toDF("source", "source_id"), "source", "left").join(
            known.toDF("target", "target_id"), "target", "left"
        )
    reason = F.when(F.col("source_id").isNull(), "source not found").when(
        F.col("target_id").isNull(), "target not found"
    )
    marked = found.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def _failed(df: DataFrame, status: str = "rejected") -> DataFrame:
    return df.select("request_id", "seq", F.lit(status).alias("status"), "reason")


def _done(df: DataFrame, status: Column) -> DataFrame:
    return df.select("request_id", "seq", status.alias("status"), F.lit(None).cast("string").alias("reason"))


def ends_of(g: Graph, batch: DataFrame, graph_id: str = "main") -> DataFrame:
    """The edges ``(source_id, target_id, relationship_type)`` that :func:`upsert_relationships` would meet."""
    ends = ("source_id", "target_id") if "source_id" in batch.columns else ("source", "target")
    return _split_ends(within(g, graph_id), validate_relationships(batch, ends)[0])[0].select(*EDGE_KEY)


def owners_of(g: Graph, batch: DataFrame, graph_id: str = "main") -> DataFrame:
    """The entities ``(entity_id)`` that :func:`new_observations` would add to, of a batch with ``entity_name``."""
    good, _ = validate_observations(batch, "entity_name")
    found = _resolve_column(within(g, graph_id), good, "entity_name", "entity_id")
    return found.select("entity_id").filter("entity_id is not null").distinct()


def upsert_relationships(g: Graph, batch: DataFrame, now, graph_id: str = "main") -> tuple[Graph, DataFrame]:
    """Add or merge edges ``batch(request_id, seq, source, target, relationship_type[, weight, properties])``.

    Ends are names, or ids in ``source_id`` and ``target_id``. Edges meet on (source, target, type):
    the higher weight is kept and later properties win.
    """
    ends = ("source_id", "target_id") if "source_id" in batch.columns else ("source", "target")
    reject_unknown_columns(batch, EDGE_FIELDS)
    good, bad = validate_relationships(batch, ends)
    here = within(g, graph_id)
    good, missing = _split_ends(here, good)
    good = packed(_with(good, id=F.lit(None).cast("string")))
    incoming = good.groupBy(*EDGE_KEY).agg(
        F.max("weight").alias("new_weight"), F.min("seq").alias("first_seq"), F.min_by("id", "seq").alias("given_id")
    )
    incoming = sized(incoming.join(_fold_props(good, EDGE_KEY), EDGE_KEY, "left"))
    matched = packed(here.relationships.join(incoming.select(*EDGE_KEY), EDGE_KEY, "left_semi").select(*EDGE_KEY).distinct())
    both = _left_and_new(here.relationships, incoming, EDGE_KEY, matched)
    is_old, touched, stamp = F.col("id").isNotNull(), F.col("first_seq").isNotNull(), _stamp(now)
    edges = both.select(
        F.coalesce("graph_id", F.lit(graph_id)).alias("graph_id"),
        F.coalesce("id", "given_id", new_id(*[F.col(c) for c in EDGE_KEY])).alias("id"),
        *EDGE_KEY,
        F.greatest("weight", "new_weight").alias("weight"),
        F.when(is_old, _overlay(F.col("properties"), F.col("new_properties")))
        .otherwise(F.coalesce("new_properties", F.lit("{}"))).alias("properties"),
        F.when(is_old, F.col("created_at")).otherwise(stamp).alias("created_at"),
        F.when(touched, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*RELATIONSHIP.names)
    known = incoming.select(*EDGE_KEY, "first_seq").join(
        matched.select(*EDGE_KEY, F.lit(True).alias("existed")), EDGE_KEY, "left"
    )
    created = F.col("existed").isNull() & (F.col("seq") == F.col("first_seq"))
    status = _done(good.join(known, EDGE_KEY), F.when(created, "created").otherwise("updated"))
    status = status.unionByName(_failed(bad)).unionByName(_failed(missing, "not_found"))
    elsewhere = g.relationships.filter(F.col("graph_id") != graph_id)
    return g.replace(relationships=elsewhere.unionByName(edges)), status


def new_observations(g: Graph, batch: DataFrame, now, graph_id: str = "main") -> tuple[DataFrame, DataFrame]:
    """Rows that ``batch(request_id, seq, entity_name | entity_id, content[, source, id])`` adds.

    Nothing is deduplicated, but ids follow from owner, text, request and sequence, and a row whose
    id is already stored is not added again: a replayed batch changes nothing.
    """
    by_name = "entity_id" not in batch.columns
    here = within(g, graph_id)
    reject_unknown_columns(batch, FACT_FIELDS)
    good, bad = validate_observations(batch, "entity_name" if by_name else "entity_id")
    if by_name:
        good = _resolve_column(here, good, "entity_name", "entity_id")
    else:
        asked = sized(good.select(F.col("entity_id").alias("id")).distinct())
        known = here.entities.join(asked, "id", "left_semi").select(F.col("id").alias("_e"))
        good = good.join(known, F.col("entity_id") == F.col("_e"), "left").withColumn("entity_id", F.col("_e")).drop("_e")
    missing = good.filter("entity_id is null").withColumn("reason", F.lit("entity not found"))
    good = _with(good.filter("entity_id is not null"), id=F.lit(None).cast("string"))
    key = new_id(
        F.col("entity_id"), F.col("content"), F.col("source"),
        F.col("request_id").cast("string"), F.col("seq").cast("string"),
    )
    rows = good.withColumns(
        {"id": F.coalesce("id", key), "graph_id": F.lit(graph_id), "created_at": _stamp(now)}
    )
    ids = sized(rows.select("id").distinct())
    present = g.observations.select("id").join(ids, "id", "left_semi")
    fresh = rows.join(present, "id", "left_anti").select(*OBSERVATION.names)
    status = _done(rows, F.lit("added")).unionByName(_failed(bad)).unionByName(_failed(missing, "not_found"))
    return fresh, status


def add_observations(g: Graph, batch: DataFrame, now, graph_id: str = "main") -> tuple[Graph, DataFrame]:
    """Append observations to named entities; see :func:`new_observations`."""
    fresh, status = new_observations(g, batch, now, graph_id)
    return g.replace(observations=g.observations.unionByName(fresh)), status


def add_entities(g: Graph, batch: DataFrame, now, graph_id: str = "main") -> tuple[Graph, DataFrame, DataFrame]:
    """Upsert entities together with their ``observations`` (array of texts).

    Observations go to the entity their row ended up as, by id. The third frame lists the added rows
    that lack a description or observations.
    """
    after, status = upsert_entities(g, batch.drop("observations"), now, graph_id)
    status = cut(status)
    after = after.replace(entities=packed(after.entities))
    texts = batch.select("request_id", F.posexplode("observations").alias("place", "content"))
    owners = status.filter("id is not null").select("request_id", F.col("id").alias("entity_id"))
    facts = texts.join(owners, "request_id").select(
        "request_id", F.col("place").alias("seq"), "entity_id", "content"
    )
    after, _ = add_observations(after, facts, now, graph_id)
    good, _ = validate_entities(batch)
    return after, status, screen_batch(good)


# --- updates --------------------------------------------------------------------------------


def _last(column: str) -> Column:
    """Value of the latest request that gives one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def update_entities(g: Graph, patches: DataFrame, now, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Apply ``patches(request_id, seq, name[, new_name, description, properties, entity_type])``.

    NULL leaves a field as it is. A rename to a name that another entity has, in any case, or that an
    earlier request of the batch takes, is a conflict and its request changes nothing. With ``graph_id``
    only that named graph is seen.
    """
    here = within(g, graph_id)
    none = F.lit(None).cast("string")
    patches = _with(patches, new_name=none, description=none, properties=none, entity_type=none)
    patches = patches.withColumns(
        {"new_name": F.nullif(strip(F.col("new_name")), F.lit("")), "new_type": norm_type(F.col("entity_type"))}
    ).drop("entity_type")
    found = cut(_resolve_column(here, patches, "name", "entity_id"))
    asked = sized(found.select("entity_id").distinct())
    current = here.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("old_name"))
    current = current.join(asked, "entity_id", "left_semi")
    found = found.join(current, "entity_id", "left").withColumn(
        "new_name", F.when(F.col("new_name") != F.col("old_name"), F.col("new_name"))
    ).withColumn("folded", nocase(F.col("new_name")))
    found = cut(found)
    wanted = sized(found.select("folded").filter("folded is not null").distinct())
    names = here.entities.select("id", nocase(F.col("name")).alias("folded"))
    taken = names.join(wanted, "folded", "left_semi").groupBy("folded").agg(
        F.min("id").alias("lowest"), F.max("id").alias("highest")
    )
    claims = found.filter("folded is not null and entity_id is not null").groupBy("folded").agg(
        F.min_by("entity_id", "seq").alias("claimed_by")
    )
    checked = found.join(taken, "folded", "left").join(claims, "folded", "left")
    other = lambda c: F.coalesce(F.col(c) != F.col("entity_id"), F.lit(False))
    fields = F.coalesce("new_name", "description", "properties", "new_type")
    status = (
        F.when(F.col("entity_id").isNull(), "not_found")
        .when(F.col("folded").isNotNull() & (other("lowest") | other("highest") | other("claimed_by")), "conflict")
        .when(fields.isNull(), "unchanged")
        .otherwise("updated")
    )
    checked = checked.withColumn("status", status)
    applied = checked.filter("status = 'updated'")
    change = applied.groupBy("entity_id").agg(
        _last("new_name"), _last("description").alias("new_description"), _last("new_type")
    ).join(_fold_props(applied, ["entity_id"]), "entity_id", "left").withColumnRenamed("entity_id", "id")
    change = sized(change)
    stamp = _stamp(now)
    entities = g.entities.join(change.withColumn("hit", F.lit(True)), "id", "left").select(
        "graph_id", "id",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("new_type", "entity_type").alias("entity_type"),
        F.coalesce("new_description", "description").alias("description"),
        _overlay(F.col("properties"), F.col("new_properties")).alias("properties"),
        "created_at",
        F.when(F.col("hit"), stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return g.replace(entities=entities), checked.select("request_id", "seq", "entity_id", "status")


def update_relationships(g: Graph, patches: DataFrame, now, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Apply ``patches(request_id, seq, source, target, relationship_type[, new_weight, new_type, properties])``.

    A weight outside [0, 1] is rejected; a new type whose edge exists already is a conflict. With
    ``graph_id`` only that named graph is seen.
    """
    here = within(g, graph_id)
    none = F.lit(None)
    patches = _with(
        patches, new_weight=none.cast("double"), new_type=none.cast("string"), properties=none.cast("string")
    ).withColumns(
        {
            "relationship_type": norm_type(F.col("relationship_type")),
            "new_type": F.nullif(norm_type(F.col("new_type")), F.lit("")),
        }
    )
    found, missing = _split_ends(here, patches)
    found = packed(found)
    between = sized(found.select("source_id", "target_id").distinct())
    keys = here.relationships.select(*EDGE_KEY, F.col("id").alias("edge_id"))
    keys = packed(keys.join(between, ["source_id", "target_id"], "left_semi"))
    found = found.join(keys, EDGE_KEY, "left").withColumn(
        "new_type", F.when(F.col("new_type") != F.col("relationship_type"), F.col("new_type"))
    )
    clash = keys.select(
        "source_id", "target_id", F.col("relationship_type").alias("new_type"), F.lit(True).alias("exists")
    )
    claims = found.filter("new_type is not null and edge_id is not null").groupBy(
        "source_id", "target_id", "new_type"
    ).agg(F.min_by("edge_id", "seq").alias("claimed_by"))
    at = ["source_id", "target_id", "new_type"]
    found = found.join(clash, at, "left").join(claims, at, "left")
    status = (
        F.when(F.col("edge_id").isNull(), "not_found")
        .when(~F.col("new_weight").between(0.0, 1.0) | F.isnan("new_weight"), "rejected")
        .when(F.col("exists") | (F.col("claimed_by") != F.col("edge_id")), "conflict")
        .otherwise("updated")
    )
    found = found.withColumn("status", status)
    applied = found.filter("status = 'updated'")
    change = applied.groupBy("edge_id").agg(_last("new_weight"), _last("new_type")).join(
        _fold_props(applied, ["edge_id"]), "edge_id", "left"
    ).withColumnRenamed("edge_id", "id")
    change = sized(change)
    stamp = _stamp(now)
    edges = g.relationships.join(change.withColumn("hit", F.lit(True)), "id", "left").select(
        "graph_id", "id", "source_id", "target_id",
        F.coalesce("new_type", "relationship_type").alias("relationship_type"),
        F.coalesce("new_weight", "weight").alias("weight"),
        _overlay(F.col("properties"), F.col("new_properties")).alias("properties"),
        "created_at",
        F.when(F.col("hit"), stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    outcome = found.select("request_id", "seq", F.col("edge_id"), "status").unionByName(
        missing.select("request_id", "seq", F.lit(None).cast("string").alias("edge_id"), F.lit("not_found").alias("status"))
    )
    return g.replace(relationships=edges), outcome


def _own_requests(g: Graph, requests: DataFrame, graph_id: str | None) -> DataFrame:
    """Requests on observations with their owner resolved; ``old_content`` is NULL if not owned."""
    if "entity_id" not in requests.columns:
        requests = _resolve_column(within(g, graph_id), requests, "entity_name", "entity_id")
    asked = sized(requests.select("observation_id", "entity_id").distinct())
    facts = g.observations.select(
        F.col("id").alias("observation_id"), "entity_id", F.col("content").alias("old_content")
    ).join(asked, ["observation_id", "entity_id"], "left_semi")
    return requests.join(facts, ["observation_id", "entity_id"], "left")


def update_observations(g: Graph, patches: DataFrame, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Replace texts by ``patches(request_id, seq, entity_name | entity_id, observation_id, content)``.

    Only the owner's observations can be changed. The status carries the old and the new text.
    """
    found = _own_requests(g, patches.withColumn("content", strip(F.col("content"))), graph_id)
    status = (
        F.when(F.col("old_content").isNull(), "not_found")
        .when(F.coalesce("content", F.lit("")) == "", "rejected")
        .otherwise("updated")
    )
    found = found.withColumn("status", status)
    change = found.filter("status = 'updated'").groupBy(F.col("observation_id").alias("id")).agg(
        F.max_by("content", "seq").alias("new_content")
    )
    change = sized(change)
    rows = g.observations.join(change, "id", "left").withColumn("content", F.coalesce("new_content", "content"))
    out = found.select(
        "request_id", "seq", "observation_id", "status", "old_content", F.col("content").alias("new_content")
    )
    return g.replace(observations=rows.select(*OBSERVATION.names)), out


# --- deletes --------------------------------------------------------------------------------


def _without(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*df.columns)


def delete_entities(g: Graph, requests: DataFrame, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Delete the entities that ``requests(request_id, seq, name)`` resolve to, with all that hangs on them.

    With ``graph_id`` only that named graph is seen.

    Of several requests for one entity the first deletes it; the others find nothing.
    """
    found = resolve_names(within(g, graph_id).entities, requests)
    hit = sized(found.filter("entity_id is not null").groupBy("entity_id").agg(F.min("seq").alias("first_seq")))
    ids = hit.select(F.col("entity_id").alias("id"))
    facts = g.observations.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select("id")
    after = Graph(
        entities=_without(g.entities, ids),
        relationships=_without(_without(g.relationships, ids, "source_id"), ids, "target_id"),
        observations=_without(g.observations, ids, "entity_id"),
        entity_embeddings=_without(g.entity_embeddings, ids),
        observation_embeddings=_without(g.observation_embeddings, facts),
    )
    first = F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False))
    status = found.join(hit, "entity_id", "left").select(
        "request_id", "seq", "entity_id", F.when(first, "deleted").otherwise("not_found").alias("status")
    )
    return after, status


def delete_relationships(g: Graph, requests: DataFrame, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Delete edges from source to target, of one type or, when that is NULL, of all types.

    ``requests(request_id, seq, source, target[, relationship_type])``; the status counts the edges
    each request matched in the tables before the batch.
    """
    requests = _with(requests, relationship_type=F.lit(None).cast("string")).withColumn(
        "relationship_type", norm_type(F.col("relationship_type"))
    )
    # Requests are told once and edges are gone through twice: for those that are asked for and for those that stay.
    found, missing = _split_ends(within(g, graph_id), packed(requests))
    found = packed(found)
    typed = found.filter("relationship_type is not null")
    every = found.filter("relationship_type is null")
    pair = ["source_id", "target_id"]
    typed_keys = sized(typed.select(*EDGE_KEY).distinct())
    pair_keys = sized(every.select(*pair).distinct())
    asked = g.relationships.select(*EDGE_KEY).join(sized(found.select(*pair).distinct()), pair, "left_semi")
    near = packed(asked.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("n")))
    one = near.join(typed_keys, EDGE_KEY, "left_semi")
    pairs = near.join(pair_keys, pair, "left_semi")
    all_types = pairs.groupBy(*pair).agg(F.sum("n").alias("n"))
    gone = sized(one.unionByName(pairs).select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"), F.col("relationship_type").alias("_type")).distinct())
    same = (F.col("source_id") == F.col("_s")) & (F.col("target_id") == F.col("_t")) & F.col("relationship_type").eqNullSafe(F.col("_type"))
    left = g.relationships.join(gone, same, "left_anti").select(*RELATIONSHIP.names)
    counted = typed.join(one, EDGE_KEY, "left").select("request_id", "seq", "n").unionByName(
        every.join(all_types, pair, "left").select("request_id", "seq", "n")
    ).unionByName(missing.select("request_id", "seq", F.lit(None).cast("long").alias("n")))
    status = counted.select("request_id", "seq", F.coalesce("n", F.lit(0)).alias("deleted"))
    return g.replace(relationships=left), status


def delete_observations(g: Graph, requests: DataFrame, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Delete ``requests(request_id, seq, entity_name | entity_id, observation_id)`` owned by that entity."""
    found = _own_requests(g, requests, graph_id)
    ids = sized(found.filter("old_content is not null").select(F.col("observation_id").alias("id")).distinct())
    after = g.replace(
        observations=_without(g.observations, ids),
        observation_embeddings=_without(g.observation_embeddings, ids),
    )
    status = F.when(F.col("old_content").isNull(), "not_found").otherwise("deleted")
    return after, found.select("request_id", "seq", "observation_id", status.alias("status"))


# --- compaction -----------------------------------------------------------------------------


def compact_observations(g: Graph, requests: DataFrame, now, graph_id: str = "main") -> tuple[Graph, DataFrame]:
    """Keep the listed observations of an entity, delete its others and add new texts, as one step.

    ``requests(request_id, seq, entity_name | entity_id, keep_ids, new_observations)``. A request
    that would keep an observation the entity does not have changes nothing. One request per entity.
    """
    if "entity_id" not in requests.columns:
        requests = _resolve_column(within(g, graph_id), requests, "entity_name", "entity_id")
    asked = sized(requests.select("entity_id").distinct())
    owned_n = g.observations.join(asked, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("before"))
    keeps = requests.select(
        "request_id", "entity_id", F.explode(F.array_distinct("keep_ids")).alias("id")
    )
    facts = g.observations.select("id", "entity_id", F.lit(True).alias("known"))
    checked = keeps.join(facts, ["id", "entity_id"], "left").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("kept"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown")
    )
    joined = requests.join(owned_n, "entity_id", "left").join(checked, "request_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "kept", "unknown")})
    status = F.when(F.col("entity_id").isNull(), "not_found").when(F.col("unknown") > 0, "rejected").otherwise("compacted")
    joined = cut(joined.withColumn("status", status))
    good = joined.filter("status = 'compacted'")
    scope = sized(good.select("entity_id"))
    kept_ids = keeps.join(good.select("request_id"), "request_id", "left_semi").select("id")
    others = g.observations.join(scope, "entity_id", "left_anti")
    kept = g.observations.join(scope, "entity_id", "left_semi").join(kept_ids, "id", "left_semi")
    gone = g.observations.join(scope, "entity_id", "left_semi").join(kept_ids, "id", "left_anti").select("id")
    texts = good.select(
        F.concat(F.lit("compact:"), F.col("request_id").cast("string")).alias("request_id"), "entity_id",
        F.posexplode("new_observations").alias("seq", "content"),
    )
    base = g.replace(
        observations=others.unionByName(kept), observation_embeddings=_without(g.observation_embeddings, gone)
    )
    after, added = add_observations(base, texts, now, graph_id)
    added_n = F.size(F.filter("new_observations", lambda t: strip(t) != ""))
    done = F.col("status") == "compacted"
    counts = joined.select(
        "request_id", "entity_id", "status", "before",
        F.when(done, F.col("before") - F.col("kept")).otherwise(0).alias("deleted"),
        F.when(done, F.col("kept")).otherwise(0).alias("kept"),
        F.when(done, added_n).otherwise(0).cast("long").alias("added"),
    )
    after_n = F.when(F.col("status") == "compacted", F.col("kept") + F.col("added")).otherwise(F.col("before"))
    return after, counts.withColumn("after", after_n)


# --- merging entities -----------------------------------------------------------------------


def _settle(pending: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Which merges ``(request_id, ord, source, target)`` take place, and those that find an end merged away before.

    A merge is sure once no open earlier one has its source or its target as source. Only the requests take part,
    so a chain that is asked for from its far end or in order is settled in a round or two.
    """
    sure, lost = [], []
    while True:
        first = pending.groupBy("source").agg(F.min("ord").alias("o"))
        view = pending.join(first.toDF("source", "same"), "source").join(first.toDF("target", "leaves"), "target", "left")
        ready = (F.col("same") == F.col("ord")) & (F.col("leaves").isNull() | (F.col("leaves") > F.col("ord")))
        wave = cut(view.filter(ready).select(*pending.columns))
        sure.append(wave)
        rest = pending.join(wave.select("ord"), "ord", "left_anti")
        gone = wave.select(F.col("source").alias("k"), F.col("ord").alias("at"))
        rest = rest.join(gone.toDF("source", "s_at"), "source", "left").join(gone.toDF("target", "t_at"), "target", "left")
        dead = F.coalesce(F.col("s_at") < F.col("ord"), F.lit(False)) | F.coalesce(F.col("t_at") < F.col("ord"), F.lit(False))
        rest = cut(rest.select(*pending.columns, dead.alias("dead")))
        lost.append(rest.filter("dead").drop("dead"))
        pending = rest.filter("not dead").drop("dead")
        if pending.isEmpty():
            return functools.reduce(DataFrame.unionAll, sure), lost


def _survivors(merges: DataFrame) -> DataFrame:
    """For every merged entity the merges on its way to the survivor, in order: source, path, root.

    Pointers jump twice as far every round, so a chain of n merges takes log n rounds over the requests.
    """
    paths = cut(merges.select("source", F.array(F.struct("ord", "target")).alias("path"), F.col("target").alias("root")))
    while True:
        ahead = paths.toDF("root", "more", "top")
        met = paths.join(ahead, "root", "left")
        paths = cut(
            met.select("source", F.concat("path", F.coalesce("more", F.slice("path", 1, 0))).alias("path"), F.coalesce("top", "root").alias("root"), "top")
        )
        if paths.filter("top is not null").isEmpty():
            return paths.drop("top")
        paths = paths.drop("top")


def _told_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Task helper: the description of one survivor, its tree's merges applied one after the other."""
    known = dict(zip(rows["source"], rows["text"], strict=True))
    asked = rows[rows["place"] > 0].sort_values("place")
    for source, target in zip(asked["source"], asked["target"], strict=True):
        text = known.pop(source)
        if text and text not in known[target]:
            known[target] = f"{known[target]}\n{text}".strip()
    root = rows["root"].iloc[0]
    return pd.DataFrame({"id": [root], "told": [known[root]]})


def _merged_texts(g: Graph, merges: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, told): the description of every survivor.

    Of merges that bring one text straight into one entity, from sources that took in nothing themselves, only the
    first can change anything and only that is told.
    """
    asked = merges.join(paths.select("source", "root"), "source")
    roots = asked.select(F.col("root").alias("source"), "root").distinct()
    ids = sized(asked.select("source").unionAll(roots.select("source")))
    texts = g.entities.join(ids, g.entities["id"] == ids["source"], "left_semi").select(F.col("id").alias("source"), F.coalesce("description", F.lit("")).alias("text"))
    texts = cut(texts)
    inner = merges.select(F.col("target").alias("source")).distinct().withColumn("inner", F.lit(True))
    told = asked.join(texts, "source").join(inner, "source", "left")
    leaf = told.filter("inner is null and text <> ''").groupBy("root", "target", "text").agg(F.min_by(F.struct("ord", "source"), "ord").alias("first"))
    leaf = leaf.select("root", "target", "text", "first.ord", "first.source")
    kept = leaf.unionByName(told.filter("inner").select("root", "target", "text", "ord", "source"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("ord"))
    rows = kept.select("root", "source", "target", "text", place.alias("place"))
    own = roots.join(texts, "source").select("root", "source", F.lit(None).cast("string").alias("target"), "text", F.lit(0).alias("place"))
    return rows.unionByName(own).groupBy("root").applyInPandas(_told_in_order, "id string, told string")


def _edge_states(g: Graph, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that no merge moves, and the others with the ends they have after each merge in ``states``.

    The first state is the edge as it lies; the last is a loop where a merge brings both ends together.
    """
    small = sized(paths.select("source", "path"))
    by_s, by_t = small.toDF("source_id", "s_path"), small.toDF("target_id", "t_path")
    mapped = g.relationships.join(by_s, "source_id", "left").join(by_t, "target_id", "left")
    moved = F.col("s_path").isNotNull() | F.col("t_path").isNotNull()
    stay = mapped.filter(~moved).select(*RELATIONSHIP.names)
    none = F.slice(F.coalesce("s_path", "t_path"), 1, 0)
    end = lambda path, side: F.transform(F.coalesce(F.col(path), none), lambda p: F.struct(p["ord"].alias("ord"), F.lit(side).alias("side"), p["target"].alias("to")))
    events = F.array_sort(F.concat(end("s_path", "s"), end("t_path", "t")))
    state = lambda o, s, t: F.struct(o.alias("ord"), s.alias("s"), t.alias("t"))
    first = F.col("events")[0]
    no_ord = F.when(F.lit(False), first["ord"])
    start = F.array(state(no_ord, F.col("source_id"), F.col("target_id")))

    def step(states, e):
        last = F.element_at(states, -1)
        return F.concat(states, F.array(state(e["ord"], F.when(e["side"] == "s", e["to"]).otherwise(last["s"]), F.when(e["side"] == "t", e["to"]).otherwise(last["t"]))))

    looped = F.concat(start, F.array(state(first["ord"], first["to"], first["to"])))
    states = F.when(F.col("source_id") == F.col("target_id"), looped).otherwise(F.aggregate("events", start, step))
    touched = mapped.filter(moved).withColumn("events", events).withColumn("states", states)
    loop = F.array_position(F.transform("states", lambda x: x["ord"].isNotNull() & (x["s"] == x["t"])), True)
    touched = touched.withColumn("loop", loop).withColumn("states", F.expr("if(loop > 0, slice(states, 1, cast(loop as int)), states)"))
    return stay, packed(touched.select(*RELATIONSHIP.names, "states", (F.col("loop") > 0).alias("looped")))


def _merge_counts(stay: DataFrame, touched: DataFrame) -> DataFrame:
    """Per merge how many edges it moved and how many it took away, as loops or as equals of an edge already there."""
    kind = "relationship_type"
    moves = touched.select(kind, F.explode(F.expr("transform(sequence(2, size(states)), i -> struct(states[i - 1].ord as ord, states[i - 2] as was, states[i - 1] as now))")).alias("m"))
    moves = packed(moves.select("m.ord", kind, F.col("m.was.s").alias("from_s"), F.col("m.was.t").alias("from_t"), F.col("m.now.s").alias("s"), F.col("m.now.t").alias("t")).distinct())
    here = touched.select(kind, F.explode(F.expr("transform(sequence(1, size(states)), i -> struct(states[i - 1] as now, get(states, i).ord as until))")).alias("p"))
    here = here.select("p.now.s", "p.now.t", kind, F.col("p.now.ord").alias("since"), F.col("p.until").alias("until")).filter("s <> t")
    wanted = sized(moves.filter("s <> t").select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), kind).distinct())
    lying = stay.join(wanted, EDGE_KEY, "left_semi").select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), kind)
    never = F.lit(None).cast(moves.schema["ord"].dataType)
    here = here.unionByName(lying.withColumns({"since": never, "until": never}))
    a, b = moves.alias("a"), here.alias("b")
    key = (F.col("a.s") == F.col("b.s")) & (F.col("a.t") == F.col("b.t")) & (F.col(f"a.{kind}") == F.col(f"b.{kind}"))
    there = (F.col("b.since").isNull() | (F.col("b.since") < F.col("a.ord"))) & (F.col("b.until").isNull() | (F.col("b.until") > F.col("a.ord")))
    fresh = a.filter("s <> t").join(b, key & there, "left_anti").groupBy("ord").agg(F.count(F.lit(1)).alias("redirected_relationships"))
    every = moves.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    rest = F.col("n") - F.coalesce("redirected_relationships", F.lit(0))
    return every.join(fresh, "ord", "left").select("ord", "redirected_relationships", rest.alias("removed_duplicate_relationships"))


def _apply_merges(g: Graph, merges: DataFrame, now) -> tuple[Graph, DataFrame]:
    """All sure merges in one pass over the tables."""
    stamp, merges = _stamp(now), cut(merges)
    paths = _survivors(merges)
    sources = sized(paths.select(F.col("source").alias("id")))
    texts = _merged_texts(g, merges, paths)
    changed = F.col("told").isNotNull() & (F.col("told") != F.coalesce("description", F.lit("")))
    entities = _without(g.entities, sources).join(texts, "id", "left").withColumns(
        {
            "updated_at": F.when(changed, stamp).otherwise(F.col("updated_at")),
            "description": F.when(changed, F.col("told")).otherwise(F.col("description")),
        }
    ).select(*ENTITY.names)

    owner = sized(paths.select(F.col("source").alias("entity_id"), F.col("root").alias("owner")))
    observations = g.observations.join(owner, "entity_id", "left").withColumn(
        "entity_id", F.coalesce("owner", "entity_id")
    ).select(*OBSERVATION.names)
    own = g.observations.join(owner, "entity_id", "left_semi").groupBy(F.col("entity_id").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    moved = own.join(paths, "source").select("n", F.explode("path.ord").alias("ord")).groupBy("ord").agg(F.sum("n").alias("moved_observations"))

    stay, touched = _edge_states(g, paths)
    last = F.element_at("states", -1)
    moves = F.reverse(F.transform(F.slice("states", 2, F.size("states")), lambda x: x["ord"]))
    repointed = touched.filter("not looped").withColumns({"source_id": last["s"], "target_id": last["t"], "moves": moves}).drop("states", "looped")
    keys = sized(repointed.select(*EDGE_KEY).distinct())
    clear = stay.join(keys, EDGE_KEY, "left_anti").select(*RELATIONSHIP.names)
    unmoved = F.array().cast(repointed.schema["moves"].dataType)
    lying = stay.join(keys, EDGE_KEY, "left_semi").select(*RELATIONSHIP.names).withColumn("moves", unmoved)
    # Of equal edges the one that was moved last comes last; what lies at the survivor is first.
    group = lying.unionByName(repointed).withColumn("rank", F.struct("moves", "id"))
    folded = group.groupBy(*EDGE_KEY).agg(
        F.min_by(F.struct("graph_id", "id", "created_at", "properties"), "rank").alias("keep"),
        F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"),
    ).join(_fold_props(group, EDGE_KEY, "rank"), EDGE_KEY, "left")
    combined = folded.select(
        "keep.graph_id", "keep.id", *EDGE_KEY, "weight",
        F.coalesce(F.when(F.col("n") > 1, F.col("new_properties")), F.col("keep.properties")).alias("properties"),
        "keep.created_at", stamp.alias("updated_at"),
    )
    status = merges.join(moved, "ord", "left").join(_merge_counts(stay, touched), "ord", "left").select(
        "request_id", F.col("source").alias("source_id"), F.col("target").alias("target_id"),
        F.lit("merged").alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in MERGE_COUNTS],
    )
    after = g.replace(
        entities=entities,
        relationships=clear.unionByName(combined),
        observations=observations,
        entity_embeddings=_without(g.entity_embeddings, sources),
    )
    return after, status


MERGE_COUNTS = ("moved_observations", "redirected_relationships", "removed_duplicate_relationships")


def merge_entities(g: Graph, requests: DataFrame, now, graph_id: str | None = None) -> tuple[Graph, DataFrame]:
    """Merge duplicates: ``requests(request_id, seq, source, target)`` by name, or by ``source_id, target_id``.

    The target takes over description, observations and edges; edges that would join it to itself
    go, equal edges become one with the higher weight and the later properties. A request whose entity
    an earlier one has merged away is ``not_found``. Names and ids resolve within ``graph_id``; without it in all
    graphs, and a request for entities of two graphs is ``not_found``. Which requests take place and where
    chains end is found on the requests alone; the tables are then gone through once, however long the chains are.
    """
    found, missing = _split_ends(within(g, graph_id), requests)
    ordered = found.select(
        "request_id", F.struct("seq", F.col("request_id").cast("string").alias("r")).alias("ord"),
        F.col("source_id").alias("source"), F.col("target_id").alias("target"),
    )
    if graph_id is None:
        ends = sized(ordered.select(F.col("source").alias("id")).unionAll(ordered.select("target")).distinct())
        graphs = cut(g.entities.join(ends, "id", "left_semi").select("id", "graph_id"))
        ordered = ordered.join(graphs.toDF("source", "s_graph"), "source").join(graphs.toDF("target", "t_graph"), "target")
        apart = ordered.filter("not (s_graph <=> t_graph)").select("request_id", "source", "target")
        ordered = ordered.filter("s_graph <=> t_graph").select("request_id", "ord", "source", "target")

    def failed(df: DataFrame, status: str) -> DataFrame:
        return df.select(
            "request_id", F.col("source").alias("source_id"), F.col("target").alias("target_id"),
            F.lit(status).alias("status"), *[F.lit(0).cast("long").alias(c) for c in MERGE_COUNTS],
        )

    lost = missing.select("request_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    statuses = [failed(lost, "not_found"), failed(ordered.filter("source = target"), "self_merge")]
    if graph_id is None:
        statuses.append(failed(apart, "not_found"))
    pending = cut(ordered.filter("source <> target"))
    if not pending.isEmpty():
        merges, late = _settle(pending)
        g, status = _apply_merges(g, merges, now)
        statuses += [status, *[failed(df, "not_found") for df in late]]
    return g, functools.reduce(DataFrame.unionAll, statuses)
