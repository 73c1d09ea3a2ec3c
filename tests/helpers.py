"""Small graphs written by hand."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from knotwork.model import EMBEDDING, ENTITY, OBSERVATION, RELATIONSHIP, Graph

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
NOW = "2030-01-01 00:00:00"


def at(seconds: int) -> datetime:
    return T0 + timedelta(seconds=seconds)


def graph(spark, entities=(), edges=(), facts=(), vectors=()) -> Graph:
    """Entities ``(id, name, type[, description, properties, seconds])``, edges
    ``(id, source, target, type[, weight, properties])``, facts ``(id, entity, content[, seconds])``."""

    def entity(i, name, kind, description="", properties="{}", seconds=0):
        return ("main", i, name, kind, description, properties, at(seconds), at(seconds))

    def edge(i, s, t, kind="knows", weight=1.0, properties="{}"):
        return ("main", i, s, t, kind, weight, properties, at(0), at(0))

    def fact(i, owner, content, seconds=0):
        return ("main", i, owner, content, "", at(seconds))

    return Graph.of(
        spark,
        entities=spark.createDataFrame([entity(*e) for e in entities], ENTITY),
        relationships=spark.createDataFrame([edge(*e) for e in edges], RELATIONSHIP),
        observations=spark.createDataFrame([fact(*f) for f in facts], OBSERVATION),
        entity_embeddings=spark.createDataFrame([("main", i, v, "m") for i, v in vectors], EMBEDDING),
    )


def people(spark, names, edges=(), **kw) -> Graph:
    """Entities whose id is their name; edges ``(source, target[, type, weight, properties])``."""
    return graph(
        spark,
        [(n, n, "person") for n in names],
        [(f"r{i:03d}", *e) for i, e in enumerate(edges)],
        **kw,
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
