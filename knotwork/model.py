"""Table schemas and the ``Graph`` holder every operator takes and returns."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

RELATIONSHIP = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("relationship_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("properties", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model_name", T.StringType()),
    ]
)

EMBEDDING_CACHE = T.StructType(
    [
        T.StructField("content_hash", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("last_used", T.TimestampType()),
    ]
)

TABLES = {
    "entities": ENTITY,
    "relationships": RELATIONSHIP,
    "observations": OBSERVATION,
    "entity_embeddings": EMBEDDING,
    "observation_embeddings": EMBEDDING,
}


@dataclasses.dataclass(frozen=True)
class Graph:
    """The five tables of a knowledge graph, each a lazy DataFrame.

    ``base`` is the number of the stored manifest that the tables were read from, if any.
    """

    entities: DataFrame
    relationships: DataFrame
    observations: DataFrame
    entity_embeddings: DataFrame
    observation_embeddings: DataFrame
    base: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def replace(self, **tables: DataFrame) -> "Graph":
        return dataclasses.replace(self, **tables)

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> "Graph":
        """A graph from the tables given; the ones left out are empty."""
        return Graph(
            **{
                name: tables[name] if name in tables else spark.createDataFrame([], schema)
                for name, schema in TABLES.items()
            }
        )
