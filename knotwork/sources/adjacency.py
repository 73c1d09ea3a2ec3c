"""The two-way edge list stored with a snapshot, in buckets by start node.

A hop of a large frontier shuffles the frontier to the buckets and leaves the edges where they are; a hop of a
few nodes reads the buckets of those nodes. The list belongs to the snapshot it was made from: once edges
change, the manifest names it no more.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession

from knotwork.operators.traverse import Steps, dealt_steps
from knotwork.session import shuffle_partitions
from knotwork.sources.tables import StaleSnapshot, _write_manifest, load_graph, read_manifest, read_text, write_text


def save_steps(spark: SparkSession, store: str, graph_id: str | None = None, buckets: int | None = None) -> None:
    """Write the steps of the last snapshot (of one named graph) and note them in the next manifest.

    ``buckets`` is at least the shuffle partitions of the sessions that will read them, so that a join takes
    the buckets as they are.
    """
    manifest = read_manifest(spark, store)
    if manifest is None:
        raise ValueError(f"{store} holds no snapshot")
    count = buckets or shuffle_partitions(spark)
    g = load_graph(spark, store, graph_id)
    if g.base != manifest["number"]:
        raise StaleSnapshot(f"{store} has changed")
    steps, hubs, keys = dealt_steps(g)
    folder = f"steps/write={manifest['number'] + 1}-{uuid.uuid4().hex[:12]}"
    name = "steps_" + uuid.uuid4().hex
    dealt = steps.select("from_id", "to_id", "relationship_type", "direction", *keys[1:]).repartition(count, *keys)
    dealt.write.bucketBy(count, *keys).sortBy("from_id").option("path", f"{store}/{folder}/edges").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    if hubs is not None:
        hubs.write.parquet(f"{store}/{folder}/hubs")
    write_text(spark, f"{store}/{folder}/steps.json", json.dumps({"buckets": count, "keys": keys}))
    noted = manifest.get("steps", {}) | {graph_id or "": folder}
    _write_manifest(spark, store, manifest | {"number": manifest["number"] + 1, "steps": noted})


def load_steps(spark: SparkSession, store: str, graph_id: str | None = None) -> Steps | None:
    """The stored steps of the last snapshot, for the ``steps`` of any traversal; None where there are none."""
    manifest = read_manifest(spark, store)
    folder = (manifest or {}).get("steps", {}).get(graph_id or "")
    if folder is None:
        return None
    path = f"{store}/{folder}"
    made = json.loads(read_text(spark, f"{path}/steps.json"))
    name = "steps_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    slot = ", slot INT" if len(made["keys"]) > 1 else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (from_id STRING, to_id STRING, relationship_type STRING, direction STRING{slot}) "
        f"USING parquet CLUSTERED BY ({', '.join(made['keys'])}) SORTED BY (from_id) INTO {made['buckets']} BUCKETS LOCATION '{path}/edges'"
    )
    hubs = spark.read.parquet(f"{path}/hubs") if slot else None
    return Steps(spark.table(name), hubs, stored=True)
