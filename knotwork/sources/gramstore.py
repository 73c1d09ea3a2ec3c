"""The substring index stored with a snapshot: postings in buckets by part, texts in buckets by id.

A request reads the buckets of its substrings and of the texts that they lead to. The index belongs to the
snapshot it was made from: once entities change, the manifest names it no more.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession

from knotwork.operators.grams import FIELDS, GramIndex, gram_parts
from knotwork.session import shuffle_partitions
from knotwork.sources.tables import StaleSnapshot, _write_manifest, load_graph, read_manifest, read_text, write_text


def save_gram_index(spark: SparkSession, store: str, graph_id: str | None = None, buckets: int | None = None) -> None:
    """Index the entities of the last snapshot (of one named graph) and note it in the next manifest."""
    manifest = read_manifest(spark, store)
    if manifest is None:
        raise ValueError(f"{store} holds no snapshot")
    count = buckets or shuffle_partitions(spark)
    g = load_graph(spark, store, graph_id)
    if g.base != manifest["number"]:
        raise StaleSnapshot(f"{store} has changed")
    terms, postings, texts = gram_parts(g.entities)
    folder = f"grams/write={manifest['number'] + 1}-{uuid.uuid4().hex[:12]}"
    terms.sortWithinPartitions("gram").write.parquet(f"{store}/{folder}/terms")
    for kind, df, key in (("postings", postings, "part"), ("texts", texts, "id")):
        name = "grams_" + uuid.uuid4().hex
        kept = df.repartition(count, key).write.bucketBy(count, key).sortBy(key)
        kept.option("path", f"{store}/{folder}/{kind}").format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
    write_text(spark, f"{store}/{folder}/grams.json", json.dumps({"buckets": count}))
    noted = manifest.get("grams", {}) | {graph_id or "": folder}
    _write_manifest(spark, store, manifest | {"number": manifest["number"] + 1, "grams": noted})


def load_gram_index(spark: SparkSession, store: str, graph_id: str | None = None) -> GramIndex | None:
    """The stored index of the last snapshot; None where there is none."""
    manifest = read_manifest(spark, store)
    folder = (manifest or {}).get("grams", {}).get(graph_id or "")
    if folder is None:
        return None
    path = f"{store}/{folder}"
    count = json.loads(read_text(spark, f"{path}/grams.json"))["buckets"]

    def table(kind: str, columns: str, key: str):
        name = f"grams_{kind}_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {count} BUCKETS LOCATION '{path}/{kind}'"
        )
        return spark.table(name)

    texts = table("texts", "id STRING, " + ", ".join(f"{f} STRING" for f in FIELDS), "id")
    return GramIndex(spark.read.parquet(f"{path}/terms"), table("postings", "part STRING, id STRING", "part"), texts, stored=True)
