"""Snapshots of a graph as Parquet tables, named graphs, and SQL over the tables."""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.scalars import nocase
from knotwork.model import TABLES, Graph

#: Rule for graph names (fixed values).
GRAPH_ID_PATTERN = r"^[A-Za-z0-9_-]+\z"
GRAPH_ID_MAX = 64
GRAPH_ID_RESERVED = "graph"

MANIFEST = re.compile(r"manifest-(\d+)\.json")

#: Folders of appended rows from which the next append writes the rows of a bucket as one.
COMPACT_AFTER = 50

#: Buckets of every table of a store, unless its first writer says otherwise.
BUCKETS = 16

#: What the rows of a table are dealt to buckets by; entities by their name in any case, as upserts and requests find them.
BUCKET_KEYS = {
    "entities": ("name",),
    "relationships": ("source_id", "target_id", "relationship_type"),
    "observations": ("entity_id",),
    "entity_embeddings": ("id",),
    "observation_embeddings": ("id",),
}


class StaleSnapshot(OSError):
    """The store has a newer snapshot than the one that the tables were read from."""


def valid_graph_ids(df: DataFrame) -> DataFrame:
    """Mark each ``graph_id`` as valid or not."""
    c = F.col("graph_id")
    ok = c.rlike(GRAPH_ID_PATTERN) & (F.length(c) <= GRAPH_ID_MAX) & (c != GRAPH_ID_RESERVED)
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def check_graph_id(graph_id: str) -> str:
    """The name itself, or an error when it breaks the rule; for a name given by the caller."""
    if not re.search(GRAPH_ID_PATTERN.replace(r"\z", r"\Z"), graph_id) or len(graph_id) > GRAPH_ID_MAX:
        raise ValueError(f"invalid graph name {graph_id!r}")
    if graph_id == GRAPH_ID_RESERVED:
        raise ValueError(f"graph name {graph_id!r} is reserved")
    return graph_id


def select_graph(g: Graph, graph_id: str) -> Graph:
    """One named graph; on stored tables the filter prunes partitions."""
    return g.replace(**{n: df.filter(F.col("graph_id") == graph_id) for n, df in g.tables().items()})


def drop_graph(g: Graph, graph_id: str, active: str) -> Graph:
    if graph_id == active:
        raise ValueError(f"cannot delete the active graph {graph_id!r}")
    return g.replace(**{n: df.filter(F.col("graph_id") != graph_id) for n, df in g.tables().items()})


def graph_sql(g: Graph, sql: str, args: dict | None = None) -> DataFrame:
    """Run SQL over the tables, written as ``{entities}`` and so on; values go in as ``:name``."""
    used = {name: df for name, df in g.tables().items() if "{" + name + "}" in sql}
    return g.spark.sql(sql, args=args, **used)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file whole: under a name of its own first, then renamed into place."""
    fs, target = _filesystem(spark, path)
    _, staged = _filesystem(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise OSError(f"{path} exists already")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def _entries(spark: SparkSession, store: str) -> list[str]:
    fs, root = _filesystem(spark, store)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def read_manifest(spark: SparkSession, store: str) -> dict | None:
    """The manifest with the highest number; None for a store nobody has written to."""
    entries = _entries(spark, store)
    numbers = [int(m[1]) for m in map(MANIFEST.fullmatch, entries) if m]
    if numbers:
        return json.loads(read_text(spark, f"{store}/manifest-{max(numbers)}.json"))
    if set(entries) & set(TABLES):
        raise ValueError(f"{store} holds tables but no manifest")
    return None


def _write_manifest(spark: SparkSession, store: str, manifest: dict) -> None:
    """Put the next manifest beside the earlier ones. Two writers that start from one manifest want the
    same number; the second one fails and has changed nothing."""
    path = f"{store}/manifest-{manifest['number']}.json"
    try:
        write_text(spark, path, json.dumps(manifest))
    except OSError as error:
        fs, target = _filesystem(spark, path)
        if fs.exists(target):
            raise StaleSnapshot(f"{path} was written by another") from error
        raise


def bucket_of(table: str, count: int) -> Column:
    """The bucket of a row of ``table``."""
    keys = [nocase(F.col(c)) if c == "name" else F.col(c) for c in BUCKET_KEYS[table]]
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def buckets_of(table: str, rows: DataFrame, count: int) -> set[int]:
    """The buckets that ``rows`` with the key columns of ``table`` fall into, ``count`` at most."""
    return {r.bucket for r in rows.select(bucket_of(table, count).alias("bucket")).distinct().collect()}


def save_graph(
    g: Graph,
    store: str,
    version: str,
    changed: set[str] | None = None,
    appended: dict[str, DataFrame] | None = None,
    stream: tuple[str, int] | None = None,
    only: dict[str, set[int]] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Write a snapshot into new folders, then add the manifest that names them.

    Manifests are numbered and never replaced, and no folder is written twice, whatever the versions are called:
    readers see all tables of one snapshot or all of another, a job may read the previous snapshot while
    it writes the next, and a crash leaves the previous one in force. Tables that were read from the store
    are saved only on top of the snapshot they come from; if another writer was faster, ``StaleSnapshot``
    is raised and nothing has changed.

    With ``changed`` only those tables are written, and ``appended`` rows go beside what a table has already,
    or, in a bucket of ``COMPACT_AFTER`` folders, together with it into one; every other table keeps its folders.
    Tables are dealt to buckets, ``buckets`` of them from the first snapshot on. With ``only`` a changed table
    holds, and replaces, the rows of the named buckets. ``stream`` notes the last batch of a stream.
    """
    before = read_manifest(g.spark, store)
    if g.base is not None and g.base != (before["number"] if before else -1):
        raise StaleSnapshot(f"{store} has changed since snapshot {g.base}")
    if before is None:
        before = {"number": 0, "version": None, "buckets": buckets, "tables": {}, "streams": {}}
        _write_manifest(g.spark, store, before)
    steps, grams = before.get("steps", {}), before.get("grams", {})
    folders, appended, only, count = dict(before["tables"]), appended or {}, only or {}, before["buckets"]
    number, token = before["number"] + 1, uuid.uuid4().hex[:12]
    for name, df in g.tables().items():
        held, mine = folders.get(name), only.get(name)
        inside = lambda some, name=name: bucket_of(name, count).isin(sorted(some))
        if name in appended and held is not None:
            sizes = Counter(b for entry in held for b in entry["buckets"])
            replaced = {b for b, n in sizes.items() if n >= COMPACT_AFTER and (mine is None or b in mine)}
            rows = df.filter(inside(replaced)).unionByName(appended[name]) if replaced else appended[name]
        elif changed is None or name in changed or held is None:
            replaced = set(range(count)) if mine is None else mine
            rows = df if mine is None else df.filter(inside(mine))
            rows = rows.unionByName(appended[name]) if name in appended else rows
        else:
            continue
        if name == "relationships":
            steps = {}
        if name == "entities":
            grams = {}
        folder = f"{name}/version={version}/write={number}-{token}"
        dealt = rows.withColumn("bucket", bucket_of(name, count)).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket", "graph_id").parquet(f"{store}/{folder}")
        written = sorted(int(e.removeprefix("bucket=")) for e in _entries(g.spark, f"{store}/{folder}") if e.startswith("bucket="))
        left = [entry | {"buckets": [b for b in entry["buckets"] if b not in replaced]} for entry in held or []]
        folders[name] = [entry for entry in [*left, {"folder": folder, "all": written, "buckets": written}] if entry["buckets"]]
    streams = before["streams"] | ({stream[0]: stream[1]} if stream else {})
    derived = {"steps": steps, "grams": grams}
    _write_manifest(
        g.spark, store, {"number": number, "version": version, "buckets": count, "tables": folders, "streams": streams} | derived
    )


def load_graph(
    spark: SparkSession, store: str, graph_id: str | None = None, only: dict[str, set[int]] | None = None
) -> Graph:
    """The snapshot of the last manifest; an empty graph when there is none yet.

    All folders of a table are one scan. With ``only`` just the named buckets of a table are read.
    """
    manifest = read_manifest(spark, store)
    if manifest is None:
        return Graph.of(spark).replace(base=-1)

    def read(name: str, schema) -> DataFrame:
        paths, mine = [], (only or {}).get(name)
        for entry in manifest["tables"].get(name, ()):
            wanted = [b for b in entry["buckets"] if mine is None or b in mine]
            if wanted == entry["all"]:
                paths.append(f"{store}/{entry['folder']}")
            else:
                paths += [f"{store}/{entry['folder']}/bucket={b}" for b in wanted]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{store}/{name}").parquet(*paths).select(*schema.names)

    g = Graph(**{name: read(name, schema) for name, schema in TABLES.items()}, base=manifest["number"])
    return g if graph_id is None else select_graph(g, graph_id)


def prune_snapshots(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` manifests and the folders that none of the kept ones names; how many folders went.

    Folders of a write that is under way carry a later number than the last manifest and stay. A reader of a
    removed snapshot fails, so ``keep`` covers the longest job.
    """
    if keep < 1:
        raise ValueError("the last snapshot stays")
    numbers = sorted(int(m[1]) for m in map(MANIFEST.fullmatch, _entries(spark, store)) if m)
    if not numbers:
        return 0
    fs, _ = _filesystem(spark, store)
    kept = [json.loads(read_text(spark, f"{store}/manifest-{n}.json")) for n in numbers[-keep:]]
    named = {entry["folder"] for manifest in kept for entries in manifest["tables"].values() for entry in entries}
    named |= {folder for manifest in kept for kind in ("steps", "grams") for folder in manifest.get(kind, {}).values()}
    for n in numbers[:-keep]:
        fs.delete(_filesystem(spark, f"{store}/manifest-{n}.json")[1], False)
    gone = 0
    parents = [f"{name}/{version}" for name in TABLES for version in _entries(spark, f"{store}/{name}")]
    for parent in [*parents, "steps", "grams"]:
        for write in _entries(spark, f"{store}/{parent}"):
            folder, number = f"{parent}/{write}", re.match(r"write=(\d+)-", write)
            if number and int(number[1]) <= numbers[-1] and folder not in named:
                fs.delete(_filesystem(spark, f"{store}/{folder}")[1], True)
                gone += 1
    return gone
