"""Snapshots, JSON round trip, streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import NOW, graph, rows
from knotwork.model import Graph
from knotwork.sources import documents as D
from knotwork.sources import tables
from knotwork.streaming.ingest import RECORD, ingest_stream, stream_id


def sample(spark):
    return graph(
        spark,
        [("e1", "Ada", "person", "d", '{"k": {"x": [1]}}'), ("e2", "Bob", "person")],
        [("r1", "e1", "e2", "knows", 0.5, '{"s": 1}')],
        [("o1", "e1", "fact")],
        [("e1", [1.0, 0.5])],
    )


def test_snapshot_round_trip(spark, tmp_path):
    g, store = sample(spark), str(tmp_path / "store")
    assert tables.load_graph(spark, store).entities.count() == 0
    tables.save_graph(g, store, "v1")
    back = tables.load_graph(spark, store, "main")
    for name, df in g.tables().items():
        assert sorted(map(str, back.tables()[name].collect())) == sorted(map(str, df.collect()))
    tables.save_graph(back.replace(observations=back.observations.limit(0)), store, "v2")
    assert tables.load_graph(spark, store).observations.count() == 0
    assert tables.load_graph(spark, store, "other").entities.count() == 0
    plan = back.entities._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(graph_id" in plan


def test_drop_active_graph(spark):
    with pytest.raises(ValueError):
        tables.drop_graph(sample(spark), "main", "main")


def test_graph_names(spark):
    names = ["ok-1_A", "graph", "", "a b", "x" * 65, "x" * 64, "a\n", None]
    df = spark.createDataFrame([(n,) for n in names], "graph_id string")
    got = {r.graph_id: r.valid for r in tables.valid_graph_ids(df).collect()}
    assert [n for n, ok in got.items() if ok] == ["ok-1_A", "x" * 64]


def test_graph_sql(spark):
    out = tables.graph_sql(sample(spark), "SELECT id FROM {entities} WHERE name = :n", {"n": "Ada"})
    assert rows(out, "id") == [("e1",)]


def test_exports_are_packed(spark, tmp_path):
    """Lines are packed unless told otherwise, and read back alike."""
    g = sample(spark)
    for kind in ("gzip", "none"):
        D.export_graph(g, str(tmp_path / kind), kind)
    D.export_graph(g, str(tmp_path / "plain"))
    assert list((tmp_path / "plain" / "entities").glob("*.json.gz")) and not list((tmp_path / "none" / "entities").glob("*.gz"))
    first, second = (rows(D.read_export(spark, str(tmp_path / kind))["entities"], "id", "name") for kind in ("plain", "none"))
    assert first == second and first


def test_export_import(spark, tmp_path):
    g, path = sample(spark), str(tmp_path / "out")
    D.export_graph(g, path)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["version"] == "1"
    back, counts = D.import_rows(Graph.of(spark), D.read_export(spark, path), NOW, keep_ids=True)
    assert rows(back.entities, "id", "name", "description", "properties") == rows(g.entities.selectExpr("id", "name", "description", "replace(properties, ' ', '') properties"), "id", "name", "description", "properties")
    assert rows(back.relationships, "id", "source_id", "target_id", "weight") == rows(g.relationships, "id", "source_id", "target_id", "weight")
    assert rows(back.observations, "id", "entity_id", "content") == rows(g.observations, "id", "entity_id", "content")
    assert rows(counts, "table", "imported", "skipped") == [("entities", 2, 0), ("observations", 1, 0), ("relationships", 1, 0)]


def test_import_document_remaps_and_skips(spark, tmp_path):
    doc = {
        "version": "1",
        "entities": [
            {"id": "x1", "name": "Ada", "entity_type": "Person", "description": "new", "properties": {"k": 1}},
            {"id": "x2", "name": "ada", "entity_type": "person"},
            {"id": "x3", "name": "Cy", "entity_type": "person"},
            {"id": "x4", "name": " ", "entity_type": "person"},
        ],
        "relationships": [
            {"source_id": "x2", "target_id": "x3", "relationship_type": "knows", "weight": "0.25"},
            {"source_id": "x2", "target_id": "gone", "relationship_type": "knows"},
        ],
        "observations": [{"entity_id": "x2", "content": "valid"}, {"entity_id": "gone", "content": "orphan"}],
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=1))
    g, counts = D.import_rows(sample(spark), D.read_documents(spark, str(tmp_path / "doc.json")), NOW)
    assert rows(counts, "table", "imported", "skipped") == [("entities", 3, 1), ("observations", 1, 1), ("relationships", 1, 1)]
    assert rows(g.entities, "name", "description") == [("Ada", "d\nnew"), ("Bob", ""), ("Cy", "")]
    assert rows(g.observations, "entity_id", "content") == [("e1", "fact"), ("e1", "valid")]
    assert sorted(r.source_id for r in g.relationships.collect()) == ["e1", "e1"]


def record(kind, n, **fields):
    return json.dumps({"kind": kind, "request_id": f"{kind}{n}", "seq": n, **fields})


def test_stream(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    (tmp_path / "in").mkdir()
    first = [
        record("entity", 1, name="Ada", entity_type="person", description="one"),
        record("entity", 2, name="ADA", entity_type="person", description="two"),
        record("entity", 3, name="Bob", entity_type="person"),
        record("relationship", 4, source="ada", target="Bob", relationship_type="knows", weight=0.5),
        record("observation", 5, name="Ada", content="fact"),
    ]
    (tmp_path / "in" / "a.json").write_text("\n".join(first))
    now = lambda n: f"2030-01-0{n + 1} 00:00:00"

    def run():
        stream = spark.readStream.schema(RECORD).json(source)
        ingest_stream(stream, store, checkpoint, now).awaitTermination()
        return tables.load_graph(spark, store)

    g = run()
    assert rows(g.entities, "name", "description") == [("Ada", "one\ntwo"), ("Bob", "")]
    second = [
        record("relationship", 6, source="Ada", target="Bob", relationship_type="Knows", weight=0.9),
        record("observation", 7, name="Nobody", content="lost"),
        record("observation", 8, name="bob", content="fact"),
    ]
    (tmp_path / "in" / "b.json").write_text("\n".join(second))
    g = run()
    assert rows(g.relationships, "relationship_type", "weight") == [("knows", 0.9)]
    assert g.observations.count() == 2
    own = stream_id(spark, checkpoint)
    written = {p.name for p in (tmp_path / "store").iterdir() if (p / f"version={own}-1").exists()}
    assert written == {"relationships", "observations"}
    status = spark.read.parquet(f"{store}/status/{own}-1")
    assert rows(status, "request_id", "status") == [("observation7", "not_found"), ("observation8", "added"), ("relationship6", "updated")]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch that failed before its manifest was written is run again from the snapshot before it."""
    from knotwork.streaming.ingest import apply_records

    lines = [record("entity", 1, name="Ada", entity_type="person", description="x"), record("observation", 2, name="ada", content="fact")]
    (tmp_path / "a.json").write_text("\n".join(lines))
    records = spark.read.schema(RECORD).json(str(tmp_path / "a.json"))
    once, facts, _ = apply_records(Graph.of(spark), records, NOW)
    assert facts.count() == 1
    twice, more, _ = apply_records(once.replace(observations=facts), records, NOW)
    assert more.count() == 0
    assert sorted(map(str, once.entities.collect())) == sorted(map(str, twice.entities.collect()))


def push(spark, tmp_path, name, store, *lines, graph_id="main"):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(lines))
    stream = spark.readStream.schema(RECORD).json(str(folder))
    ingest_stream(stream, store, str(tmp_path / f"{name}-checkpoint"), lambda n: NOW, graph_id).awaitTermination()


def test_two_streams_onto_a_snapshot(spark, tmp_path):
    store = str(tmp_path / "store")
    tables.save_graph(sample(spark), store, "v2")
    push(spark, tmp_path, "a", store, record("entity", 1, name="Cy", entity_type="person"))
    push(spark, tmp_path, "b", store, record("entity", 1, name="Di", entity_type="person"))
    push(spark, tmp_path, "a", store, record("observation", 2, name="di", content="seen"))
    g = tables.load_graph(spark, store)
    assert rows(g.entities, "name") == [("Ada",), ("Bob",), ("Cy",), ("Di",)]
    assert rows(g.observations, "content") == [("fact",), ("seen",)]
    assert sorted(tables.read_manifest(spark, store)["streams"].values()) == [0, 1]


def test_streams_of_named_graphs(spark, tmp_path):
    store = str(tmp_path / "store")
    tables.save_graph(sample(spark), store, "v1")
    push(spark, tmp_path, "a", store, record("observation", 1, name="Ada", content="lost"), graph_id="other")
    push(spark, tmp_path, "b", store, record("entity", 1, name="ADA", entity_type="person"), record("observation", 2, name="ada", content="mine"), graph_id="other")
    g = tables.load_graph(spark, store)
    assert rows(g.entities, "graph_id", "name") == [("main", "Ada"), ("main", "Bob"), ("other", "ADA")]
    owner = {r.id: r.graph_id for r in g.entities.collect()}
    assert [(r.content, r.graph_id, owner[r.entity_id]) for r in g.observations.orderBy("content").collect()] == [("fact", "main", "main"), ("mine", "other", "other")]


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    tables.save_graph(sample(spark), store, "v1")
    with monkeypatch.context() as m:
        m.setattr(tables, "_write_manifest", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            tables.save_graph(Graph.of(spark), store, "v2")
    assert tables.load_graph(spark, store).entities.count() == 2
    tables.save_graph(Graph.of(spark), store, "v2")
    assert tables.load_graph(spark, store).entities.count() == 0
    with pytest.raises(OSError):
        tables._write_manifest(spark, store, {"number": 1})  # another writer was first
    for p in (tmp_path / "store").glob("manifest-*"):
        p.unlink()
    with pytest.raises(ValueError):
        tables.load_graph(spark, store)


def test_appended_folders_are_one_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT_AFTER", 4)
    store, g = str(tmp_path / "store"), sample(spark)
    tables.save_graph(g, store, "v0")
    for n in range(1, 7):
        now = tables.load_graph(spark, store)
        fact = g.observations.selectExpr("graph_id", f"'n{n}' id", "entity_id", "content", "source", "created_at")
        tables.save_graph(now, store, f"v{n}", set(), {"observations": fact})
        back = tables.load_graph(spark, store).observations
        assert back.count() == n + 1
        assert back._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert len(tables.read_manifest(spark, store)["tables"]["observations"]) == 3


def test_documents_have_ids_of_their_own(spark, tmp_path):
    for name in ("Ada", "Bob"):
        doc = {"entities": [{"id": "e1", "name": name, "entity_type": "person"}], "observations": [{"entity_id": "e1", "content": f"of {name}"}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    g, counts = D.import_rows(Graph.of(spark), D.read_documents(spark, str(tmp_path)), NOW)
    owned = g.observations.join(g.entities.selectExpr("id entity_id", "name"), "entity_id")
    assert rows(owned, "name", "content") == [("Ada", "of Ada"), ("Bob", "of Bob")]
    assert rows(counts, "table", "imported", "skipped") == [("entities", 2, 0), ("observations", 2, 0), ("relationships", 0, 0)]


def test_overtaken_writer_fails(spark, tmp_path):
    """A loads, B commits, A may not commit: its tables lack what B wrote."""
    store = str(tmp_path / "store")
    tables.save_graph(sample(spark), store, "v1")
    a, b = tables.load_graph(spark, store), tables.load_graph(spark, store)
    tables.save_graph(b.replace(observations=b.observations.limit(0)), store, "v2")
    with pytest.raises(tables.StaleSnapshot):
        tables.save_graph(a, store, "v3")
    assert tables.load_graph(spark, store).observations.count() == 0
    first, second = tables.load_graph(spark, str(tmp_path / "new")), tables.load_graph(spark, str(tmp_path / "new"))
    tables.save_graph(first, str(tmp_path / "new"), "v1")
    with pytest.raises(tables.StaleSnapshot):
        tables.save_graph(second, str(tmp_path / "new"), "v1")


def test_overtaken_batch_is_applied_again(spark, tmp_path, monkeypatch):
    """Between a batch's load and its commit another stream commits to the same table: both batches count."""
    from knotwork.streaming import ingest

    store, real, calls = str(tmp_path / "store"), ingest.apply_records, []

    def slow(*args):
        calls.append(1)
        if len(calls) == 1:
            push(spark, tmp_path, "b", store, record("entity", 1, name="Bob", entity_type="person"), record("observation", 2, name="Bob", content="b"))
        return real(*args)

    monkeypatch.setattr(ingest, "apply_records", slow)
    push(spark, tmp_path, "a", store, record("entity", 1, name="Ada", entity_type="person"), record("observation", 2, name="Ada", content="a"))
    g = tables.load_graph(spark, store)
    assert rows(g.entities, "name") == [("Ada",), ("Bob",)] and rows(g.observations, "content") == [("a",), ("b",)]
    assert len(calls) == 3 and sorted(tables.read_manifest(spark, store)["streams"].values()) == [0, 0]


def test_a_version_name_used_twice(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    tables.save_graph(sample(spark), store, "v1")
    with monkeypatch.context() as m:
        m.setattr(tables, "_write_manifest", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            tables.save_graph(Graph.of(spark), store, "v1")
    assert tables.load_graph(spark, store).entities.count() == 2


def many(spark, n=200):
    return graph(spark, [(f"e{i}", f"Name {i}", "person") for i in range(n)], [(f"r{i}", f"e{i}", f"e{i + 1}") for i in range(n - 1)], [(f"o{i}", f"e{i}", "fact") for i in range(n)])


def test_a_batch_touches_its_buckets_only(spark, tmp_path, monkeypatch):
    from knotwork.streaming import ingest

    store = str(tmp_path / "store")
    tables.save_graph(many(spark), store, "v1")
    before, read = tables.read_manifest(spark, store), []
    real = ingest.load_graph
    monkeypatch.setattr(ingest, "load_graph", lambda *a, **k: read.append(real(*a, **k)) or read[-1])
    push(
        spark, tmp_path, "a", store,
        record("entity", 1, name="name 7", entity_type="person", description="new"),
        record("relationship", 2, source="Name 7", target="NAME 7", relationship_type="is", weight=0.5),
        record("observation", 3, name="nAme 7", content="more"),
    )
    after = tables.read_manifest(spark, store)
    for name in ("entities", "relationships", "observations"):
        (new,) = [e for e in after["tables"][name] if e not in before["tables"][name] and e["folder"].startswith(f"{name}/version=") and "v1" not in e["folder"]]
        assert len(new["buckets"]) == 1, name
        held = [f for g in read for f in getattr(g, name).inputFiles()]
        assert held and {f.split("bucket=")[1].split("/")[0] for f in held} == {str(new["buckets"][0])}, name
    for name in ("entity_embeddings", "observation_embeddings"):
        assert after["tables"].get(name) == before["tables"].get(name)
    g = tables.load_graph(spark, store)
    assert (g.entities.count(), g.relationships.count(), g.observations.count()) == (200, 200, 201)
    assert g.entities.filter("description = 'new'").count() == 1


def test_buckets_of_a_store(spark, tmp_path):
    store, g = str(tmp_path / "store"), many(spark, 50)
    tables.save_graph(g, store, "v1", buckets=5)
    assert tables.read_manifest(spark, store)["buckets"] == 5
    part = tables.load_graph(spark, store, only={"entities": {1, 3}})
    assert 0 < part.entities.count() < 50 and part.relationships.count() == 49
    tables.save_graph(part.replace(entities=part.entities.withColumn("description", F.lit("x"))), store, "v2", {"entities"}, only={"entities": {3}})
    back = tables.load_graph(spark, store).entities
    assert back.count() == 50
    assert back.filter("description = 'x'").count() == part.entities.filter(tables.bucket_of("entities", 5) == 3).count()


def test_prune_snapshots(spark, tmp_path):
    store, g = str(tmp_path / "store"), sample(spark)
    tables.save_graph(g, store, "v1")
    for n in range(3):
        now = tables.load_graph(spark, store)
        tables.save_graph(now.replace(entities=g.entities), store, f"w{n}", {"entities"})
    under_way = tmp_path / "store" / "entities" / "version=x" / "write=99-abc"
    under_way.mkdir(parents=True)
    assert tables.prune_snapshots(spark, store, 2) == 3  # two of entities and one that had no rows
    assert under_way.exists() and len(list((tmp_path / "store").glob("manifest-*.json"))) == 2
    back = tables.load_graph(spark, store)
    assert (back.entities.count(), back.relationships.count(), back.observations.count()) == (2, 1, 1)
    with pytest.raises(ValueError):
        tables.prune_snapshots(spark, store, 0)


def test_imported_edges_and_facts_are_mapped_once(spark, tmp_path):
    """Counting what was skipped does not read or map the imported rows again."""
    g = graph(spark, [("a", "Ann", "person"), ("b", "Bob", "person")], [("r", "a", "b"), ("q", "a", "x")], [("f", "a", "tall"), ("h", "y", "lost")])
    g.relationships.write.parquet(f"{tmp_path}/edges")
    g.observations.write.parquet(f"{tmp_path}/facts")
    rows_in = {"entities": g.entities, "relationships": spark.read.parquet(f"{tmp_path}/edges"), "observations": spark.read.parquet(f"{tmp_path}/facts")}
    rows_in = {name: df.withColumn("seq", F.col("id")) for name, df in rows_in.items()}
    after, counts = D.import_rows(Graph.of(spark), rows_in, NOW, keep_ids=True)
    assert not [f for f in counts.inputFiles() if str(tmp_path) in f]
    assert rows(counts, "table", "imported", "skipped") == [("entities", 2, 0), ("observations", 1, 1), ("relationships", 1, 1)]
    assert [r.id for r in after.relationships.collect()] == ["r"] and [r.id for r in after.observations.collect()] == ["f"]
