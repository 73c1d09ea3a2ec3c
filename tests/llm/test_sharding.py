"""The weighted hash tree: gapless slots, moves into the new shard only, shares by weight."""

import zlib

from pyspark.sql import functions as F

from knotwork.llm import sharding
from knotwork.llm.sharding import Tree, assign_shards, with_shard


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    rows = [(i, f"text é {i}" if i % 5 else None, "x") for i in range(5000)] + [(7, "same", "x")] * 300 + [(None, "", "x")]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), Tree.even(2, 4, 5)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    by = {r.doc_id: r for r in got}
    for i in (5, 6):
        text = (rows[i][1] or "").encode()
        assert (by[i].size, by[i].text_crc32) == (len(text) + 16, zlib.crc32(text))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sum(r.grown_shard == 40 for r in got) > 60
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string"), Tree.even(2, 4, 5)).count() == 0


def test_an_id_named_like_a_result(spark):
    rows, tree = [(i, f"text {i}") for i in range(50)], Tree.even(2, 4, 5)
    plain = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), tree)
    for name in ("size", "Shard", "slot", "law"):
        got = assign_shards(spark.createDataFrame(rows, f"{name} long, text string"), tree, id_col=name)
        assert got.columns == [name, *(c + "_" * (c == name.lower()) for c in plain.columns[1:])]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_weights_and_moves(spark):
    ids = spark.range(40_000)
    tree = Tree(((((0, 1.0), (1, 3.0)),), (((2, 2.0),), ((3, 2.0),))))
    heavier = Tree(((((0, 1.0), (1, 5.0)),), tree.regions[1]))
    key = F.col("id").cast("string")
    got = with_shard(with_shard(ids, tree, key, "a"), heavier, key, "b")
    counts = {r.a: r["count"] for r in got.groupBy("a").count().collect()}
    assert all(abs(counts[s] / 40_000 - w / 8) < 0.01 for s, w in {0: 1, 1: 3, 2: 2, 3: 2}.items())
    # A heavier subtree draws rows in; none moves between or out of subtrees that stay as they are.
    assert got.filter("a != b and b in (2, 3)").count() == 0
    assert got.filter("a in (2, 3) and b != a").count() > 0


def test_native(spark):
    plan = assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), Tree.even(2, 4, 5))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
