"""Steps whose work must not grow faster than their input."""

import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import people
from knotwork.operators import text, traverse, vector
from knotwork.plans import queries
from knotwork.session import packed, partitions_for, shuffle_partitions


def test_terms_that_many_ask_for_are_frequent(spark, monkeypatch):
    """Every user asks for all users: the pairs are not made, and the answers stay the same."""
    docs = spark.createDataFrame([(f"u{n}", f"user {n} user") for n in range(80)], "id string, text string")
    index = text.build_text_index(docs)
    asked = docs.withColumnRenamed("id", "query_id")
    monkeypatch.setattr(text, "HOT_PAIRS", 10**12)
    plain = sorted(text.bm25_topk(asked, index, 5).collect())
    bounded, inner = [], text._hot_set_topk
    monkeypatch.setattr(text, "HOT_PAIRS", 1000)
    monkeypatch.setattr(text, "_hot_set_topk", lambda *a: bounded.append(1) or inner(*a))
    assert sorted(text.bm25_topk(asked, index, 5).collect()) == plain
    assert bounded and len(plain) == 400


def test_shuffles_are_divided_by_rows(spark, monkeypatch):
    before = shuffle_partitions(spark)
    try:
        partitions_for(spark, 10)
        assert shuffle_partitions(spark) == before
        monkeypatch.setattr("knotwork.session.PARTITION_ROWS", 100)
        queries.QUERIES["graph_counts"](spark, "/root/testdata/sf0.001")
        assert shuffle_partitions(spark) > 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_are_encoded_in_small_frames():
    batch = pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(150)]), pa.array([f"word {n}" for n in range(150)])], names=["content_hash", "text"])
    frames = list(vector._encode_rows(vector.hashed_words(16))(iter([batch])))
    assert [f.num_rows for f in frames] == [64, 64, 22]
    whole = np.concatenate([np.array(f.column("embedding").to_pylist()) for f in frames])
    assert np.allclose(whole, vector.hashed_words(16)(batch.column("text").to_pylist()))


def test_packed_frames_come_back_whole(spark):
    """Nulls, nested values and empty frames; what Parquet does not hold is checkpointed."""
    rows = [(1, None, ["a", None], {"k": 1.5}), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "n long, s string, a array<string>, m map<string,double>")
    assert sorted(packed(df).collect(), key=str) == sorted(df.collect(), key=str)
    assert packed(df.limit(0)).columns == df.columns and packed(df.limit(0)).count() == 0
    assert packed(df.selectExpr("n", "null as nothing")).count() == 2
    assert packed(df.selectExpr("n", "s as N")).count() == 2
    assert "parquet" in packed(df).inputFiles()[0]


def test_texts_reach_python_in_small_batches(spark):
    from knotwork.llm import common

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        common.small_batches(spark)
        sizes = spark.range(0, 2500, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long")
        assert max(r.n for r in sizes.collect()) <= common.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stored_postings_are_packed_and_dealt_by_id(spark):
    """Postings lie in packed buckets by document: what a document scores is added up without moving them."""
    docs = spark.createDataFrame([("a", "red ring"), ("b", "red red"), (None, "ring"), ("a", "red ring")], "id string, text string")
    index = text.build_text_index(docs)
    assert all(".zstd.parquet" in f for f in index.postings.inputFiles()) and index.terms.inputFiles()
    per_id = index.postings.groupBy("id").agg(F.sum("part"))
    assert "Exchange" not in per_id._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.id), r.term) for r in index.postings.collect()) == [("None", "ring"), ("a", "red"), ("a", "ring"), ("b", "red")]
    assert {r.term: r.df for r in index.terms.collect()} == {"red": 2, "ring": 2}


def test_shuffles_of_an_ended_job_are_dropped(spark):
    """What a step of a query shuffled is off the disk when the step is written."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(",")))
    queries.QUERIES["graph_counts"](spark, "/root/testdata/sf0.001")
    before = names()
    packed(spark.range(20000).repartition(5, "id").groupBy("id").count())
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.1)
    assert not names() - before


def test_candidates_meet_the_postings_of_their_documents_only(spark, monkeypatch):
    """Of a candidate no row is made for terms of its query that the document lacks; both ways give the same scores."""
    words = " ".join(f"w{n}" for n in range(40))
    asked = spark.createDataFrame([(f"q{n}", f"w{i}", 1.0) for n in range(5) for i in range(40)], "query_id string, term string, idf double")
    postings = text.build_text_index(spark.createDataFrame([(f"d{n}", f"w{n}") for n in range(30)] + [("all", words)], "id string, text string")).postings
    candidates = spark.createDataFrame([(f"q{n}", f"d{i}") for n in range(5) for i in range(30)] + [("q0", "all")], "query_id string, id string")
    near = text._full_scores(candidates, asked, postings, "query_id")
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "term#" in joins[0] and "query_id#" in joins[0] and "id#" in joins[1] and "term#" not in joins[1]
    monkeypatch.setattr("knotwork.session.BROADCAST_BYTES", 0)
    assert sorted(text._full_scores(candidates, asked, postings, "query_id").collect()) == sorted(near.collect()) and near.count() == 151


def test_written_steps_are_packed(spark):
    """The two-way edge list of large frontiers is packed and dealt by start, hubs spread over slots or not."""
    g = people(spark, "abc", [("a", "b"), ("b", "c"), ("a", "b", "likes")])
    steps = traverse.written_steps(g)
    assert steps.frame.inputFiles() and all(".zstd.parquet" in f for f in steps.frame.inputFiles())
    assert sorted(tuple(r) for r in steps.frame.select("from_id", "to_id", "direction").collect())[:3] == [("a", "b", "outgoing")] * 2 + [("b", "a", "incoming")]
    assert steps.frame.count() == 6
