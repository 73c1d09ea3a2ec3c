"""Removed passages against a set of all windows."""

import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
import zstandard

from knotwork.llm import chunks, suffix_dedup
from knotwork.llm.suffix_dedup import LENGTH, remove_repeats


def brute(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for s in range(len(data) - LENGTH + 1):
                w = data[s : s + LENGTH]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * (len(data) + 1)
        if i is not None:
            for s in range(len(data) - LENGTH + 1):
                if first[data[s : s + LENGTH]] < i:
                    gone[s : s + LENGTH] = [True] * LENGTH
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(data)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((-1 if i is None else i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int").repartition(4)
    got = remove_repeats(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == brute(rows)


def test_random(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 4000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    monkeypatch.setattr(suffix_dedup, "REGIONS", 20)
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [say(rng.randint(40, 200)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 300), (5, "x" * 51), (None, "x" * 80), (6, "ab" * 90), (7, "ba" * 90)]
    for i in range(8, 150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(say(rng.randint(0, 120)))
            parts.append(rng.choice(shared)[rng.randint(0, 30) :])
        rows.append((i * 7 % 151 + 200, "".join(parts)))
    rows += [rows[20], rows[20], (9000, rows[30][1])]
    check(spark, rows)


def test_documents(spark):
    rows = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    check(spark, rows)


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "é" * 40, "de"), (2, "z" + "é" * 40 + "!", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept_text, r.lang) for r in remove_repeats(docs, carry=("lang",), texts=True).collect()}
    assert got == {1: ("é" * 40, "de"), 2: ("z!", None)}
    assert remove_repeats(docs.limit(0)).count() == 0


def test_clashing_names_and_ids(spark):
    docs = spark.createDataFrame([(1, "q" * 60, "a", "b"), (2, "q" * 60, "c", None)], "N_Bytes int, text string, kept_text string, n_spans string")
    got = remove_repeats(docs, id_col="N_Bytes", carry=("kept_text", "n_spans"), texts=True)
    assert got.columns == ["N_Bytes", "kept_text", "n_spans", "n_bytes_", "n_removed", "n_spans_", "kept_sha256", "kept_text_"]
    assert sorted((r.N_Bytes, r.kept_text, r.n_spans, r.n_bytes_, r.n_spans_, r.kept_text_) for r in got.collect()) == [
        (1, "a", "b", 60, 0, "q" * 60), (2, "c", None, 60, 1, "")
    ]
    with pytest.raises(TypeError):
        remove_repeats(docs.withColumn("id", docs.text), id_col="id")


def test_windows_are_decided_in_little_memory():
    """A group of a million windows takes some 40 bytes a window at most, and keeps each window's smallest id."""
    rng = np.random.default_rng(5)
    base = rng.integers(97, 101, 200_000).astype(np.uint8)
    payloads, told = [], []
    for _ in range(40):
        starts, sizes, ids = rng.integers(0, len(base) - 100, 1500), rng.integers(50, 84, 1500), rng.integers(0, 500, 1500)
        body = b"".join(base[a : a + n].tobytes() for a, n in zip(starts, sizes))
        payloads.append(zstandard.ZstdCompressor().compress(np.uint32(1500).tobytes() + ids.astype("<i8").tobytes() + sizes.astype("<u2").tobytes() + body))
        told += [(int(i), body_at.tobytes()) for i, a, n in zip(ids, starts, sizes) for body_at in (base[x : x + 50] for x in range(a, a + n - 49))]
    suffix_dedup._decide_windows(payloads[:1])
    tracemalloc.start()
    answers, _ = suffix_dedup._decide_windows(payloads)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(told)
    least = {}
    for i, text in told:
        least[text] = min(i, least.get(text, i))
    flags, at = [], 0
    for p in answers:
        flags.append((p, at))
        at += sum(n - 49 for n in _sizes(payloads[len(flags) - 1]))
    for k, (p, lo) in enumerate(flags):
        hi = flags[k + 1][1] if k + 1 < len(flags) else len(told)
        got = np.unpackbits(np.frombuffer(p, np.uint8), count=hi - lo).astype(bool)
        assert got.tolist() == [i > least[text] for i, text in told[lo:hi]]


def _sizes(payload):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    return np.frombuffer(raw[4 + 8 * n : 4 + 10 * n], "<u2").astype(int).tolist()
