"""Neighbours against brute force."""

import numpy as np
import pytest

from knotwork.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, score double, id string"


def brute(rows, every, k):
    held = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = tuple(float(np.float32(x)) for x in v)
        held[i] = min(held.get(i, v), v)
    out = {}
    for q, a in held.items():
        if q % every == 0:
            a = np.array(a)
            near = [(-(a @ np.array(b)) / np.linalg.norm(a) / np.linalg.norm(b), i) for i, b in held.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = [len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w]
    return np.mean(hits)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), 0.0, "") for i in range(40)]
    rows += [(50 + i, [1.0, 2.0, 3.0, 4.0], 0.0, "") for i in range(12)]  # ties
    rows += [(None, [1.0] * 4, 0.0, ""), (60, None, 0.0, ""), (70, [], 0.0, ""), (80, [0.0] * 4, 0.0, ""), (90, [1.0, None, 1.0, 1.0], 0.0, "")]
    rows += [(100, [float("nan")] * 4, 0.0, ""), (110, [float("inf"), 0.0, 0.0, 0.0], 0.0, ""), (120, [1.0], 0.0, ""), (130, [3.0], 0.0, ""), (140, [1.0, 1.0], 0.0, "")]
    rows += [(150, [1e-40, 0.0, 0.0, 1e-40], 0.0, ""), (160, [3e38] * 4, 0.0, ""), rows[0], (10, [9.0, 9.0, 9.0, 9.0], 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = by_query(multi_index.neighbours(df, 10, 5)), brute(rows, 10, 5)
    assert set(got) == {q for q, w in want.items() if w}
    for q, found in got.items():
        assert len(found) == len(want[q])
        for (i, s), (j, t) in zip(found, want[q], strict=True):
            assert s == pytest.approx(t, abs=1e-9), (q, i, j)
    assert [i for i, _ in got[50]] == [51, 52, 53, 54, 55]
    assert multi_index.neighbours(df.limit(0), 10, 5).count() == 0
    assert multi_index.neighbours(df.filter("vec_id = 60"), 10, 5).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "check_h"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    at = np.flatnonzero(ids % 50 == 0)
    near = unit[at] @ unit.T
    near[np.arange(len(at)), at] = -2
    want = {int(ids[q]): [(int(ids[i]), float(near[n, i])) for i in np.lexsort((ids, -near[n]))[:5]] for n, q in enumerate(at)}
    got = by_query(multi_index.neighbours(df, 50, 5))
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        assert len(found) == 5
        for i, s in found:
            assert s == pytest.approx(float(unit[ids == q][0] @ unit[ids == i][0]), abs=1e-12)


def test_heap_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    sums = [a[i] + b[j] for i, j in multi_index.cells_in_order(a, b)]
    assert len(sums) == 63 and sums == sorted(sums)


def test_only_visited_cells_are_ranked(spark):
    """The heap decides: an index that asks for few entries misses neighbours that the measured one finds."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = multi_index.keep(multi_index.usable(df, "vec_id", "embedding"), "vectors")
    index = multi_index.build(rows, 64)
    queries = rows.filter("id % 50 = 0")
    measured = {(r.query_id, r.id) for r in multi_index.search(index, queries, 5).collect()}
    index.ask = 1
    few = {(r.query_id, r.id) for r in multi_index.search(index, queries, 5).collect()}
    assert len(few & measured) < 0.6 * len(measured)
