"""Nearest neighbours by an inverted multi-index.

The two halves of a unit vector are quantised separately; a pair of centroids is a cell that lists its
entries. A search goes through the pairs in the order of the summed squared distance of the query's halves,
which a heap yields one by one, until the cells passed hold as many entries as the index asks for. The
entries of those cells are ranked by their exact cosine.

How many entries that takes depends on the data, so it is measured: for at most ``PROBES`` queries the true
neighbours are found by comparing them with all rows in blocks, and the index asks for as many entries as bring in the
share ``RECALL`` of those neighbours. Centroids are fitted to at most ``SAMPLE`` vectors; every vector
is indexed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import keep, table
from knotwork.session import sized

#: Vectors that centroids are fitted to, rounds of fitting, and centroids of a half at most (1,024 squared cells are counted).
SAMPLE, ROUNDS, CENTROIDS = 32_768, 8, 1024
#: Queries whose neighbours are found exactly, and the share of those neighbours that the index must reach.
PROBES, RECALL = 256, 0.96
#: Entries and queries that meet in one task, and products held at once.
ENTRIES, QUERIES, HELD = 16_384, 2_048, 1 << 22
CLOSE = 1e-9


@dataclass
class Index:
    """The index of the vectors of one dimension."""

    dim: int
    centroids: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # entries of each cell
    entries: DataFrame  # id, embedding, first, second
    ask: int | None = None  # entries that a search goes through


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, embedding) of the rows that take part: one for each id, with finite components that are not all zero.

    Of rows with one id, that with the smallest vector counts.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    rows = rows.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows whose squares would run over or vanish are scaled by their largest component."""
    squares = np.einsum("ij,ij->i", m, m)
    odd = ~np.isfinite(squares) | (squares < 1e-280)
    if odd.any():
        m = m.copy()
        m[odd] /= np.abs(m[odd]).max(axis=1, keepdims=True)
    return m


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; a pair's value does not depend on its neighbours."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _squared(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((m * m).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (m @ centroids.T), 0)


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids (fewer, if there are fewer different rows) by Lloyd's rounds from evenly spread rows."""
    rows = np.unique(sample, axis=0)
    centroids = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([_squared(sample[lo : lo + 4096], centroids).argmin(axis=1) for lo in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def build(vectors: DataFrame, dim: int) -> Index:
    """Index ``vectors(id, embedding)``, all of dimension ``dim``."""
    total = vectors.count()
    k = int(min(CENTROIDS, max(1, round(total**0.5 / 4))))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    parts = halves(_unit(_matrix(sample.column(0).combine_chunks(), dim)))
    centroids = fit(parts[0], k), fit(parts[1], k)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                both = [_squared(half, c).argmin(axis=1).astype(np.int32) for half, c in zip(halves(_unit(_matrix(batch.column(1), dim))), shared.value, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, both)], names=["id", "embedding", "first", "second"])

    entries = keep(vectors.select("id", "embedding").mapInArrow(run, "id long, embedding array<double>, first int, second int"), "entries")
    counts = np.zeros((len(centroids[0]), len(centroids[1])), dtype=np.int64)
    for row in entries.groupBy("first", "second").count().collect():  # cells, CENTROIDS squared at most
        counts[row["first"], row["second"]] = row["count"]
    return Index(dim, centroids, counts, entries)


def cells_in_order(first: np.ndarray, second: np.ndarray):
    """Pairs of centroids by ascending sum of the two distances, one at a time."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def calibrate(index: Index, queries: DataFrame, k: int) -> int:
    """Entries that a search must go through, from the true neighbours of a bounded set of queries."""
    probes = queries.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return 0
    asked = _unit(_matrix(probes.column("embedding").combine_chunks(), index.dim))
    own = probes.column("id").to_numpy()
    dim, shared = index.dim, queries.sparkSession.sparkContext.broadcast((asked, own))

    def run(batches):
        q, ids = shared.value
        for batch in batches:
            names, first, second = (batch.column(c).to_numpy() for c in ("id", "first", "second"))
            unit = _unit(_matrix(batch.column("embedding"), dim)) if batch.num_rows else np.zeros((0, dim))
            near = np.where(ids[:, None] == names[None, :], -np.inf, q @ unit.T)
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            probe, rank = np.nonzero(np.take_along_axis(near, top, 1) > -np.inf)
            at = top[probe, rank]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (probe.astype(np.int32), near[probe, at], names[at], first[at], second[at])], names=["probe", "score", "id", "first", "second"])

    order = Window.partitionBy("probe").orderBy(F.col("score").desc(), "id")
    found = index.entries.mapInArrow(run, "probe int, score double, id long, first int, second int")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()  # PROBES times k rows
    wanted: dict[int, dict] = {}
    for row in found:
        cells = wanted.setdefault(row["probe"], {})
        cells[row["first"], row["second"]] = cells.get((row["first"], row["second"]), 0) + 1
    d = [_squared(half, c) for half, c in zip(halves(asked), index.centroids, strict=True)]
    needs = []
    for probe, cells in wanted.items():
        passed, missing = 0, dict(cells)
        for cell in cells_in_order(d[0][probe], d[1][probe]):
            passed += int(index.counts[cell])
            if cell in missing:
                needs += [passed] * missing.pop(cell)
                if not missing:
                    break
    return int(np.quantile(needs, RECALL, method="higher")) if needs else 0


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest entries found for ``queries(id, embedding)``, but for the query's own id."""
    ask = max(index.ask if index.ask is not None else calibrate(index, queries, k), k + 1)
    dim, shared = index.dim, queries.sparkSession.sparkContext.broadcast((index.centroids, index.counts))

    def visit(batches):
        centroids, counts = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                d = [_squared(half, c) for half, c in zip(halves(_unit(_matrix(part.column(1), dim))), centroids, strict=True)]
                row, firsts, seconds = [], [], []
                for q in range(part.num_rows):
                    passed, cells = 0, {}
                    for i, j in cells_in_order(d[0][q], d[1][q]):
                        if counts[i, j]:
                            cells.setdefault(i, []).append(j)
                            passed += int(counts[i, j])
                            if passed >= ask:
                                break
                    row += [q] * len(cells)
                    firsts += cells
                    seconds += cells.values()
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(firsts, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], names=["query_id", "asked", "first", "cells"])

    visits = keep(queries.select("id", "embedding").mapInArrow(visit, "query_id long, asked array<double>, first int, cells array<int>"), "visits")
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    n = index.entries.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    met = visits.groupBy("first").agg(F.count(F.lit(1)).alias("m")).join(n, "first")
    met = sized(met.select("first", blocks("n", ENTRIES).alias("blocks"), blocks("m", QUERIES).alias("shares")))
    part = lambda c, count: F.pmod(F.xxhash64(c), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    entries = index.entries.join(met, "first").select("first", part("id", "blocks").alias("block"), all_of("shares").alias("share"), "id", "embedding", "second")
    asked = visits.join(met, "first").select("first", all_of("blocks").alias("block"), part("query_id", "shares").alias("share"), "query_id", "asked", "cells")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.combine_chunks()
        right = right.combine_chunks()
        ids, second = left.column("id").to_numpy(), left.column("second").to_numpy()
        raw, asks = _matrix(left.column("embedding").chunk(0), dim), _matrix(right.column("asked").chunk(0), dim)
        unit, q, names = _unit(raw), _unit(asks), right.column("query_id").to_numpy()
        lists = right.column("cells").chunk(0)
        cell = lists.flatten().to_numpy()
        asker = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
        by_cell, by_asker = np.argsort(second, kind="stable"), np.argsort(cell, kind="stable")
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        pending, held = [], 0

        def settle():
            nonlocal best, pending, held
            who, at, score = (np.concatenate([best[i], *[p[i] for p in pending]]) for i in range(3))
            order = np.lexsort((ids[at], -score, who))
            who, at, score = who[order], at[order], score[order]
            first = np.searchsorted(who, who, side="left")
            top = np.arange(len(who)) - first < k
            best, pending, held = [who[top], at[top], score[top]], [], 0

        for c in np.unique(second):
            at = by_cell[np.searchsorted(second[by_cell], c) : np.searchsorted(second[by_cell], c, side="right")]
            who = asker[by_asker[np.searchsorted(cell[by_asker], c) : np.searchsorted(cell[by_asker], c, side="right")]]
            step = max(1, HELD // len(at))
            for lo in range(0, len(who), step):
                some = who[lo : lo + step]
                near = q[some] @ unit[at].T
                near[names[some][:, None] == ids[at][None, :]] = -np.inf
                floor = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k] if len(at) > k else -2.0
                rows, cols = np.nonzero((near >= floor - CLOSE) & (near > -np.inf))
                if len(rows):
                    score = np.concatenate([cosines(asks[some[rows[i : i + 65536]]], raw[at[cols[i : i + 65536]]]) for i in range(0, len(rows), 65536)])
                    pending.append((some[rows], at[cols], score))
                    held += len(rows)
                if held > HELD:
                    settle()
        settle()
        return pa.table({"query_id": pa.array(names[best[0]]), "id": pa.array(ids[best[1]]), "score": pa.array(best[2])})

    key = ["first", "block", "share"]
    scored = entries.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(rerank, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row whose id ``every`` divides: query_id, rank, the id column and score, the cosine.

    A query meets vectors of its own dimension, all but its own id. Null or empty vectors, zero vectors, those with null or
    non-finite components and rows without an id take no part; of rows with one id, that with the smallest vector does.
    Equal scores go by id. With fewer than ``k`` candidates all are returned; an empty table gives no rows.
    Other columns are not read.
    """
    rows = keep(usable(vectors, id_col, vector_col), "vectors")
    out = None
    dims = [r["dim"] for r in rows.select(F.size("embedding").alias("dim")).distinct().collect()]  # one for each model
    for dim in sorted(dims):
        mine = rows if len(dims) == 1 else rows.filter(F.size("embedding") == dim)
        found = search(build(mine, dim), mine.filter(F.pmod("id", F.lit(every)) == 0), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op13(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), 50, 5)
