"""Exact nearest-neighbour search, text embedding with a cache, and vector upkeep."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.model import Graph
from knotwork.operators.relations import page_of
from knotwork.session import collapse, cut, expand, packed, sized

#: Rows of vectors or queries that meet in one task group.
BLOCK_ROWS = 8192
#: Numbers in the largest array of a task: scores of a strip of queries, or distances to pivots.
STRIP_SCORES = 1 << 20
MAX_PIVOTS = 1024
PLACES = 9
SHOWN_PLACES = 6
SLACK = 4e-6

#: The groups of cells that a query visits and, as bits by their places, the cells it opens in each.
VISITS = "query_id string, embedding array<float>, grps array<string>, opened array<binary>"


def _matrix(column: pd.Series, metric: str) -> np.ndarray:
    """Vectors as rows; for cosine they are scaled to length one."""
    m = np.array(column.tolist(), dtype=np.float64)
    if metric == "cosine":
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    return m


def _frame(**columns) -> pd.DataFrame:
    """Result rows with plain object columns for text and lists, whatever pandas would infer."""
    return pd.DataFrame(
        {
            name: pd.Series(list(c), dtype=None if getattr(c, "dtype", "O") == np.float64 else object)
            for name, c in columns.items()
        }
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _block_topk(k: int, metric: str) -> Callable:
    """Task helper: best ``k`` vectors of one block for each query of one block, among the cells it visits.

    Queries are taken a strip at a time, so that no array has more than about ``STRIP_SCORES`` numbers.
    """

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return _frame(query_id=[], id=[], score=np.zeros(0))
        vectors, queries = vectors.sort_values("id", kind="stable"), queries.sort_values("cells", kind="stable")
        v, q = _matrix(vectors["embedding"], metric), _matrix(queries["embedding"], metric)
        opened = np.frombuffer(b"".join(queries["cells"]), dtype=np.uint8).reshape(len(q), -1)
        place, step = vectors["place"].to_numpy(), max(1, STRIP_SCORES // len(v))
        parts = []
        for at in range(0, len(q), step):
            seen = np.unpackbits(opened[at : at + step], axis=1).astype(bool)
            some = np.nonzero(seen.any(axis=0)[place])[0]
            seen = seen[:, place[some]]
            row, col, score = _strip_topk(q[at : at + step], v[some], seen, k, metric)
            parts.append((row + at, some[col], score))
        rows, cols, scores = (np.concatenate(x) for x in zip(*parts))
        return _frame(
            query_id=queries["query_id"].to_numpy(dtype=object)[rows],
            id=vectors["id"].to_numpy(dtype=object)[cols],
            score=scores,
        )

    return run


def _strip_topk(q: np.ndarray, v: np.ndarray, seen: np.ndarray, k: int, metric: str):
    """Row, column and rounded score of the ``k`` best of ``v`` for each of ``q``, where ``seen``; ties to the first."""
    near = q @ v.T if metric == "cosine" else -_distances(q, v)
    pick = seen
    if near.shape[1] > k:
        if not seen.all():
            near[~seen] = -np.inf
        kth = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        pick = seen & (near >= kth - 2 * 10.0**-PLACES)  # what may round to the k-th score
    rows, cols = np.nonzero(pick)
    scores = np.round(near[rows, cols], PLACES) + 0.0
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    top = np.arange(len(rows)) - first[rows] < k
    return rows[top], cols[top], scores[top]


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _shown(best: DataFrame) -> DataFrame:
    return best.withColumn("score", F.round("score", SHOWN_PLACES))


def _scan(pairs: DataFrame, vectors: DataFrame, cells: DataFrame, k: int, metric: str) -> DataFrame:
    """Score ``pairs(query_id, embedding, cell)`` against ``vectors(id, embedding, cell)``; each cell is a group."""
    alone = F.unhex(F.lit("80"))
    pairs = pairs.select("query_id", "embedding", F.array("cell").alias("grps"), F.array(alone).alias("opened"))
    vectors = vectors.select("id", "embedding", F.col("cell").alias("grp"), F.lit(0).alias("place"))
    return _scan_groups(pairs, vectors, cells.select(F.col("cell").alias("grp"), "n"), k, metric)


def _scan_groups(pairs: DataFrame, vectors: DataFrame, sizes: DataFrame, k: int, metric: str) -> DataFrame:
    """Score ``pairs(query_id, embedding, grps, opened)`` against ``vectors(id, embedding, grp, place)``.

    A query visits groups of cells and names the cells of each group that it opens by their places, as bits; only these
    are scored. A group's vectors are split into blocks and so are the queries that visit it, hence no task group
    grows with the size of a group or the number of its visits, and a vector is copied once for every
    ``BLOCK_ROWS`` visits of its group. Groups nobody visits are not moved.
    """
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    pairs = packed(pairs)
    visits = pairs.select(F.explode("grps").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("visits"))
    visits = visits.join(sizes.select("grp", "n"), "grp")
    visits = sized(visits.select("grp", blocks("n").alias("blocks"), blocks("visits").alias("query_blocks")))
    v = vectors.join(visits, "grp").select(
        "grp", part("id", F.col("blocks")).alias("block"), numbers("query_blocks").alias("query_block"),
        "id", "embedding", "place",
    )
    q = (
        pairs.select("query_id", "embedding", F.explode(F.arrays_zip("grps", "opened")).alias("x"))
        .select("query_id", "embedding", F.col("x.grps").alias("grp"), F.col("x.opened").alias("cells"))
        .join(visits, "grp")
        .select(
            "grp", numbers("blocks").alias("block"), part("query_id", F.col("query_blocks")).alias("query_block"),
            "query_id", "embedding", "cells",
        )
    )
    key = ["grp", "block", "query_block"]
    return (
        v.groupBy(*key)
        .cogroup(q.groupBy(*key))
        .applyInPandas(_block_topk(k, metric), "query_id string, id string, score double")
    )


@dataclasses.dataclass(frozen=True)
class Grouping:
    """Which group each cell is in, its place there, and the cells of every group."""

    prefix: str
    group: np.ndarray
    place: np.ndarray
    members: list[np.ndarray]

    @classmethod
    def of(cls, prefix: str, group: np.ndarray) -> "Grouping":
        members = [np.nonzero(group == i)[0] for i in range(int(group.max()) + 1)]
        place = np.zeros(len(group), dtype=np.int64)
        for cells in members:
            place[cells] = np.arange(len(cells))
        return cls(prefix, group, place, members)

    def rows(self) -> list[tuple[str, str, int]]:
        """``(cell, grp, place)`` of every cell."""
        return [(f"{self.prefix}{c}", f"{self.prefix}{g}", int(p)) for c, (g, p) in enumerate(zip(self.group, self.place))]

    def opened(self, visit: np.ndarray) -> tuple[list, list]:
        """The groups of each row of ``visit(row, cell)``, and the cells it opens there as bits."""
        grps, bits = [[] for _ in visit], [[] for _ in visit]
        for i, cells in enumerate(self.members):
            inside, name = visit[:, cells], f"{self.prefix}{i}"
            packed = np.packbits(inside, axis=1)
            for row in np.nonzero(inside.any(axis=1))[0]:
                grps[row].append(name)
                bits[row].append(packed[row].tobytes())
        return grps, bits


def in_groups(placed: DataFrame, cells: DataFrame, groupings: list[Grouping]) -> tuple[DataFrame, DataFrame]:
    """``placed(id, embedding, cell)`` with its group and place, and the rows of every group."""
    rows = [r for grouping in groupings for r in grouping.rows()]
    named = cut(placed.sparkSession.createDataFrame(rows, "cell string, grp string, place int"))
    sizes = cells.join(named, "cell").groupBy("grp").agg(F.sum("n").alias("n"))
    return placed.join(F.broadcast(named), "cell").select("id", "embedding", "grp", "place"), sizes


def _near_groups(pivots: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The group of each cell: pivots are halved across their widest axis until a group fits a block."""
    group, todo, n = np.zeros(len(size), dtype=np.int64), [np.arange(len(size))], 0
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or size[cells].sum() <= BLOCK_ROWS:
            group[cells], n = n, n + 1
            continue
        order = cells[np.argsort(pivots[cells, pivots[cells].var(axis=0).argmax()], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return group


def _cells_of(pivots: np.ndarray, metric: str) -> Callable:
    """Task helper: nearest pivot of each vector and the distance to it."""
    step = max(1, STRIP_SCORES // len(pivots))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.iloc[at : at + step]
                far = _distances(_matrix(batch["embedding"], metric), pivots)
                cell = far.argmin(axis=1)
                yield _frame(
                    id=batch["id"], embedding=batch["embedding"], cell=[str(c) for c in cell],
                    reach=far[np.arange(len(batch)), cell],
                )

    return run


def _choose(
    pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, grouping: Grouping, k: int, metric: str, first: bool
) -> Callable:
    """Task helper: cells to visit per query, by group.

    First the nearest cells holding ``k`` vectors; then, knowing the k-th distance found there,
    every other cell that the triangle inequality does not rule out. One row a query, a slice at a time.
    """
    step = max(1, STRIP_SCORES // len(pivots))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.iloc[at : at + step]
                far = _distances(_matrix(batch["embedding"], metric), pivots)
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                opening = np.zeros(far.shape, dtype=bool)
                np.put_along_axis(opening, order, (held - size[order]) < k, axis=1)
                opening &= size > 0
                if first:
                    visit = opening
                else:
                    bound = batch["bound"].to_numpy(dtype=np.float64)[:, None]
                    near = np.maximum(far - radius, 0.0)
                    visit = ~opening & (size > 0) & (near * near <= bound * bound + SLACK + SLACK * bound)
                grps, opened = grouping.opened(visit)
                yield _frame(query_id=batch["query_id"], embedding=batch["embedding"], grps=grps, opened=opened)

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Exact ``k`` nearest of ``vectors(id, embedding[, owner])`` for ``queries(query_id, embedding)``.

    Returns query_id, id, score, rank. The score is the cosine similarity, or for ``l2`` the negated
    distance. A query is compared with the vectors of its own dimension; one that has none gets no
    rows. Vectors are grouped around pivots and a query visits only groups that can hold one of its
    neighbours. With an ``owner`` column on both sides a query searches its owner's vectors only.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    scope = [c for c in ("owner",) if c in queries.columns]
    queries = queries.withColumn("query_id", F.col("query_id").cast("string"))
    queries, standing = collapse(queries, ["embedding", *scope])
    if scope:
        cell = F.to_json(F.array(F.col("owner").cast("string"), F.size("embedding").cast("string")))
        pairs, own = (df.withColumn("cell", cell).drop("owner") for df in (queries, vectors))
        cells = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return expand(_shown(_best(_scan(pairs, own, cells, k, metric), k)), standing)

    # One search for each dimension that queries and vectors share: as many as there are models.
    size = lambda df: df.select(F.size("embedding").alias("dim")).filter("dim > 0").distinct()
    dims = [r.dim for r in size(queries).join(size(vectors), "dim").orderBy("dim").collect()]
    found = queries.select("query_id").limit(0).withColumns({"id": F.lit(""), "score": F.lit(0.0)})
    for dim in dims:
        of = lambda df: df.filter(F.size("embedding") == dim)  # noqa: E731, B023
        found = found.unionByName(_search(of(queries), of(vectors).select("id", "embedding"), k, metric))
    return expand(_shown(_best(found, k)), standing)


def _search(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """Scored candidates (query_id, id, score) that hold the nearest; all vectors have one dimension."""
    total = vectors.count()
    wanted = min(MAX_PIVOTS, max(1, int(total**0.5)))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").toPandas()
    pivots = _matrix(sample["embedding"], metric)
    placed = packed(
        vectors.mapInPandas(
            _cells_of(pivots, metric), "id string, embedding array<float>, cell string, reach double"
        )
    )
    cells = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")))
    size, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for row in cells.collect():  # one row per pivot, MAX_PIVOTS at most
        size[int(row.cell)], radius[int(row.cell)] = row.n, row.radius
    grouping = Grouping.of("", _near_groups(pivots, size))
    grouped, sizes = in_groups(placed, cells, [grouping])
    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    opening = asked.mapInPandas(_choose(pivots, radius, size, grouping, k, metric, True), VISITS)
    found = packed(_best(_scan_groups(opening, grouped, sizes, k, metric), k).drop("rank"))
    worst = F.min("score")
    distance = F.sqrt(F.greatest(2 - 2 * worst, F.lit(0.0))) if metric == "cosine" else -worst
    bounds = found.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, distance).otherwise(F.lit(float("inf"))).alias("bound")
    )
    bounded = asked.join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf")))
    )
    others = bounded.mapInPandas(_choose(pivots, radius, size, grouping, k, metric, False), VISITS)
    return found.unionByName(_scan_groups(others, grouped, sizes, k, metric))


# --- embedding texts ------------------------------------------------------------------------

WORD = re.compile(r"\w+")
ENCODE_BATCH = 64


@functools.lru_cache(maxsize=65536)
def _bucket(word: str, dim: int) -> int:
    return hashlib.md5(word.encode("utf-8")).digest()[0] * dim // 256


def hashed_words(dim: int = 64, unit_length: bool = True) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a model: word counts hashed into ``dim`` places."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in WORD.findall(text.lower()):
                out[row, _bucket(word, dim)] += 1
        if not unit_length:
            return out
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)

    return encode


def _encode_rows(encoder: Callable[[list[str]], np.ndarray]) -> Callable:
    """Task helper: vectors of texts, of which only ``ENCODE_BATCH`` at a time are Python objects."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_BATCH):
                part = batch.slice(at, ENCODE_BATCH)
                made = np.asarray(encoder(part.column("text").to_pylist()), dtype=np.float32)
                if len(made) != part.num_rows or made.ndim != 2:
                    raise ValueError(f"encoder gave shape {made.shape} for {part.num_rows} texts")
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                vectors = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("content_hash"), vectors], names=["content_hash", "embedding"])

    return run


def embed_texts(
    df: DataFrame, encoder, cache: DataFrame, model_name: str, now
) -> tuple[DataFrame, DataFrame]:
    """Vectors for ``df(id, text)`` and the next state of ``cache``.

    Each distinct text without a cached vector of this model is encoded once, in batches; cached
    ones only get a new last-used time.
    """
    hashed = df.withColumn("content_hash", F.sha2("text", 256))
    mine = cache.filter(F.col("model_name") == model_name)
    todo = (
        hashed.groupBy("content_hash").agg(F.first("text").alias("text"))
        .join(mine.select("content_hash"), "content_hash", "left_anti")
    )
    made = packed(todo.mapInArrow(_encode_rows(encoder), "content_hash string, embedding array<float>"))
    vectors = mine.select("content_hash", "embedding").unionByName(made)
    result = hashed.join(vectors, "content_hash").select("id", "content_hash", "embedding")
    stamp = F.lit(now).cast("timestamp")
    used = hashed.select("content_hash", F.lit(model_name).alias("model_name")).distinct()
    kept = cache.join(used.withColumn("hit", F.lit(True)), ["content_hash", "model_name"], "left").select(
        "content_hash", "model_name", "embedding",
        F.when(F.col("hit"), stamp).otherwise(F.col("last_used")).alias("last_used"),
    )
    new = made.select(
        "content_hash", F.lit(model_name).alias("model_name"), "embedding", stamp.alias("last_used")
    )
    return result, kept.unionByName(new)


# --- upkeep ---------------------------------------------------------------------------------


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the vectors whose id is in ``new`` and add the others."""
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new)


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id"), "id", "left_anti")


def prune_cache(cache: DataFrame, n: int) -> DataFrame:
    """Keep the ``n`` most recently used entries, by the full (content_hash, model_name) key."""
    order = [F.col("last_used").desc(), F.col("content_hash").asc(), F.col("model_name").asc()]
    return page_of(cache, order, n)


def embedding_report(g: Graph) -> DataFrame:
    """Vectors per model and dimension, and counts of missing and orphan vectors."""

    def parts(table: str, vectors: DataFrame, owners: DataFrame):
        n = F.count(F.lit(1)).alias("n")
        name = F.lit(table).alias("table")
        ids = owners.select("id")
        return [
            vectors.groupBy("model_name", F.size("embedding").alias("dim")).agg(n).select(
                name, F.lit("stored").alias("kind"), "model_name", "dim", "n"
            ),
            vectors.join(ids, "id", "left_anti").agg(n).select(
                name, F.lit("orphan").alias("kind"), F.lit(None).cast("string"), F.lit(None).cast("int"), "n"
            ),
            ids.join(vectors.select("id"), "id", "left_anti").agg(n).select(
                name, F.lit("missing").alias("kind"), F.lit(None).cast("string"), F.lit(None).cast("int"), "n"
            ),
        ]

    frames = parts("entities", g.entity_embeddings, g.entities) + parts(
        "observations", g.observation_embeddings, g.observations
    )
    return functools.reduce(DataFrame.unionAll, frames)
