"""Near duplicates: min-max hashing, banding, exact confirmation on full shingle sets, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.arrays import LOWER, blocks, find_words, mix, runs, span_hashes
from knotwork.llm.common import keep, probable, table
from knotwork.llm.graphs import components, sorted_groups

#: Words in a shingle; links need 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 80
#: Permutations; each gives a minimum and a maximum. Rows of a band: a pair at the threshold meets in none
#: of the 32 bands with a chance of 5e-8.
PERMUTATIONS, ROWS = 64, 4
#: Share of equal values from which two members of a bucket are taken for the same family. A pair at the
#: threshold falls below it, in all buckets alike, with a chance of 8e-11; families are confirmed exactly.
ALIKE = 0.55
#: Members of a bucket or family compared in one block.
BLOCK_ROWS = 512

_rng = np.random.default_rng(20240601)
_MULTIPLY = _rng.integers(1, 1 << 31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """Distinct shingles of a block of texts, ordered by text and value, and the text of each."""
    data = LOWER[data]
    starts, ends, doc = find_words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    keys, valid = runs(hashes, doc, words)
    keys, owner = keys[valid], doc[: len(valid)][valid]
    total = np.bincount(doc, minlength=len(offsets) - 1)
    for few in range(1, words):
        short = np.flatnonzero(total == few)
        if len(short):
            at = np.searchsorted(doc, short)
            whole, _ = runs(hashes, doc, few)
            keys, owner = np.concatenate([keys, whole[at]]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]


def signatures(keys: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every set under every permutation."""
    small = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(firsts), 2 * PERMUTATIONS), dtype=np.uint32)
    for i in range(PERMUTATIONS):
        moved = (small + _ADD[i]) * _MULTIPLY[i]
        out[:, i] = np.minimum.reduceat(moved, firsts)
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(moved, firsts)
    return out


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, short signature, band values."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                keys, owner = shingle_sets(data, offsets, words)
                count = np.bincount(owner, minlength=hi - lo)
                full = np.flatnonzero(count)
                one, two, bands = (np.zeros(hi - lo, np.uint64) for _ in range(3))
                short = np.zeros((hi - lo, 2 * PERMUTATIONS), dtype=np.uint8)
                bands = np.zeros((hi - lo, 2 * PERMUTATIONS // ROWS), dtype=np.uint64)
                if len(full):
                    firsts = np.searchsorted(owner, full)
                    one[full] = np.add.reduceat(mix(keys + np.uint64(1)), firsts)
                    two[full] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), firsts)
                    signs = signatures(keys, firsts)
                    short[full] = ((signs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                    wide = signs.astype(np.uint64).reshape(len(full), -1, ROWS)
                    value = np.zeros(wide.shape[:2], dtype=np.uint64)
                    for r in range(ROWS):
                        value = mix(value * np.uint64(0x94D049BB133111EB) + wide[:, :, r] + np.uint64(1))
                    bands[full] = value + np.arange(value.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                n = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(count, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * n, n, dtype=np.int32)), pa.array(mix(bands).view(np.int64).ravel())),
                    ],
                    names=["_id", "n", "one", "two", "signature", "bands"],
                )

    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, n long, one long, two long, signature binary, bands array<long>"
    return docs.mapInArrow(run, schema)


def _tiles(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Deal the rows of large groups to blocks, and every row to the pairs of blocks that it is in."""
    parts = F.ceil(F.col(size) / BLOCK_ROWS).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")).drop("_parts", "_other", size)


def _spread(alike: np.ndarray) -> np.ndarray:
    """Components of a small adjacency matrix: the smallest member reachable from each."""
    label = np.arange(len(alike))
    while True:
        new = np.where(alike, label, len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(nodes: list, alike: np.ndarray):
    """Pairs that connect what ``alike`` connects: every member with the first of its component."""
    label = _spread(alike)
    return [(nodes[i], nodes[k]) for i, k in enumerate(label.tolist()) if i != k]


def _pairs(rows: list, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], names=["a", "b"])


def _families(multi: DataFrame) -> DataFrame:
    """Loose links (a, b) between members of a bucket whose signatures look alike."""
    kind = multi.schema["node"].dataType.simpleString()

    def run(batches):
        out, key_type = [], None
        for _, group in sorted_groups(batches, 3):
            key_type = group.schema.field("node").type
            nodes = group.column("node").to_pylist()
            signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
            if len(nodes) == 2:
                if (signs[0] == signs[1]).mean() >= ALIKE:
                    out.append((nodes[0], nodes[1]))
            else:
                alike = np.empty((len(nodes), len(nodes)), dtype=bool)
                for lo in range(0, len(nodes), 64):
                    alike[lo : lo + 64] = (signs[lo : lo + 64, None, :] == signs[None, :, :]).mean(axis=2) >= ALIKE
                out += _linked(nodes, alike)
            if len(out) >= 5000:
                yield _pairs(out, key_type)
                out = []
        if out:
            yield _pairs(out, key_type)

    tiles = _tiles(multi, "key", "_size").select("key", "_lo", "_hi", "node", "signature")
    dealt = tiles.repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of membership matrices."""
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
        width = max(256, (1 << 22) // len(sets))
        for lo in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            member = np.zeros((len(sets), width), dtype=np.float32)
            member[owner[a:b], column[a:b] - lo] = 1
            out += member @ member.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) confirmed on the full sets, enough to connect what is linked in each family."""
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches):
        for _, group in sorted_groups(batches, 3):
            nodes = group.column("node").to_pylist()
            own = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
            both = _intersections(own)
            size = np.array([len(s) for s in own])
            linked = _linked(nodes, 100 * both >= percent * (size[:, None] + size[None, :] - both))
            if linked:
                yield _pairs(linked, group.schema.field("node").type)

    tiles = _tiles(sets, "family", "_size").select("family", "_lo", "_hi", "node", "shingles")
    dealt = tiles.repartition("family", "_lo", "_hi").sortWithinPartitions("family", "_lo", "_hi")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest linked id), kept (id = component_id).

    Equal sets are one node from the start, under their smallest id. Nodes that share a band and look
    alike by signature form families; within a family every pair is compared on full sets, large families
    block by block, so a link between texts is missed only where the bands or signatures miss it.
    Texts without words have an empty set and are linked with nothing; rows with a null id are linked
    with nothing; rows that share an id share a component; further columns are dropped; an empty table
    gives no rows.
    """
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    found = keep(_profiles(rows, words), "profiles")
    known = found.filter("n > 0 and _id is not null")
    classes = known.groupBy("one", "two", "n").agg(
        F.min("_id").alias("node"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")
    )
    classes = keep(classes, "classes")
    places = classes.select("node", F.explode("bands").alias("key"))
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    multi = places.join(shared, "key").join(classes.select("node", "signature"), "node")
    family = keep(components(_families(multi)), "families")
    family = family.unionAll(family.select(F.col("component").alias("node"), "component").distinct())
    sizes = family.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    members = family.join(sizes, "component").withColumnRenamed("component", "family")

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                keys, owner = shingle_sets(data, offsets, words)
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                each = [keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(each, pa.binary())], names=["node", "shingles"])

    kind = rows.schema["_id"].dataType.simpleString()
    sets = probable(rows.filter("_id is not null"), family.select("node"), "_id").mapInArrow(run, f"node {kind}, shingles binary")
    sets = sets.filter(F.octet_length("shingles") > 0).join(members.hint("merge"), "node")
    linked = components(_links(sets, percent))
    named = classes.select("one", "two", "n", "node").join(linked, "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component_id"))
    out = found.select("_id", "n", "one", "two").join(named, ["one", "two", "n"], "left")
    alone = F.col("_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
