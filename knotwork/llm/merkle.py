"""Merkle manifest of a table: places of leaves by bitmap rank, trees reduced in keyed slot arrays.

The ids of a tree (one for each ``lang``) are a bitmap, kept as containers of 4,096 ids that hold only words
with a bit set. Every container knows how many rows its words and the containers before it have, so the rank of an
id is two additions and one count of bits: leaves get their places without being sorted. A leaf then goes
to its slot in the array of its block of 1,024 places; a block is reduced by ten levels at once, and the
roots of blocks fill the slots of the next arrays. Proofs come down the same way, one row a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import keep, table, train_part
from knotwork.session import shuffle_partitions

#: Levels that one slot array reduces.
LEVELS = 10
#: Bits of an id inside a word and inside a container; entries of one step of the directory are 2 ** STEP.
WORD, CONTAINER, STEP = 6, 12, 13
#: The container of null ids, before all others.
NULLS = -(1 << 51) - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """What ``manifest`` has written: the slot arrays of every level and the root of every tree."""

    rounds: list[DataFrame]  # tree, block, size, ids, nodes, others, root; the first holds the leaves
    trees: DataFrame  # tree, subroot, root, path: from the subroot to the root

    def root(self) -> str | None:
        """The root of all trees; None for an empty table."""
        row = self.trees.select("root").first()
        return row["root"] if row else None


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """Add the place of every row in the order of ``order``, from 0, by ranges: no task sees more than its range."""
    sorted_rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = keep(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return found.withColumn(column, F.col("_before") + F.expr("_at & 8589934591")).drop("_at", "_part", "_before")


def containers(ids: DataFrame) -> DataFrame:
    """Bitmaps of ``ids(tree, c, word, low)``: tree, c, base, words.

    ``words`` maps a word's number to its bits, the rows of the container before it, and whether every id in
    it belongs to one row. ``base`` counts the tree's rows in earlier containers. Sums over directories go by
    steps of 2 ** 13 entries, so no window grows with the table.
    """
    bits = F.expr("bit_or(shiftleft(1L, low))").alias("bits")
    words = ids.groupBy("tree", "c", "word").agg(bits, F.count(F.lit(1)).alias("n"))
    before = lambda key, by: F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = words.withColumn("before", before(("tree", "c"), "word"))
    entry = F.struct("word", F.struct("bits", "before", (F.expr("bit_count(bits)") == F.col("n")).alias("single")))
    held = words.groupBy("tree", "c").agg(F.map_from_entries(F.collect_list(entry)).alias("words"), F.sum("n").alias("n"))
    held = keep(held.withColumns({f"c{i}": F.shiftright("c", STEP * i) for i in (1, 2, 3)}), "bitmaps")
    base, at = held.withColumn("base", before(("tree", "c1"), "c")).drop("n"), held
    for i in (1, 2, 3):
        above = ("tree", f"c{i + 1}") if i < 3 else ("tree",)
        at = at.groupBy("tree", *[f"c{j}" for j in range(i, 4)]).agg(F.sum("n").alias("n"))
        part = at.select("tree", f"c{i}", before(above, f"c{i}").alias("more"))
        base = base.join(part, ["tree", f"c{i}"]).withColumn("base", F.col("base") + F.col("more")).drop("more")
    return base.select("tree", "c", "base", "words")


def places(leaves: DataFrame) -> DataFrame:
    """Add ``pos``, the place of each row of ``leaves(tree, id, leaf, salt, …)`` in its tree, from 0.

    Rows ascend by id, null ids first. Rows with one id ascend by leaf; equal rows take any order, which
    changes no digest. Only rows in a word that has a repeated id are sorted.
    """
    keyed = leaves.withColumns(
        {
            "c": F.coalesce(F.shiftright("id", CONTAINER), F.lit(NULLS)),
            "word": F.coalesce(F.expr(f"cast(shiftright(id, {WORD}) & 63 as int)"), F.lit(0)),
            "low": F.coalesce(F.expr("cast(id & 63 as int)"), F.lit(0)),
        }
    )
    found = keyed.join(containers(keyed.select("tree", "c", "word", "low")), ["tree", "c"])
    found = found.withColumn("w", F.col("words")[F.col("word")])
    below = F.expr("bit_count(w.bits & ~shiftleft(-1L, low))")
    pos = F.col("base") + F.col("w.before") + F.when(F.col("w.single"), below).otherwise(0)
    found = found.withColumns({"pos": pos, "single": F.col("w.single")})
    found = keep(found.drop("low", "base", "words", "w"), "places")
    done, open_ = found.filter("single"), found.filter("not single")
    if not open_.isEmpty():
        key = ["tree", "c", "word"]
        open_ = keep(numbered(open_, [*key, "id", "leaf", "salt"], "index"), "repeated")
        first = open_.groupBy(*key).agg(F.min("index").alias("first"))
        open_ = open_.join(first, key).withColumn("pos", F.col("pos") + F.col("index") - F.col("first"))
        done = done.unionByName(open_.select(found.columns))
    return done.drop("c", "word", "single", "salt")


def _join(a: str, b: str = "") -> str:
    return hashlib.sha256((a + b).encode()).hexdigest()


def climb(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels above the slots of one array: all of them where it is a whole tree, else ``LEVELS``."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        low = levels[-1]
        levels.append([_join(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def steps(levels: list[list[str]], i: int) -> list[str]:
    """One entry a level for slot ``i``: ``L`` or ``R`` and the sibling on that side, or ``-`` where there is none."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(("L" if i & 1 else "R") + level[j] if j < len(level) else "-")
        i >>= 1
    return out


ARRAY = "tree string, block long, size long, ids array<long>, nodes array<string>, others array<string>, root string"


def _fill(slots: DataFrame) -> DataFrame:
    """Slot arrays of ``slots(tree, pos, size, id, node, other)``: one row for each 1,024 places of a tree."""

    def run(rows: pa.Table) -> pa.Table:
        size, n = rows.column("size")[0].as_py(), rows.num_rows
        at = [p & ((1 << LEVELS) - 1) for p in rows.column("pos").to_pylist()]
        out = {}
        for name in ("id", "node", "other"):
            array = [None] * n
            for slot, value in zip(at, rows.column(name).to_pylist(), strict=True):
                array[slot] = value
            out[name] = array
        root = climb(out["node"], size <= 1 << LEVELS)[-1][0]
        tree, block = rows.column("tree")[0].as_py(), rows.column("pos")[0].as_py() >> LEVELS
        values = [[tree], [block], [size], [out["id"]], [out["node"]], [out["other"]], [root]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["tree", "block", "size", "ids", "nodes", "others", "root"])

    keyed = slots.select("tree", "pos", "size", "id", "node", "other", F.shiftright("pos", LEVELS).alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(run, ARRAY)


def _reduce(slots: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of slot arrays, and the root of each tree."""
    rounds, roots = [], None
    while True:
        rounds.append(keep(_fill(slots), "slots"))
        above = rounds[-1].select(
            "tree", F.col("block").alias("pos"), F.expr(f"(size + {(1 << LEVELS) - 1}) div {1 << LEVELS}").alias("size"),
            F.lit(None).cast("long").alias("id"), F.col("root").alias("node"), F.lit(None).cast("string").alias("other"),
        )
        ended = above.filter("size = 1").select("tree", "node")
        roots = ended if roots is None else roots.unionByName(ended)
        slots = above.filter("size > 1")
        if slots.isEmpty():
            return rounds, roots


def _descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Rows (tree, id, node, other, path) of the first round, from ``paths(tree, pos, path)`` of the roots of trees."""

    def expand(last: bool):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    levels = climb(row["nodes"], row["size"] <= 1 << LEVELS)
                    n = len(row["nodes"])
                    path = [steps(levels, i) + row["path"] for i in range(n)]
                    tree = pa.array([row["tree"]] * n, pa.string())
                    if last:
                        columns = [tree, pa.array(row["ids"], pa.int64()), pa.array(row["nodes"]), pa.array(row["others"], pa.string()), pa.array(path, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["tree", "id", "node", "other", "path"])
                    else:
                        first = row["block"] << LEVELS
                        columns = [tree, pa.array(range(first, first + n), pa.int64()), pa.array(path, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "path"])

        return run

    # A tree of few nodes ends in an earlier round, so the paths of roots come in at every round.
    tops, below = paths, None
    for k in range(len(rounds) - 1, -1, -1):
        mine = tops.withColumnRenamed("pos", "block")
        if below is not None:
            whole = mine.join(rounds[k].filter(f"size <= {1 << LEVELS}").select("tree", "block"), ["tree", "block"], "left_semi")
            mine = whole.unionByName(below.withColumnRenamed("pos", "block"))
        met = rounds[k].join(mine, ["tree", "block"])
        if k == 0:
            return met.mapInArrow(expand(True), "tree string, id long, node string, other string, path array<string>")
        below = keep(met.mapInArrow(expand(False), "tree string, pos long, path array<string>"), "paths")


def manifest(leaves: DataFrame) -> Manifest:
    """The trees of ``leaves(tree, id, leaf, other)``; ``other`` is carried along with its leaf.

    ``tree`` is not null; trees are ordered by its UTF-8 bytes. An empty table has no trees.
    """
    leaves = keep(leaves.withColumn("salt", F.rand()), "leaves")
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    slots = places(leaves).join(sizes, "tree").withColumnsRenamed({"leaf": "node"})
    rounds, subroots = _reduce(slots)
    nothing = F.lit(None).cast("string").alias("other")
    of_trees = keep(numbered(subroots, ["tree"], "pos"), "subroots")
    n = of_trees.count()  # the number of trees
    above = of_trees.select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("size"), F.col("pos").alias("id"), "node", nothing)
    upper, roots = _reduce(above)
    start = roots.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"))
    found = _descend(upper, start).select(F.col("id").alias("pos"), F.col("node").alias("subroot"), "path")
    root = roots.select(F.col("node").alias("root"))
    trees = of_trees.select("tree", "pos").join(found, "pos").drop("pos").join(F.broadcast(root.limit(1)), how="cross")  # one row
    return Manifest(rounds, keep(trees, "trees"))


def proofs(made: Manifest) -> DataFrame:
    """One row a leaf: tree, id, leaf, other, subroot, root, path.

    ``path`` has an entry for each level from the leaf to the root: ``L`` or ``R`` and the sibling on that
    side, or ``-`` where a node stands alone.
    """
    start = made.trees.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    found = _descend(made.rounds, start).withColumnRenamed("node", "leaf")
    return found.join(made.trees.select("tree", "subroot", "root"), "tree")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    sibling = lambda s: F.substring(s, 2, 64)

    def step(node, s):
        side = F.substring(s, 1, 1)
        return F.sha2(F.when(side == "L", F.concat(sibling(s), node)).when(side == "R", F.concat(node, sibling(s))).otherwise(node), 256)

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The siblings on a path, joined."""
    return F.concat_ws("", F.transform(F.filter(path, lambda s: s != "-"), lambda s: F.substring(s, 2, 64)))


def verified(docs: DataFrame, tampered: Column, tampering: dict[str, Column]) -> DataFrame:
    """Build the manifest of ``docs`` and check each row against it, where ``tampered`` with other values.

    ``docs`` has the columns of ``FIELDS``; ids are whole numbers. Returns doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified, one row for each input row. A null field is ``-``, so null and empty text
    differ; null ids come first in their tree, a null ``lang`` is the first tree; repeated ids ascend by
    leaf; an empty table gives no rows. Very long texts are hashed where they lie; other columns are not read.
    """
    columns = {c: docs[c] for c in FIELDS}
    changed = columns | tampering
    other = F.when(tampered, leaf([changed[c] for c in FIELDS]))
    tree = F.coalesce(F.concat(F.lit("="), columns["lang"].cast("string")), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"), columns["doc_id"].cast("long").alias("id"), leaf([columns[c] for c in FIELDS]).alias("leaf"), other.alias("other")
    )
    found = proofs(manifest(leaves))
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    found = found.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": folded})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = docs["doc_id"].isNotNull() & (train_part(docs["doc_id"], 7) == 0)
    more = docs["n_chars"].cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    return verified(docs, tampered, {"n_chars": more})
