"""Sharding by a weighted hash tree: a row descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import keep, table, untaken

#: Rows that number their slots together.
SLOT_ROWS = 10_000


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards; a shard is ``(number, weight)``.

    A node's draws are named by its place, so a tree that keeps a subtree as it is keeps its draws.
    """

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        """Equal weights; shards are numbered through."""
        number = iter(range(regions * racks * shards))
        return Tree(
            tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions))
        )

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: the only weight that changes is the new region's, so
        rows move nowhere but into the new shard."""
        number = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((number, weight),),)))


def _weight(node) -> float:
    return node[1] if isinstance(node[0], int) else sum(map(_weight, node))


def _choose(names: list[str], weights: list[float], key: Column) -> Column:
    """Which child wins: the smallest ``-ln(u) / weight`` falls on each in proportion to its weight."""
    draws = []
    for i, (name, weight) in enumerate(zip(names, weights, strict=True)):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
            draw = -F.ln((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(weight)
            draws.append(F.struct(draw.alias("d"), F.lit(i).alias("i")))
    if len(draws) == 1:
        return F.lit(names.index(next(n for n, w in zip(names, weights, strict=True) if w > 0)))
    return F.array_min(F.array(*draws))["i"]


def with_shard(df: DataFrame, tree: Tree, key: Column, column: str) -> DataFrame:
    """Add the shard of every row: three draws a row, each among the children of the node reached."""

    def cases(at: Column, values: list[Column]) -> Column:
        out = F.when(at == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(at == i, value)
        return out

    region, rack = f"_{column}_region", f"_{column}_rack"
    names = [f"region {i}" for i in range(len(tree.regions))]
    df = df.withColumn(region, _choose(names, [_weight(r) for r in tree.regions], key))
    df = df.withColumn(
        rack,
        cases(
            F.col(region),
            [_choose([f"rack {i}.{j}" for j in range(len(r))], [_weight(k) for k in r], key) for i, r in enumerate(tree.regions)],
        ),
    )
    leaves = []
    for i, r in enumerate(tree.regions):
        racks = []
        for shards in r:
            won = _choose([f"shard {s}" for s, _ in shards], [w for _, w in shards], key)
            racks.append(F.element_at(F.array(*[F.lit(s) for s, _ in shards]), won + 1))
        leaves.append(cases(F.col(rack), racks))
    return df.withColumn(column, cases(F.col(region), leaves)).drop(region, rack)


def with_slots(df: DataFrame, shard: str, order: list[str], shards: int) -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    Rows are dealt into buckets of a shard, buckets are counted, and a row's slot is its place in the
    bucket after all earlier buckets. Copies of one row are dealt apart. The dealt rows are written
    first, so that a repeated task numbers the same rows.
    """
    placed = keep(df.withColumn("_deal", F.monotonically_increasing_id()), "placed")
    buckets = -(-placed.count() // (shards * SLOT_ROWS)) or 1
    deal = F.pmod(F.xxhash64(*order, F.pmod("_deal", F.lit(64))), F.lit(buckets))
    placed = placed.withColumn("_bucket", deal)
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order, "_deal"))
    return (
        placed.withColumn("_place", place)
        .join(offsets, [shard, "_bucket"])
        .withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_bucket", "_deal", "_place", "_before")
    )


def assign_shards(
    docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The shard of every row by the law ``key``, and its shard in the tree with one more shard.

    ``docs`` may hold any columns; the result has id, size, text_crc32, law, shard, slot, grown_shard. A result
    column with the name of the id column gets an underscore at its end.
    A null text counts as no bytes, a null id as the id of an empty string. Rows with equal ids share
    their shard; repeated rows get slots of their own; an empty table gives no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].alias("_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    rows = with_shard(with_shard(rows, tree, key, "shard"), tree.grown(), key, "grown_shard")
    shards = sum(len(rack) for region in tree.regions for rack in region)
    rows = with_slots(rows, "shard", ["_id", "text_crc32", "size"], shards)
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return rows.select("_id", *results).toDF(id_col, *untaken(results, [id_col]))


def op2(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), Tree.even(2, 4, 5))
