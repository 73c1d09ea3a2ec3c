"""Connected components of an edge table, and groups of a sorted stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the neighbours of every node with the smallest of them.

    Large: the neighbours above the node, small: those below it and the node itself.
    """
    if large:
        edges = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # Written, so that the join deals both sides anew and the edges of a hub can be split over tasks.
    least = keep(least.select("u", F.least("u", "m").alias("m")), "least")
    met = edges.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component: the smallest node reachable, for every node that is not the smallest.

    ``edges`` has two columns of one type. Alternates large and small stars until nothing changes, which
    takes a number of rounds that grows with the logarithm of the paths; each round is written, and only
    a count and a sum reach the driver. Edges with nulls and loops are left out.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a) != F.col(b)))
    now, before = keep(now.distinct(), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        now = keep(_star(_star(now, True), False), "edges")


def sorted_groups(batches, keys: int):
    """Yield a table for every run of equal values in the first ``keys`` columns of sorted batches.

    A run may go on over batches. Only the open run is held, so the caller bounds the size of runs.
    """
    held, open_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for c in range(keys):
            col = batch.column(c)
            differs = pa.compute.not_equal(col.slice(1), col.slice(0, len(col) - 1)) if len(col) > 1 else pa.array([], pa.bool_())
            change = differs if change is None else pa.compute.or_(change, differs)
        cuts = [0, *[i + 1 for i, d in enumerate(change.to_pylist()) if d], batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(batch.column(c)[lo].as_py() for c in range(keys))
            if held and key != open_key:
                yield open_key, pa.Table.from_batches(held)
                held = []
            open_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield open_key, pa.Table.from_batches(held)
