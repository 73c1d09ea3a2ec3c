"""Session helpers: cutting lineage in shared storage and checking sizes before a broadcast."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its measured bytes stay below this.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Rows of the input for each shuffle partition.
PARTITION_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which
    every executor reaches too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    else:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that later plans start from it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """Write ``df`` as packed Parquet into the checkpoint folder and read it from there.

    For frames of table size: beside :func:`cut` it takes a small part of the disk, and later plans read the columns
    that they need only.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return cut(df)  # Parquet has no such columns
    path = scratch_path(df.sparkSession, "packed")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` as packed Parquet in buckets by ``keys``, one for each shuffle partition, so that later joins and
    groupings on them find its rows dealt."""
    spark = df.sparkSession
    count, name, path = shuffle_partitions(spark), "cut_" + uuid.uuid4().hex, scratch_path(spark, "cut")
    dealt = df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys).format("parquet")
    dealt.option("path", path).option("compression", "zstd").saveAsTable(name)
    frame = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return frame


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_ended_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of a job when it ends; what a later job needs is in written frames.

    Else they stay until the driver happens to collect its garbage, and the disk holds those of all steps at once.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def partitions_for(spark: SparkSession, rows: int) -> None:
    """Raise the number of shuffle partitions so that tables of so many rows give each ``PARTITION_ROWS`` at most.

    Adaptive execution joins small partitions again, but it cannot divide one that is aggregated or sorted.
    """
    wanted = -(-rows // PARTITION_ROWS)
    if wanted > shuffle_partitions(spark):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)


def _width(field) -> Column:
    """About how many bytes a value takes."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(2 * F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def weighed(df: DataFrame) -> tuple[DataFrame, bool]:
    """Write a request-side frame and tell whether its rows fit the bound of a broadcast."""
    written = packed(df)
    widths = functools.reduce(lambda a, b: a + b, [_width(f) for f in df.schema], F.lit(16))
    weight = written.agg(F.sum(widths.cast("long"))).first()[0] or 0
    return written, weight <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """Write a request-side frame, weigh its rows, and hint a broadcast when they fit the bound.

    A small batch then meets a large table without the table being shuffled; a large batch, by rows or
    by the length of its texts, is left to a shuffled join.
    """
    written, small = weighed(df)
    return F.broadcast(written) if small else written


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast for counted rows of ids and numbers that fit the bound; else leave the join to AQE."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def collapse(queries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """One query for each distinct value of ``columns``, and which query stands for which.

    A batch may ask the same thing very often; it is worked out once. The second frame,
    ``(query_id, answer_id)``, is None when all queries differ.
    """
    key = F.sha2(F.to_json(F.struct(*columns)), 256)
    keyed = queries.select("query_id", *columns, key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("query_id").alias("answer_id"))
    keyed = packed(keyed.join(first, "_key").drop("_key"))
    own = keyed.filter("query_id = answer_id").select("query_id", *columns)
    total, distinct = keyed.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("query_id") == F.col("answer_id"), 1))
    ).first()
    return own, None if total == distinct else keyed.select("query_id", "answer_id")


def expand(answers: DataFrame, standing: DataFrame | None) -> DataFrame:
    """Give every query the answer rows of the one that stands for it."""
    if standing is None:
        return answers
    columns = answers.columns
    named = answers.withColumnRenamed("query_id", "answer_id")
    return standing.join(named, "answer_id").select(*columns)
