"""What the operators of this subpackage share: tables, scratch tables, sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it from there.

    Later plans start from the written files, so a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a Python worker is given at once; texts are long, and Spark's own 10,000 rows of them fill its memory.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers ``BATCH_ROWS`` at a time from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def untaken(names: list[str], taken: list[str]) -> list[str]:
    """Names for result columns; one that ``taken`` has too, in any case of letters, gets underscores at its end."""
    out, used = [], {t.lower() for t in taken}
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def train_part(column, folds: int):
    """crc32 of the decimal id, modulo ``folds``; remainder 0 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: Bits of the set in ``probable``. Where it fills up more rows pass, and the join after it drops them.
BITS = 1 << 23


def probable(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be in the one column of ``ids``, by a bit set of fixed size.

    Spares long rows the way to a join that would drop them. At most the words of the set reach the driver.
    """
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(f"place {i}")), F.lit(BITS)).alias(f"_place{i}") for i in (0, 1)]
    marks = ids.select(F.explode(F.array(*places(ids.columns[0]))).alias("at"))
    words = marks.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    packed = np.zeros(BITS >> 6, dtype=np.int64)
    for r in words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect():
        packed[r["word"]] = r["bits"]
    shared = rows.sparkSession.sparkContext.broadcast(packed.view(np.uint8))

    def run(batches):
        bits = np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                near = bits[part.column(part.num_columns - 2).to_numpy()] & bits[part.column(part.num_columns - 1).to_numpy()]
                yield pa.RecordBatch.from_arrays(part.columns[:-2], names=part.schema.names[:-2]).filter(pa.array(near))

    return rows.select("*", *places(column)).mapInArrow(run, rows.schema)
