"""Tables of packed chunks of texts, and questions that chunks ask one another.

A chunk is one row: some whole texts of a task's input, compressed. To learn what other chunks hold, each
chunk sends its distinct keys, packed, to groups by key; a group decides and answers every chunk in the
order in which it asked. Because a chunk sends a key once however often it holds it, a key that is in a
third of all rows costs a group one entry for each chunk, and nothing needs the rows of a key together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.arrays import blocks
from knotwork.llm.common import keep
from knotwork.llm.graphs import sorted_groups
from knotwork.session import shuffle_partitions

#: Bytes of text in a chunk (one longer text is a chunk), and bytes of input whose keys meet in a group.
CHUNK, GROUP = 2 << 20, 4 << 20


def pack(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Write the chunks: chunk, size, ends, texts, ids and one array for each carried column.

    Chunks are named at random, once: the table is written, and only the files of tasks that ended count.
    """
    columns = [docs[id_col].alias("_c0"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry, 1)]]
    rows = docs.select(docs[text_col].cast("string").alias("_text"), *columns)
    kinds = [rows.schema[f"_c{i}"].dataType.simpleString() for i in range(len(columns))]
    names = [f"_c{i}" for i in range(len(columns))]

    def run(batches):
        held, size, packer = [], 0, zstandard.ZstdCompressor(level=3)

        def finish():
            data = np.concatenate([h[0] for h in held])
            ends = np.cumsum(np.concatenate([h[1] for h in held]))
            arrays = [pa.array([uuid.uuid4().hex]), pa.array([len(data)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))]
            arrays.append(pa.array([packer.compress(data.tobytes())], pa.binary()))
            for i in range(len(names)):
                values = pa.concat_arrays([h[2][i] for h in held])
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "size", "ends", "texts", *names])

        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                held.append((data, np.diff(offsets), [batch.column(i + 1).slice(lo, hi - lo) for i in range(len(names))]))
                size += len(data)
                if size >= CHUNK:
                    yield finish()
                    held, size = [], 0
        if held:
            yield finish()

    schema = "chunk string, size long, ends array<long>, texts binary, " + ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True))
    return keep(rows.mapInArrow(run, schema), "chunks", "uncompressed")


def unpack(batch: pa.RecordBatch, row: int):
    """Data, offsets and the arrays of ids and carried columns of one chunk."""
    size = batch.column("size")[row].as_py()
    raw = zstandard.ZstdDecompressor().decompress(batch.column("texts")[row].as_py(), max_output_size=max(size, 1))
    ends = batch.column("ends")[row].values.to_numpy(zero_copy_only=False)
    columns = [batch.column(n)[row].values for n in batch.schema.names if n.startswith("_c")]
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], ends]).astype(np.int64), columns


def groups_for(chunks: DataFrame) -> int:
    """How many groups keys are dealt to, from the bytes of all chunks."""
    total = chunks.agg(F.sum("size")).first()[0] or 0
    return max(shuffle_partitions(chunks.sparkSession), -(-total // GROUP))


def ask(chunks: DataFrame, question: Callable, decide: Callable, groups: int) -> DataFrame:
    """Columns chunk, group, answer; a row without a chunk is a group's note about all its keys.

    ``question(batch, row)`` yields ``(group, payload)`` for a chunk; ``decide(payloads)`` gives the answers
    (or None for none) and the note (or None).
    """

    def send(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sent = list(question(batch, row))
                if sent:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g for g, _ in sent], pa.int32()), pa.array([batch.column("chunk")[row].as_py()] * len(sent)), pa.array([p for _, p in sent], pa.binary())],
                        names=["group", "chunk", "payload"],
                    )

    def answer(batches):
        for key, found in sorted_groups(batches, 1):
            names = found.column("chunk").to_pylist()
            replies, note = decide([p.as_py() for chunk in found.column("payload").chunks for p in chunk])
            if replies is None:
                names, replies = [], []
            if note is not None:
                names, replies = [*names, None], [*replies, note]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([key[0]] * len(names), pa.int32()), pa.array(replies, pa.binary())], names=["chunk", "group", "answer"])

    sent = chunks.mapInArrow(send, "group int, chunk string, payload binary")
    met = sent.repartition(groups, "group").sortWithinPartitions("group")
    return keep(met.mapInArrow(answer, "chunk string, group int, answer binary"), "answers", "uncompressed")


def with_answers(chunks: DataFrame, replies: DataFrame, column: str) -> DataFrame:
    """Add to each chunk the answers to it, an array of group and answer."""
    own = replies.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("group", "answer")).alias(column))
    return chunks.join(own, "chunk", "left")


def answers_of(batch: pa.RecordBatch, row: int, column: str) -> dict[int, bytes]:
    return {a["group"]: a["answer"] for a in batch.column(column)[row].as_py() or ()}


def by_group(keys: np.ndarray, groups: int):
    """Order of keys by group and value, and the bounds of the groups in it."""
    group = (keys % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((keys, group))
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    return order, cuts
