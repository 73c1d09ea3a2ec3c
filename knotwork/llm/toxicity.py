"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.arrays import LOWER, MARKS, blocks, find_words, mix, span_hashes
from knotwork.llm.common import keep, table, train_part

#: Hashed features; the bias has a place of its own behind them.
DIMENSIONS = 1 << 20
#: Labelled rows to learn from at most, taken by the hash of their id; passes over them; texts of the
#: sample that must share a feature.
SAMPLE_ROWS, EPOCHS, MIN_TEXTS = 24_000, 8, 2
#: FTRL: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
FOLDS = 5


def features(data: np.ndarray, offsets: np.ndarray):
    """Feature and text number of every word, pair of neighbours and pair around one word."""
    data = LOWER[data]
    starts, ends, doc = find_words(data, offsets, MARKS)
    words = span_hashes(data, starts, ends)
    found, owner = [words], [doc]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        pairs = mix(words[:-gap] * np.uint64(salt) + words[gap:]) if len(words) > gap else words[:0]
        one = doc[:-gap] == doc[gap:] if len(words) > gap else np.zeros(0, bool)
        found.append(pairs[one])
        owner.append(doc[: len(pairs)][one])
    return np.concatenate(found) % np.uint64(DIMENSIONS), np.concatenate(owner)


def _row_features(docs: DataFrame) -> DataFrame:
    """Columns part, label, features: the distinct features of each text as packed 32-bit numbers."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                found, owner = features(data, offsets)
                keys = np.unique(owner.astype(np.uint64) * np.uint64(DIMENSIONS) + found)
                cuts = np.searchsorted(keys, np.arange(hi - lo + 1, dtype=np.uint64) * np.uint64(DIMENSIONS))
                each = [(keys[a:b] % np.uint64(DIMENSIONS)).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(each, pa.binary())],
                    names=["part", "label", "features"],
                )

    return docs.mapInArrow(run, "part int, label int, features binary")


def learn(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows in a fixed random order: positions and values of the weights that are not 0.

    Every coordinate has its own rate, from the sum of its squared gradients; L1 keeps most weights at 0.
    """
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at):
        slope = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / slope)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at = rows[i]
            w = weights(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum())))))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(DIMENSIONS + 1))
    at = np.flatnonzero(every)
    return at, every[at]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from the labelled rows outside the held-out fold.

    At most about ``SAMPLE_ROWS`` rows are used, chosen by id, so one task learns from them in order.
    What reaches the driver is at most one weight for each feature (16 MB), whatever the input.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (train_part(F.col(id_col), FOLDS) != 0))
    known = keep(known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")), "toxic-labels")
    total = known.count()
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 20))
    if total > SAMPLE_ROWS:
        known = known.filter(order < int((1 << 20) * SAMPLE_ROWS / total))
    part = F.lit(0)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(known, id_col)
    rows = _row_features(rows.select(part.alias("part"), "_label", "_text"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["features", "label"])  # the same order whatever the shuffle
        texts = np.zeros(DIMENSIONS + 1, dtype=np.int32)
        for f in frame["features"]:
            texts[np.frombuffer(f, "<u4")] += 1
        own = []
        for label, packed in zip(frame["label"], frame["features"], strict=True):
            found = np.frombuffer(packed, "<u4")
            found = found[texts[found] >= MIN_TEXTS]
            own.append((label, np.append(found, np.uint32(DIMENSIONS))))
        at, value = learn(own)
        return pd.DataFrame({"at": at, "value": value})

    learnt = rows.groupBy("part").applyInPandas(fit, "at long, value double")
    found = learnt.toPandas().sort_values("at")
    return found["at"].to_numpy(dtype=np.int64), found["value"].to_numpy(dtype=np.float64)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, n_hits (features with a weight in the text).

    A feature counts once in a text. Null and empty texts score by the bias alone; equal texts score
    alike; null ids are kept; further columns are dropped; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        at, value = shared.value
        dense = np.zeros(DIMENSIONS + 1, dtype=np.float32)
        dense[at] = value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                found, owner = features(data, offsets)
                hit = dense[found] != 0
                keys = np.unique(owner[hit].astype(np.uint64) * np.uint64(DIMENSIONS) + found[hit])
                owner = (keys // np.uint64(DIMENSIONS)).astype(np.int64)
                total = np.bincount(owner, dense[keys % np.uint64(DIMENSIONS)].astype(np.float64), minlength=hi - lo)
                p = 1 / (1 + np.exp(-np.clip(total + float(dense[DIMENSIONS]), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.bincount(owner, minlength=hi - lo))],
                    names=["_id", "held_out", "score", "predicted", "n_hits"],
                )

    rows = docs.select(docs[id_col].alias("_id"), (train_part(docs[id_col], FOLDS) == 0).alias("held_out"), docs[text_col].cast("string").alias("_text"))
    out = rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int, n_hits long")
    return out.withColumnRenamed("_id", id_col)


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
