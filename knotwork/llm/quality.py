"""Quality rules: how much of a text lies inside repeated word windows and repeated lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm.arrays import SPACE, blocks, find_words, mix, per_text, repeated, runs, span_hashes
from knotwork.llm.common import table

#: Word windows, and the largest share of word characters that may lie inside windows found twice or more.
WINDOW_SHARES = {5: 0.35, 7: 0.30, 10: 0.25}
#: Largest share of the bytes of all lines that may lie in lines equal to an earlier one. The share of
#: lines is measured too, but says little of texts with few lines and decides nothing.
LINE_BYTES_SHARE = 0.20
MIN_WORDS = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "line_share": "double",
    "line_bytes_share": "double",
    **{f"share_{n}": "double" for n in WINDOW_SHARES},
    "base_failed": "boolean",
    "kept": "boolean",
}


def _covered(keys, valid, n, total):
    """Words inside windows that are found twice or more."""
    at = np.flatnonzero(valid)
    at = at[repeated(keys[at])]
    steps = np.zeros(total + 1, dtype=np.int64)
    steps[at] += 1
    steps[at + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of a block of texts."""
    count = len(offsets) - 1
    starts, ends, doc = find_words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    solid = ~SPACE[data]
    total = np.bincount(doc, minlength=count)
    out = {
        "n_words": total,
        "word_chars": per_text(lead & solid, offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
    }
    salt = mix(doc.astype(np.uint64) + np.uint64(7))
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=chars[1:])
    lengths = chars[ends] - chars[starts]
    for n in (3, *WINDOW_SHARES):
        keys, valid = runs(hashes, doc, n)
        inside = _covered(keys ^ salt[: len(keys)], valid, n, len(hashes))
        if n == 3:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=count)
        else:
            covered = np.bincount(doc[inside], lengths[inside], minlength=count)
            out[f"share_{n}"] = covered / np.maximum(out["word_chars"], 1)

    cuts = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start, len(data))[1:]
    line_end = line_end - (data[line_end - 1] == 10)
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    words = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(solid, out=words[1:])
    full = words[line_end] > words[line_start]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    keys = span_hashes(data, line_start, line_end) ^ mix(line_doc.astype(np.uint64) + np.uint64(11))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    size = (line_end - line_start).astype(np.float64)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=count)
    lines = np.bincount(line_doc, minlength=count)
    out["line_share"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["line_bytes_share"] = np.bincount(line_doc[later], size[later], minlength=count) / np.maximum(
        np.bincount(line_doc, size, minlength=count), 1
    )
    out["base_failed"] = (total < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * total)
    kept = ~out["base_failed"] & (out["line_bytes_share"] <= LINE_BYTES_SHARE)
    for n, most in WINDOW_SHARES.items():
        kept &= out[f"share_{n}"] <= most
    out["kept"] = kept
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the measures in ``COLUMNS``.

    Words are runs without white space; windows and lines are compared within one text, by 64-bit
    hashes. Null and empty texts count as no words and fail. Equal rows give equal rows; an empty table
    gives none; null ids and any further columns are allowed, and further columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                found = measure(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo)]
                    + [pa.array(found[c], pa.bool_() if t == "boolean" else pa.int64() if t == "long" else pa.float64()) for c, t in COLUMNS.items()],
                    names=["_id", *COLUMNS],
                )

    schema = f"_id {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    pairs = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    return pairs.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns; edge cases as in ``repetition``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(measure(data, offsets)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir):
    return repetition(table(spark, sf_dir, "documents"))
