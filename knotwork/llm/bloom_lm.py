"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c is held as the levels 1 to 1 + floor(log2 c): one membership for each. A reader probes level
after level until one is missing, so a count is never read too low, and rarely too high. The filter is
dealt to groups by key; a group's block grows with the n-grams of the group, and what it reads for them is
answered to the chunks that hold them. The counts of words, which the plain base score needs exactly, are
answered beside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.arrays import LOWER, find_words, mix, span_hashes
from knotwork.llm.chunks import answers_of, ask, by_group, groups_for, pack, unpack, with_answers
from knotwork.llm.common import table, train_part

#: Bits of a block for each level that it stores, and probes for a level. In a block of a given size the
#: least level stored rises until a stored level has ``BITS`` bits, and lower counts back off.
ROOM, BITS, PROBES = 12, 4, 3
FOLDS = 10
#: Words count as ADD more than they are, and pairs are mixed with PRIOR counts of the words' shares.
ADD, PRIOR = 0.1, 5.0

_END = np.uint64(0x2545F4914F6CDD1D)


def tokens(batch, row):
    """Token hashes of a chunk in order (words, then the end, for every text), and each one's text."""
    data, offsets, columns = unpack(batch, row)
    data = LOWER[data]
    starts, ends, doc = find_words(data, offsets)
    count = len(offsets) - 1
    total = np.bincount(doc, minlength=count)
    at = np.arange(len(doc)) + doc
    out = np.full(len(doc) + count, _END, dtype=np.uint64)
    out[at] = span_hashes(data, starts, ends)
    return out, np.repeat(np.arange(count), total + 1), columns


def pairs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; before the first word stands the end."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[:1] = _END
    return mix(before * np.uint64(0x9FB21C651E98DF25) + words)


def _counted(keys: np.ndarray, train: np.ndarray):
    """Distinct keys, each one's count in training texts, and where every key is among them."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where[train], minlength=len(distinct)), where


def _send(kind: int, keys, counts, groups, width):
    order, cuts = by_group(keys, groups)
    keys, counts = keys[order], counts[order]
    packer = zstandard.ZstdCompressor(level=1)
    for g in range(groups):
        part = slice(cuts[g], cuts[g + 1])
        if cuts[g + 1] > cuts[g]:
            narrow = keys[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
            small = np.minimum(counts[part], 255).astype(np.uint8)
            rest = counts[part][small == 255].astype("<u4")
            packed = packer.compress(small.tobytes() + rest.tobytes())
            head = np.array([len(small), len(packed)], dtype="<u4").tobytes()
            yield kind * groups + g, bytes([width]) + head + packed + narrow


def _read(payload: bytes):
    width = payload[0]
    n, size = np.frombuffer(payload[1:9], "<u4").tolist()
    raw = zstandard.ZstdDecompressor().decompress(payload[9 : 9 + size])
    counts = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], "<u4")
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(payload[9 + size :], np.uint8).reshape(n, width)
    return wide.view("<u8").ravel(), counts


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for no count."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def value(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(levels > 0, (1.5 * np.exp2(levels) - 1) / 2, 0.0)


def _places(keys: np.ndarray, at: int, bits: int):
    for i in range(PROBES):
        yield mix(keys + np.uint64((at * PROBES + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)


def room(counts: np.ndarray) -> int:
    """Bytes of a block that stores every level of some counts."""
    return max(64, -(-int(level(counts).sum()) * ROOM // 64) * 8)


def build(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """Least level stored and the block of ``size`` bytes for some keys."""
    levels = level(counts)
    held = np.bincount(levels, minlength=1)
    above = np.cumsum(held[::-1])[::-1]  # keys of at least a level
    least = 1
    while least < len(above) and above[least:].sum() * BITS > size * 8:
        least += 1
    bits = np.zeros(size * 8, dtype=bool)
    for at in range(least, len(above)):
        own = keys[levels >= at]
        for place in _places(own, at, size * 8):
            bits[place.astype(np.int64)] = True
    return least, np.packbits(bits, bitorder="little")


class Filter:
    """All blocks of a filter; a key's block is its group."""

    def __init__(self, blocks: np.ndarray, least: np.ndarray):
        self.size = blocks.shape[1]
        self.bits = blocks.ravel()
        self.least = least

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, 0 where the least level is missing."""
        return value(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated probes, 0 where the least one is missing."""
        out = np.zeros(len(keys), dtype=np.int64)
        group = (keys % np.uint64(len(self.least))).astype(np.int64)
        base = group * (self.size * 8)
        alive = np.arange(len(keys))
        at = int(self.least.min())
        while len(alive):
            waiting = self.least[group[alive]] > at
            own = alive[~waiting]
            hit = np.ones(len(own), dtype=bool)
            for place in _places(keys[own], at, self.size * 8):
                spot = base[own] + place.astype(np.int64)
                hit &= (self.bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
            out[own[hit]] = at
            alive = np.concatenate([alive[waiting], own[hit]])
            at += 1
            if at > 64:
                break
        return out


def _question(groups):
    def question(batch, row):
        words, doc, columns = tokens(batch, row)
        train = np.asarray(columns[1])[doc]
        for kind, keys, width in ((0, words, 8), (1, pairs(words, doc) >> np.uint64(16), 6)):
            distinct, counts, _ = _counted(keys, train)
            yield from _send(kind, distinct, counts, groups, width)

    return question


def _decide(payloads):
    """For every chunk the levels that the group's block reads for its keys, and the counts of words.

    The note has the numbers of distinct and of all training tokens.
    """
    read = [_read(p) for p in payloads]
    sizes = np.cumsum([len(k) for k, _ in read])[:-1]
    keys, counts = np.concatenate([k for k, _ in read]), np.concatenate([c for _, c in read])
    distinct, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, counts).astype(np.int64)
    seen = total > 0
    least, block = build(distinct[seen], total[seen], room(total[seen]))
    levels = Filter(block[None], np.array([least])).levels(distinct).astype(np.uint8)
    packer = zstandard.ZstdCompressor(level=1)
    told = np.split(levels[where], sizes)
    if payloads[0][0] != 8:
        return [packer.compress(part.tobytes()) for part in told], None
    exact = np.split(total[where].astype("<u8"), sizes)
    note = np.array([seen.sum(), total.sum()], dtype="<i8").tobytes()
    return [packer.compress(a.tobytes() + b.tobytes()) for a, b in zip(told, exact, strict=True)], note


def _answers(batch, row, kind, keys, groups):
    """The levels read for the distinct keys of a chunk and, for words, the exact counts."""
    order, cuts = by_group(keys, groups)
    levels, exact = (np.zeros(len(keys), dtype=np.int64) for _ in range(2))
    for group, packed in answers_of(batch, row, "counts").items():
        if group // groups == kind:
            part = order[cuts[group % groups] : cuts[group % groups + 1]]
            raw = zstandard.ZstdDecompressor().decompress(packed)
            levels[part] = np.frombuffer(raw, np.uint8, len(part))
            if kind == 0:
                exact[part] = np.frombuffer(raw, "<u8", offset=len(part))
    return value(levels), exact


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a boolean column of ``docs``: the rows to learn from; a null is held out. Every text has
    an end token, so null and empty texts have one token. Repeated rows count as often as they stand;
    null ids are kept; further columns are dropped; an empty table gives no rows. Without training tokens
    all words have the same chance.
    """
    chunks = pack(docs.withColumn("_train", F.coalesce(train, F.lit(False))), id_col, text_col, ("_train",))
    groups = groups_for(chunks)
    replies = ask(chunks, _question(groups), _decide, 2 * groups)

    def add(batches):
        found = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for note in batch.column(0).to_pylist():
                found += np.frombuffer(note, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(found[:1]), pa.array(found[1:])], names=["words", "tokens"])

    sums = replies.filter("chunk is null").select("answer").mapInArrow(add, "words long, tokens long").agg(F.sum("words"), F.sum("tokens")).first()
    distinct, total = (n or 0 for n in sums)
    kind = docs.schema[id_col].dataType.simpleString()
    floor = total + ADD * (distinct + 1)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words, doc, columns = tokens(batch, row)
                count = len(columns[0])
                keys, where = np.unique(words, return_inverse=True)
                read, exact = _answers(batch, row, 0, keys, groups)
                base = np.log10((exact + ADD) / floor)
                share = ((read + ADD) / floor)[where]
                seen = read[where]
                context = np.empty(len(words))
                context[1:] = seen[:-1]
                end = np.searchsorted(keys, _END)
                context[:1] = read[end] if len(keys) else 0
                both, spot = np.unique(pairs(words, doc) >> np.uint64(16), return_inverse=True)
                met = _answers(batch, row, 1, both, groups)[0][spot]
                model = np.log10((met + PRIOR * share) / (np.maximum(context, met) + PRIOR))
                yield pa.RecordBatch.from_arrays(
                    [
                        columns[0],
                        pa.array(~np.asarray(columns[1]).astype(bool)),
                        pa.array(np.bincount(doc, minlength=count)),
                        pa.array(np.bincount(doc, exact[where] > 0, minlength=count).astype(np.int64)),
                        pa.array(np.full(count, total)),
                        pa.array(np.bincount(doc, base[where], minlength=count)),
                        pa.array(np.bincount(doc, model, minlength=count)),
                    ],
                    names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    told = with_answers(chunks, replies, "counts")
    schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train_part(docs["doc_id"], FOLDS) != 0)
