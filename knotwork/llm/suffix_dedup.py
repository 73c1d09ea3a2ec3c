"""Repeated passages by a depth-limited radix sort of suffixes, from the most significant digits.

Suffixes are ordered only through the first ``LENGTH`` bytes. The first pass takes as digit the 16 bytes at
the place of a window that has the least hash (equal windows have it at the same place), so one digit
stands for all windows around it; groups of one text are finished there. The second pass takes all bytes:
equal groups are exactly the repeated windows, and the smallest id of a group keeps its window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from knotwork.llm.arrays import mix, span_hashes
from knotwork.llm.chunks import answers_of, ask, by_group, groups_for, pack, unpack, with_answers
from knotwork.llm.common import table, untaken

#: Bytes of a repeated window, and bytes of the first digit.
LENGTH, DIGIT = 50, 16
#: Window starts, and regions, handled at once.
SLICE, REGIONS = 1 << 18, 1 << 14

_BASE = np.uint32(0x9E3779B1)
_LETTER = np.random.default_rng(20240602).integers(1, 1 << 32, 256).astype(np.uint32)


def _order(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``DIGIT`` bytes at every place (DIGIT is a power of two)."""
    out, factor, width = _LETTER[data], _BASE, 1
    while width < DIGIT:
        out = out[:-width] * factor + out[width:]
        factor, width = factor * factor, width * 2
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def regions(data: np.ndarray, offsets: np.ndarray):
    """Runs of window starts whose windows share the place of their digit: first, last, place."""
    firsts, lasts, places = [], [], []
    reach = LENGTH - DIGIT + 1
    ends = offsets[1:]
    tails = np.maximum(offsets[:-1], ends - LENGTH + 1)
    old = np.seterr(over="ignore")
    for lo in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[lo : lo + SLICE + LENGTH - 1]
        count = len(part) - LENGTH + 1
        keys = _order(part).astype(np.uint64)
        keys = (keys << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
        width = 1
        while width * 2 <= reach:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < reach:
            keys = np.minimum(keys[: len(keys) - (reach - width)], keys[reach - width :])
        place = (keys[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
        near = (ends > lo) & (tails < lo + count)
        outside = np.zeros(count + 1, dtype=np.int32)
        np.add.at(outside, np.clip(tails[near] - lo, 0, count), 1)
        np.add.at(outside, np.clip(ends[near] - lo, 0, count), -1)
        valid = np.cumsum(outside[:-1]) == 0
        start, stop = valid.copy(), valid.copy()
        same = (place[1:] == place[:-1]) & valid[1:] & valid[:-1]
        start[1:] &= ~same
        stop[:-1] &= ~same
        at = np.flatnonzero(start)
        firsts.append(at + lo)
        lasts.append(np.flatnonzero(stop) + lo)
        places.append(place[at])
    np.seterr(**old)
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (firsts, lasts, places))


def _digits(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``DIGIT`` bytes at some places."""
    out = np.zeros(len(places), dtype=np.uint64)
    for lo in range(0, DIGIT, 8):
        word = np.zeros(len(places), dtype=np.uint64)
        for i in range(lo, min(lo + 8, DIGIT)):
            word = (word << np.uint64(8)) | data[places + i].astype(np.uint64)
        out = mix(out * np.uint64(0x94D049BB133111EB) + word + np.uint64(1))
    return out


class Chunk:
    """The regions of a chunk in a fixed order, as first and later passes find them again."""

    def __init__(self, batch, row, groups):
        self.data, self.offsets, self.columns = unpack(batch, row)
        ids = self.columns[0]
        known = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, last, place = regions(self.data, self.offsets)
        doc = np.searchsorted(self.offsets, first, side="right") - 1
        ok = known[doc] if len(doc) else np.zeros(0, bool)
        self.first, self.last, self.doc = first[ok], last[ok], doc[ok]
        self.keys = _digits(self.data, place[ok]) >> np.uint64(12)
        self.groups = groups

    def distinct(self):
        """Distinct digits by group, the bounds of groups, whether several texts have the digit, and the
        place of every region in that order."""
        keys, where = np.unique(self.keys, return_inverse=True)
        low, high = np.full(len(keys), len(self.ids)), np.full(len(keys), -1)
        np.minimum.at(low, where, self.doc)
        np.maximum.at(high, where, self.doc)
        order, cuts = by_group(keys, self.groups)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return keys[order], cuts, (low < high)[order], back[where]

    def live(self, answers) -> np.ndarray:
        """Regions whose digit is in several texts."""
        keys, cuts, _, where = self.distinct()
        flags = np.zeros(len(keys), dtype=bool)
        for g, bits in answers.items():
            n = cuts[g + 1] - cuts[g]
            flags[cuts[g] : cuts[g + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        return np.flatnonzero(flags[where])

    def leaders(self, live):
        """Of equal regions in the chunk that with the smallest id leads: the leaders by group, the bounds
        of groups, each region's leader."""
        starts, ends = self.first[live], self.last[live] + LENGTH
        content = span_hashes(self.data, starts, ends)
        ids = self.ids[self.doc[live]]
        order = np.lexsort((ids, content))
        new = np.ones(len(order), dtype=bool)
        new[1:] = content[order][1:] != content[order][:-1]
        leader = np.empty(len(order), dtype=np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        heads = order[new]
        group = (self.keys[live][heads] % np.uint64(self.groups)).astype(np.int64)
        heads = heads[np.lexsort((content[heads], group))]
        cuts = np.searchsorted((self.keys[live][heads] % np.uint64(self.groups)).astype(np.int64), np.arange(self.groups + 1))
        return heads, cuts, leader, ids


def _ask_digits(groups):
    def question(batch, row):
        keys, cuts, several, _ = Chunk(batch, row, groups).distinct()
        for g in range(groups):
            part = keys[cuts[g] : cuts[g + 1]]
            if len(part):
                narrow = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                yield g, np.packbits(several[cuts[g] : cuts[g + 1]]).tobytes() + narrow.tobytes()

    return question


def _decide_digits(payloads):
    keys, several = [], []
    for p in payloads:
        n = len(p) * 8 // 57
        while (n + 7) // 8 + 7 * n < len(p):
            n += 1
        head = (n + 7) // 8
        several.append(np.unpackbits(np.frombuffer(p[:head], np.uint8), count=n).astype(bool))
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :7] = np.frombuffer(p[head:], np.uint8).reshape(n, 7)
        keys.append(wide.view("<u8").ravel())
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    every, flags = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(every)
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return [np.packbits(part).tobytes() for part in np.split(flags, sizes)], None


def _ask_windows(groups):
    def question(batch, row):
        chunk = Chunk(batch, row, groups)
        live = chunk.live(answers_of(batch, row, "digits"))
        if not len(live):
            return
        heads, cuts, _, ids = chunk.leaders(live)
        packer = zstandard.ZstdCompressor(level=3)
        for g in range(groups):
            own = heads[cuts[g] : cuts[g + 1]]
            if len(own):
                starts, ends = chunk.first[live[own]], chunk.last[live[own]] + LENGTH
                body = b"".join([chunk.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
                head = np.uint32(len(own)).tobytes() + ids[own].astype("<i8").tobytes() + (ends - starts).astype("<u2").tobytes()
                yield g, packer.compress(head + body)

    return question


def _decide_windows(payloads):
    ids, sizes, bodies, counts = [], [], [], []
    for p in payloads:
        raw = zstandard.ZstdDecompressor().decompress(p)
        n = int(np.frombuffer(raw[:4], np.uint32)[0])
        ids.append(np.frombuffer(raw[4 : 4 + 8 * n], "<i8"))
        sizes.append(np.frombuffer(raw[4 + 8 * n : 4 + 10 * n], "<u2").astype(np.int64))
        bodies.append(np.frombuffer(raw[4 + 10 * n :], np.uint8))
        counts.append(int(sizes[-1].sum() - n * (LENGTH - 1)))
    del raw, payloads
    size, data = np.concatenate(sizes), np.concatenate(bodies)
    del bodies
    owners, upto = np.concatenate(ids), np.cumsum(size - (LENGTH - 1))
    first = np.cumsum(size) - size - np.append(0, upto[:-1])
    count = int(upto[-1])

    def places(windows):
        """Region and start of some windows."""
        region = np.searchsorted(upto, windows, side="right")
        return region, first[region] + windows

    one = np.empty(count, dtype=np.uint64)
    for lo in range(0, count, SLICE):
        starts = places(np.arange(lo, min(lo + SLICE, count)))[1]
        one[lo : lo + len(starts)] = span_hashes(data, starts, starts + LENGTH)
    # Equal windows have one hash, so windows are compared a share of the hashes at a time.
    flags, shares = np.zeros(count, dtype=bool), -(-count // SLICE)
    share = (one % np.uint64(shares)).astype(np.uint32)
    for part in range(shares):
        windows = np.flatnonzero(share == part)
        region, starts = places(windows)
        own, key, two = owners[region], one[windows], _second(data, starts)
        order = np.lexsort((own, two, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = own[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        flags[windows[order]] = own[order] > least
    return [np.packbits(part).tobytes() for part in np.split(flags, np.cumsum(counts)[:-1])], None


def _second(data, starts):
    """Another 64-bit hash of the windows, from their bytes taken eight at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        word = np.zeros(len(starts), dtype=np.uint64)
        for i in range(8):
            word |= data[starts + (at + i)].astype(np.uint64) << np.uint64(8 * i)
        out = (out ^ word) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(31)
    return out


def _removed(chunk: Chunk, digits, windows) -> np.ndarray:
    """Which bytes of the chunk are covered by a window of a smaller id."""
    steps = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    live = chunk.live(digits)
    if len(live):
        heads, cuts, leader, ids = chunk.leaders(live)
        span = chunk.last[live] - chunk.first[live] + 1
        size = span[heads]
        flags = np.zeros(int(size.sum()), dtype=bool)
        bounds = np.append(0, np.cumsum(size))
        for g, bits in windows.items():
            a, b = bounds[cuts[g]], bounds[cuts[g + 1]]
            flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        rank = np.empty(len(live), dtype=np.int64)
        rank[heads] = np.arange(len(heads))
        for lo in range(0, len(live), REGIONS):
            part = slice(lo, lo + REGIONS)
            size, lead = span[part], leader[part]
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            bad = flags[np.repeat(bounds[rank[lead]], size) + inside] | np.repeat(ids[part] > ids[lead], size)
            at = (np.repeat(chunk.first[live[part]], size) + inside)[bad]
            steps[at] += 1
            steps[at + LENGTH] -= 1
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """One row per input row: id, carried columns, n_bytes, n_removed, n_spans, kept_sha256, and the
    remaining text with ``texts`` (a character cut in two goes whole).

    A byte is removed if a window of ``LENGTH`` bytes around it also starts in a text with a smaller id.
    Null and short texts lose nothing; a null id neither removes nor loses; rows that share an id do not
    count as repeats of one another; other columns are dropped; an empty table gives no rows. Where the id or a
    carried column has the name of a result column, the result column gets an underscore at its end. Ids must be
    whole numbers of at most 64 bits, others raise ``TypeError``: the smaller id keeps a repeated passage.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    chunks = pack(docs, id_col, text_col, carry)
    groups = groups_for(chunks)
    told = with_answers(chunks, ask(chunks, _ask_digits(groups), _decide_digits, groups), "digits")
    told = with_answers(told, ask(told, _ask_windows(groups), _decide_windows, groups), "windows")
    names = [id_col, *carry]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch, row, groups)
                gone = _removed(chunk, answers_of(batch, row, "digits"), answers_of(batch, row, "windows"))
                data, offsets = chunk.data, chunk.offsets
                sums = np.append(0, np.cumsum(gone))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                begins[edges] = gone[edges]
                spans = np.append(0, np.cumsum(begins))
                removed = sums[offsets[1:]] - sums[offsets[:-1]]
                kept = []
                for i in range(len(offsets) - 1):
                    part = data[offsets[i] : offsets[i + 1]]
                    kept.append((part[~gone[offsets[i] : offsets[i + 1]]] if removed[i] else part).tobytes())
                arrays = [
                    *chunk.columns,
                    pa.array(np.diff(offsets)),
                    pa.array(removed.astype(np.int64)),
                    pa.array((spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                if texts:
                    arrays.append(pa.array([k.decode(errors="ignore") for k in kept]))
                yield pa.RecordBatch.from_arrays(arrays, names=[f"_o{i}" for i in range(len(arrays))])

    kinds = [docs.schema[c].dataType.simpleString() for c in names] + ["long", "long", "long", "string"] + ["string"] * texts
    out = told.mapInArrow(run, ", ".join(f"_o{i} {k}" for i, k in enumerate(kinds)))
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * texts
    return out.toDF(*names, *untaken(results, names))


def op5(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
