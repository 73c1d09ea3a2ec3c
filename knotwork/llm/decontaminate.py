"""Benchmark decontamination by latent semantic retrieval.

Passages are blocks of words under TF-IDF weights. A randomised SVD of the matrix of passages, worked out
where the passages lie, gives the latent space of the benchmark's vocabulary; passages near an item by
cosine are candidates. So are all passages whose words could give the overlap that a leak needs at least,
whatever their cosine. A longest common subsequence with the item, weighted by IDF, decides together with
a check of the item's answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.arrays import MARKS, blocks, find_words, span_hashes
from knotwork.llm.common import keep, probable, table

#: Words in a block; a passage is two neighbouring blocks, and passages overlap by one.
STRIDE = 16
#: Terms in a larger share of blocks carry no weight in the latent space.
COMMON = 0.002
#: Terms by which a window of an item is searched: its rarest ones.
TERMS = 10
#: Item windows searched together, dimensions of their latent space and further random directions.
WINDOWS, RANK, EXTRA = 192, 224, 16
#: Cosine of a candidate; weighted shares of the item found in order, alone or with its answer.
COSINE, LCS, LCS_WITH_ANSWER, ANSWER = 0.25, 0.75, 0.5, 0.5
#: Share of an item's weight, in its most common words, that the first look at overlaps spares, and items
#: looked for together.
SPARED, TOGETHER = 0.25, 512
#: Bytes of items whose vocabulary is broadcast at once; a larger benchmark is worked off in parts.
ITEM_BYTES = 8 << 20


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words of lower-cased texts, and each one's text."""
    starts, ends, doc = find_words(data, offsets, MARKS)
    return span_hashes(data, starts, ends), doc


def lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case, letters with marks and of other scripts too."""
    return pc.utf8_lower(texts.cast(pa.large_string()))


def item_words(text: str | None) -> np.ndarray:
    _, _, data, offsets = next(blocks(lowered(pa.array([text], pa.string()))))
    return words_of(data, offsets)[0]


def answer_of(text: str) -> str:
    """The item's last sentence or line, or the last third of its words where it has but one."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if len(p.split()) > 2]
    if len(parts) > 1:
        return parts[-1]
    words = text.split()
    return " ".join(words[-max(3, len(words) // 3) :])


def _passages(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row for some texts: ids, blocks of each, words of each block outside the vocabulary, and the
    hits: place of the term in the vocabulary and block."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        terms = shared.value
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in small(batches):
            for lo, hi, data, offsets in blocks(lowered(batch.column(1))):
                words, doc = words_of(data, offsets)
                total = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(total) - total
                count = -(-total // STRIDE)
                block = (np.cumsum(count) - count)[doc] + (np.arange(len(doc)) - first[doc]) // STRIDE
                near = np.flatnonzero(maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
                place = np.searchsorted(terms, words[near])
                real = terms[np.minimum(place, len(terms) - 1)] == words[near]
                near, place = near[real], place[real]
                size = int(count.sum())
                outside = np.bincount(block, minlength=size) - np.bincount(block[near], minlength=size)
                yield _row(batch.column(0).slice(lo, hi - lo), count, outside, place, block[near])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"ids array<{kind}>, counts array<int>, packed binary, hits int")


def small(batches, rows: int = 256):
    """The batches in pieces, so that copies of their texts stay small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _row(ids, count, outside, place, block):
    body = outside.astype(np.uint8).tobytes() + place.astype("<u4").tobytes() + block.astype("<u4").tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([count.astype(np.int32).tolist()], pa.list_(pa.int32())),
            pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary()),
            pa.array([len(place)], pa.int32()),
        ],
        names=["ids", "counts", "packed", "hits"],
    )


def _rows(batches):
    """Ids, blocks of each text, words outside, terms and blocks of the hits, row by row."""
    for batch in batches:
        for i in range(batch.num_rows):
            count = batch.column("counts")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            n, size = batch.column("hits")[i].as_py(), int(count.sum())
            raw = zstandard.ZstdDecompressor().decompress(batch.column("packed")[i].as_py(), max_output_size=max(1, size + 8 * n))
            place, block = (np.frombuffer(raw, "<u4", n, size + 4 * n * k).astype(np.int64) for k in (0, 1))
            yield batch.column("ids")[i].values, count, np.frombuffer(raw, np.uint8, size).astype(np.float64), place, block


def _narrowed(passages: DataFrame, terms: np.ndarray, rare: np.ndarray) -> DataFrame:
    """The passages with the hits of some terms only; other rare terms count as words outside.

    Both are masks over the vocabulary.
    """
    shared = passages.sparkSession.sparkContext.broadcast((terms, rare & ~terms))

    def run(batches):
        terms, others = shared.value
        for ids, count, outside, place, block in _rows(batches):
            own = terms[place]
            outside = outside + np.bincount(block[others[place]], minlength=len(outside))
            yield _row(ids, count, outside, place[own], block[own])

    return keep(passages.mapInArrow(run, passages.schema), "searched", "uncompressed")


def _frequencies(passages: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many blocks each term is, and the number of blocks; at most one row per term is collected."""

    def run(batches):
        found, total = np.zeros(terms + 1, dtype=np.int64), 0
        for _, count, _, place, block in _rows(batches):
            keys = np.unique(place * int(count.sum() + 1) + block)
            found[:terms] += np.bincount(keys // int(count.sum() + 1), minlength=terms)
            total += int(count.sum())
        found[terms] = total
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    sums = passages.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(terms + 1)
    for r in sums:
        out[r["term"]] = r["n"]
    return out[:terms], int(out[terms])


def _window_sum(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each block plus the next of the same text; a text's last block stands alone."""
    out = values.copy()
    last = np.zeros(len(values), dtype=bool)
    last[np.cumsum(count)[count > 0] - 1] = True
    inner = np.flatnonzero(~last)
    out[inner] += values[inner + 1]
    return out


def _project(place, block, size, weights, basis):
    """Weighted sums of the basis rows of the hits of every block; hits are in order of blocks."""
    out = np.zeros((size, basis.shape[1]), dtype=np.float32)
    if len(place):
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        rows = weights[place][:, None].astype(np.float32) * basis[place]
        out[block[cuts]] = np.add.reduceat(rows, cuts, axis=0)
    return out


def _active(place, block, count, own):
    """Hits with the terms searched for, and only the texts' blocks in reach of one, renumbered.

    Gives hits' terms and new blocks, the counts of runs of neighbouring blocks and the old block numbers.
    """
    mine = own[place] >= 0
    term, block = own[place[mine]], block[mine]
    size = int(count.sum())
    used = np.zeros(size + 1, dtype=bool)
    used[block] = True
    ends = np.zeros(size + 1, dtype=bool)
    ends[np.cumsum(count)] = True  # a text ends before these blocks
    reach = used.copy()
    reach[:-1] |= used[1:] & ~ends[1:]
    at = np.flatnonzero(reach[:size])
    number = np.cumsum(reach) - 1
    cut = np.append(True, (np.diff(at) > 1) | ends[at[1:]]) if len(at) else np.zeros(0, bool)
    runs = np.diff(np.append(np.flatnonzero(cut), len(at)))
    return term, number[block], runs, at


def _sum_matrices(parts: DataFrame, width: int, height: int) -> np.ndarray:
    """Sum matrices given as rows (row, values); at most ``height`` rows of ``width`` reach the driver."""

    def add(batches):
        total = {}
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(packed.as_py(), "<f4")
                total[row] = total[row] + one if row in total else one.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in total.values()], pa.binary())], names=["row", "values"]
        )

    met = parts.repartition("row").mapInArrow(add, "row int, values binary").collect()
    out = np.zeros((height, width))
    for r in met:
        out[r["row"]] = np.frombuffer(bytes(r["values"]), "<f4")
    return out


def _sketch(passages, own, weights, basis, gram: bool) -> np.ndarray:
    """``A^T (A basis)``, or ``(A basis)^T (A basis)`` with ``gram``, over all passages."""
    height, width = (basis.shape[1] if gram else basis.shape[0]), basis.shape[1]
    shared = passages.sparkSession.sparkContext.broadcast((own, weights, basis))

    def run(batches):
        own, weights, basis = shared.value
        out = np.zeros((height, width))
        for _, count, _, place, block in _rows(batches):
            term, block, runs, at = _active(place, block, count, own)
            if not len(term):
                continue
            y = _window_sum(_project(term, block, len(at), weights, basis), runs)
            if gram:
                out += y.T @ y
                continue
            both = y.copy()
            inner = np.ones(len(at), dtype=bool)
            inner[np.cumsum(runs) - runs] = False
            both[inner] += y[np.flatnonzero(inner) - 1]  # a block is in its own passage and in the one before
            for lo in range(0, len(term), 1 << 14):
                t, b = term[lo : lo + (1 << 14)], block[lo : lo + (1 << 14)]
                order = np.argsort(t, kind="stable")
                cuts = np.flatnonzero(np.append(True, t[order][1:] != t[order][:-1]))
                out[t[order][cuts]] += weights[t[order][cuts]][:, None] * np.add.reduceat(both[b[order]], cuts, axis=0)
        used = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([out[i].astype("<f4").tobytes() for i in used], pa.binary())], names=["row", "values"]
        )

    return _sum_matrices(passages.mapInArrow(run, "row int, values binary"), width, height)


def latent_space(passages, own, weights, rows: np.ndarray, often: np.ndarray) -> np.ndarray:
    """An orthonormal basis (terms x RANK) by randomised SVD of the passages and the benchmark's rows.

    The benchmark's rows count as much as all passages together could (by the terms' frequencies), so
    their directions come first and a passage that is in the corpus but once is still told apart.
    """
    share = 1 + 4 * float((often * weights**2).sum())
    terms, width = rows.shape[1], min(RANK + EXTRA, rows.shape[1])
    omega = np.random.default_rng(7).standard_normal((terms, width)).astype(np.float32)
    sketch = _sketch(passages, own, weights, omega, False) + share * (rows.T @ (rows @ omega)).astype(np.float64)
    q = np.linalg.qr(sketch)[0].astype(np.float32)
    gram = _sketch(passages, own, weights, q, True) + share * ((rows @ q).T @ (rows @ q)).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(values)[::-1][:RANK]
    return (q @ vectors[:, top]).astype(np.float32)


def _candidates(passages, own, weights, basis, queries, owner, outside_weight, kind) -> DataFrame:
    """Columns _id, item, block, cosine of all passages near a window of an item."""
    shared = passages.sparkSession.sparkContext.broadcast((own, weights, basis, queries, owner))

    def run(batches):
        own, weights, basis, queries, owner = shared.value
        for ids, count, outside, place, block in _rows(batches):
            term, number, runs, at = _active(place, block, count, own)
            if not len(term):
                continue
            y = _window_sum(_project(term, number, len(at), weights, basis), runs)
            # Norms in the full space: the weights of all terms of the vocabulary, and of the words outside.
            square = np.zeros(len(at))
            keys, times = np.unique(number * len(weights) + term, return_counts=True)
            np.add.at(square, keys // len(weights), (times * weights[keys % len(weights)]) ** 2)
            square += outside[at] * outside_weight**2
            length = np.sqrt(np.maximum(_window_sum(square, runs), 1e-9))
            text = np.searchsorted(np.cumsum(count), at, side="right")
            first = (np.cumsum(count) - count)[text]
            for lo in range(0, len(at), 4096):
                near = (y[lo : lo + 4096] @ queries.T) / length[lo : lo + 4096, None]
                row, col = np.nonzero(near >= COSINE)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(text[lo + row])),
                            pa.array(owner[col].astype(np.int32)),
                            pa.array((at[lo + row] - first[lo + row]).astype(np.int64)),
                            pa.array(near[row, col].astype(np.float64)),
                        ],
                        names=["_id", "item", "block", "cosine"],
                    )

    return passages.mapInArrow(run, f"_id {kind}, item int, block long, cosine double")


def _searched(words: list, vocabulary: np.ndarray, weight: np.ndarray, often: np.ndarray, windows: list) -> list:
    """What ``_overlaps`` looks for: by width of a segment, groups of items and their postings."""
    rows: dict[int, list] = {}
    for i, places in windows:
        rows.setdefault(i, []).append(places)
    classes: dict[int, list] = {}
    for i, own in enumerate(words):
        place, times = np.unique(np.searchsorted(vocabulary, own), return_counts=True)
        share = weight[place] * times
        if not len(own) or share.sum() <= 0:
            continue
        share /= share.sum()
        order = np.argsort(-often[place], kind="stable")
        spared = order[np.cumsum(share[order]) <= SPARED]
        first = np.ones(len(place), dtype=bool)
        first[spared] = False
        near = np.zeros((len(rows.get(i, ())), len(place)))
        for k, one in enumerate(rows.get(i, ())):
            near[k, np.searchsorted(place, one)] = weight[one] / max(np.linalg.norm(weight[one]), 1e-9)
        reach = -(-len(own) // STRIDE)
        step = 1 << (2 * reach + 1).bit_length()  # no less than the 2 * reach + 2 blocks around a passage
        classes.setdefault(step, []).append((i, place, times, share, first, LCS_WITH_ANSWER - share[spared].sum() - 1e-6, reach, near))
    out = []
    for step, own in classes.items():
        for lo in range(0, len(own), TOGETHER):
            part = own[lo : lo + TOGETHER]
            term = np.concatenate([p[1][p[4]] for p in part])
            item = np.repeat(np.arange(len(part)), [int(p[4].sum()) for p in part])
            share = np.concatenate([p[3][p[4]] for p in part])
            order = np.argsort(term, kind="stable")
            start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
            out.append((step, part, start, item[order], share[order], np.array([p[5] for p in part])))
    return out


def _overlaps(passages, searched, weight, rare, outside_weight, kind) -> DataFrame:
    """Columns _id, item, block, cosine of all passages whose surroundings, as ``_confirm`` compares them,
    hold words of an item with ``LCS_WITH_ANSWER`` of its weight: no common subsequence weighs more.

    Segments of two steps overlap by one, so the surroundings of every passage lie whole in one of them.
    """
    shared = passages.sparkSession.sparkContext.broadcast((searched, weight, rare))

    def run(batches):
        searched, weight, rare = shared.value
        for ids, count, outside, place, block in _rows(batches):
            first = np.cumsum(count) - count
            text = np.searchsorted(np.cumsum(count), block, side="right")
            found = []
            for step, items, start, item, share, least in searched:
                parts = -(-count // step)
                part_first = np.cumsum(parts) - parts
                mine = np.flatnonzero(start[place + 1] > start[place])
                k = (block[mine] - first[text[mine]]) // step
                at = part_first[text[mine]] + k
                width = len(start)
                keys = np.unique(np.concatenate([at * width + place[mine], (at * width + place[mine] - width)[k > 0]]))
                cuts = np.searchsorted(keys // width, np.arange(0, int(parts.sum()) + 256, 256))
                for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    term, segment = keys[a:b] % width, keys[a:b] // width - 256 * c
                    many = start[term + 1] - start[term]
                    spot = np.arange(int(many.sum())) + np.repeat(start[term] - (np.cumsum(many) - many), many)
                    sums = np.bincount(np.repeat(segment, many) * len(items) + item[spot], share[spot], 256 * len(items))
                    for seg, i in zip(*np.nonzero(sums.reshape(256, -1) >= least), strict=True):
                        t = int(np.searchsorted(part_first + parts, seg + 256 * c, side="right"))
                        base = (int(seg) + 256 * c - int(part_first[t])) * step
                        size = min(2 * step, int(count[t]) - base)
                        found += _near(items[i], t, base, size, int(first[t]) + base, place, block, outside, weight, rare, outside_weight)
            if found:
                owner, items, at, cosine = (np.array(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array(items.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(cosine.astype(np.float64))],
                    names=["_id", "item", "block", "cosine"],
                )

    return passages.mapInArrow(run, f"_id {kind}, item int, block long, cosine double")


def _near(item, text, base, size, at, place, block, outside, weight, rare, outside_weight):
    """Text, item, block and cosine of the passages of a segment that overlap enough with an item."""
    number, terms, times, share, _, _, reach, rows = item
    lo, hi = np.searchsorted(block, [at, at + size])
    spot = np.searchsorted(terms, place[lo:hi])
    own = terms[np.minimum(spot, len(terms) - 1)] == place[lo:hi]
    held = np.bincount((block[lo:hi][own] - at) * len(terms) + spot[own], minlength=size * len(terms)).reshape(size, -1)
    sums = np.concatenate([np.zeros((1, len(terms)), dtype=np.int64), np.cumsum(held, axis=0)])
    b = np.arange(size)
    around = sums[np.minimum(b + 2 + reach, size)] - sums[np.maximum(b - reach, 0)]
    enough = np.flatnonzero((np.minimum(around, times) * (share / times)).sum(axis=1) >= LCS_WITH_ANSWER - 1e-6)
    out = []
    for k in enough.tolist():
        end = min(k + 2, size)
        a, z = np.searchsorted(block, [at + k, at + end])
        keys, n = np.unique(block[a:z] * len(weight) + place[a:z], return_counts=True)
        term = keys % len(weight)
        square = ((n * weight[term] * rare[term]) ** 2).sum() + outside[at + k : at + end].sum() * outside_weight**2
        met = (rows @ ((sums[end] - sums[k]) * weight[terms])).max() if len(rows) else 0.0
        out.append((text, number, base + k, min(1.0, met / max(np.sqrt(square), 1e-9))))
    return out


def weighted_lcs(item: np.ndarray, weights: np.ndarray, text: np.ndarray) -> float:
    """Largest weight of a common subsequence, as a share of the item's weight."""
    whole = float(weights.sum())
    best = np.zeros(len(text) + 1)
    if whole <= 0:
        return 0.0
    for word, weight in zip(item, weights, strict=True):
        at = np.flatnonzero(text == word)
        if len(at):
            new = best.copy()
            new[at + 1] = np.maximum(new[at + 1], best[at] + weight)
            best = np.maximum.accumulate(new)
    return float(best[-1]) / whole


def _confirm(docs: DataFrame, found: DataFrame, items: list) -> DataFrame:
    """Columns _id, item, cosine, lcs, answer of the candidates that are leaks.

    ``items`` holds for each item its words, their weights and the same for its answer.
    """
    spark, kind = docs.sparkSession, docs.schema["_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(items)
    near = found.groupBy("_id", "item", "block").agg(F.max("cosine").alias("cosine"))
    near = near.groupBy("_id").agg(F.collect_list(F.struct("item", "block", "cosine")).alias("near")).withColumnRenamed("_id", "_key")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = item_words(batch.column(1)[i].as_py())
                best: dict[int, tuple] = {}
                for c in batch.column(2)[i].as_py():
                    item, weights, answer, answer_weights = shared.value[c["item"]]
                    lo = max(0, c["block"] * STRIDE - len(item))
                    part = words[lo : (c["block"] + 2) * STRIDE + len(item)]
                    lcs = weighted_lcs(item, weights, part)
                    if lcs < LCS_WITH_ANSWER:
                        continue
                    told = weighted_lcs(answer, answer_weights, part)
                    if lcs >= LCS or told >= ANSWER:
                        best[c["item"]] = max(best.get(c["item"], (0.0, 0.0, 0.0)), (lcs, told, c["cosine"]))
                if best:
                    n = len(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, 1).take(pa.array([0] * n)),
                            pa.array(list(best), pa.int32()),
                            *[pa.array([b[k] for b in best.values()], pa.float64()) for k in (2, 0, 1)],
                        ],
                        names=["_id", "item", "cosine", "lcs", "answer"],
                    )

    near = keep(near, "near")
    docs = probable(docs, near.select("_key"), "_id")
    met = docs.join(near.hint("merge"), docs["_id"] == near["_key"]).select("_id", "_text", "near")
    return met.mapInArrow(run, f"_id {kind}, item int, cosine double, lcs double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and benchmark item found in it: id, item id, cosine, lcs, answer.

    Every passage of every whole text is searched, and all that ``_confirm`` would accept are candidates: the
    result is that of comparing every passage with every item. An item is found where the weighted longest common
    subsequence covers ``LCS`` of it, or ``LCS_WITH_ANSWER`` of it and ``ANSWER`` of its answer. Null and
    empty texts and items match nothing; repeated rows give one row per id and item (the best), repeated
    items a row each; rows with a null id are not reported; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).filter("_id is not null")
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_col)))
    texts = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    texts = keep(texts, "items")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], f"`{id_col}` {kind}, `{item_col}` {item_kind}, cosine double, lcs double, answer double")
    for part in range(parts):
        # A part of the items: their bytes are bounded, so they and their words can be held anywhere.
        own = texts.filter(F.pmod(F.xxhash64("text", "id"), F.lit(parts)) == part).collect()
        own = sorted(((r["id"], r["text"]) for r in own), key=lambda r: (str(r[0]), r[1]))
        found = _leaks_of(rows, own, kind)
        if found is not None:
            names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(own)], f"item int, item_id {item_kind}")
            met = found.join(F.broadcast(names), "item")
            out = out.unionAll(met.select("_id", "item_id", "cosine", "lcs", "answer"))
    out = out.toDF(id_col, item_col, "cosine", "lcs", "answer")
    return out.groupBy(id_col, item_col).agg(*[F.max(c).alias(c) for c in ("cosine", "lcs", "answer")])


def _leaks_of(docs: DataFrame, items: list, kind: str) -> DataFrame | None:
    words = [item_words(text) for _, text in items]
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    if not len(vocabulary):
        return None
    passages = keep(_passages(docs, vocabulary), "passages", "uncompressed")
    often, total = _frequencies(passages, len(vocabulary))
    weight = np.log((total + 1) / (often + 0.5)).clip(0)
    rare = often <= max(COMMON * total, 1)
    windows = []  # item, places of its words in the vocabulary
    for i, own in enumerate(words):
        place = np.searchsorted(vocabulary, own)
        for lo in range(0, max(1, len(place) - STRIDE), STRIDE // 2):
            part = place[lo : lo + 2 * STRIDE]
            part = np.unique(part[rare[part]] if rare[part].any() else part)
            if len(part):
                windows.append((i, part[np.argsort(often[part], kind="stable")[:TERMS]]))
    if not windows:
        return None
    searched = np.zeros(len(vocabulary), dtype=bool)
    searched[np.concatenate([p for _, p in windows])] = True
    found = _overlaps(passages, _searched(words, vocabulary, weight, often, windows), weight, rare, float(np.log(total + 1)), kind)
    found = keep(found, "overlaps")
    passages = _narrowed(passages, searched, rare)
    for lo in range(0, len(windows), WINDOWS):
        part = windows[lo : lo + WINDOWS]
        terms = np.unique(np.concatenate([p for _, p in part]))
        own = np.full(len(vocabulary), -1, dtype=np.int64)
        own[terms] = np.arange(len(terms))
        rows = np.zeros((len(part), len(terms)), dtype=np.float32)
        for k, (_, places) in enumerate(part):
            np.add.at(rows[k], own[places], weight[places])
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        basis = latent_space(passages, own, weight[terms], rows, often[terms])
        queries = (rows @ basis).astype(np.float32)
        owner = np.array([i for i, _ in part])
        near = _candidates(passages, own, weight[terms], basis, queries, owner, float(np.log(total + 1)), kind)
        found = found.unionAll(near)
    known = []
    for (_, text), own in zip(items, words, strict=True):
        answer = item_words(answer_of(text))
        known.append((own, weight[np.searchsorted(vocabulary, own)], answer, weight[np.minimum(np.searchsorted(vocabulary, answer), len(vocabulary) - 1)]))
    return _confirm(docs, keep(found, "candidates"), known)


def op3(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
