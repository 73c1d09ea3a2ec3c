"""Which tokens of two tokenizers cover the same bytes, and how many documents link a pair of them.

Byte offsets where tokens of both sides end cut a text into groups; tokens of a group are linked. Pairs are
counted outside memory. A chunk of documents sends its distinct pairs, with the documents that hold each, as one
compressed run for each radix of the first side's id. ``FAN`` runs of a radix meet in a task, where a heap of
their next blocks merges them; merged runs meet again until one is left for each radix. It is in the
order of the first side, so the highest count of an id is found as its pairs pass by. Counts then go back the
way the runs came, from a merged run to those it was made of, and each chunk adds up what its documents hold.
Every chunk sends as many runs as there are radixes, whatever the input, and no task merges more than ``FAN`` runs.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.bpe import _byte_letters
from knotwork.llm.common import keep, table

#: Bytes of text in a chunk (a longer text is one) and in a slice that is encoded at once.
CHUNK, SLICE = 2 << 20, 1 << 17
#: Radixes of the first side's ids, runs that meet in a task, records in a block of a run.
RADIXES, FAN, BLOCK = 64, 64, 8192
#: Words kept by a task: of this many distinct ones since the last change, and those of the time before.
KEPT, LONGEST = 150_000, 100
#: Pairs of one group that are held at once.
HELD = 1 << 20
#: What is known of a word whose bytes a side does not keep.
NOTHING = 0, 0, 0, 0, "", b"", b""


class Pair:
    """Two tokenizers; ``word`` aligns the tokens of a piece of text. A task makes its own."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        spec = json.loads(first)
        bytes_of = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.size = max(len(self.b_bytes), 1)
        self.span = len(self.a_bytes) * self.size
        self.shown = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]
        self.ones: dict[int, bytes] = {}
        # No token of either side goes on over a single space between two words, so words are encoded apart.
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        apart = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.gap = re.compile(r"(?<=\S) (?=\S)" if apart else r"(?!)")
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def read(self, texts: list[str]) -> list[list[tuple] | None]:
        """For each text what ``word`` gives for its words, or None where the bytes of a side differ from it."""
        words = [self.gap.split(t) if t else [] for t in texts]
        if len(self.new) >= KEPT:
            self.new, self.old = {}, self.new
        found, todo = {}, []
        for w in set().union(*words):
            known = self.new.get(w) or self.old.get(w)
            if known is None:
                todo.append(w)
            else:
                found[w] = self.new[w] = known
        for long in (False, True):  # a long word by itself
            some = [w for w in todo if (len(w) > LONGEST) == long]
            if some:
                first = [e.ids for e in self.a.encode_batch([" " + w for w in some], add_special_tokens=False)]
                second = self.b.encode(some, num_threads=1)
                made = map(self.word, some, first, second) if long else self.aligned(some, first, second)
                found.update(zip(some, made, strict=True))
                if not long:
                    self.new.update((w, found[w]) for w in some)
        out = []
        for part in words:
            entries = [found[w] for w in part]
            out.append(None if any(not e[0] for e in entries) else entries)
        return out

    def word(self, word: str, a: list[int], b: list[int]) -> tuple:
        """Tokens of both sides, groups, links, the groups as text, distinct pairs and how often each is linked.

        All zero where the bytes of a side differ from a space and the word.
        """
        whole = (" " + word).encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return NOTHING
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        common = np.intersect1d(*ends)
        cuts = [np.concatenate([[0], np.searchsorted(e, common) + 1]) for e in ends]
        n = [np.diff(c) for c in cuts]
        names = [list(map(str, side.tolist())) for side in (a, b)]
        (ca, cb) = (c.tolist() for c in cuts)
        text = ";".join([",".join(names[0][ca[g] : ca[g + 1]]) + "|" + ",".join(names[1][cb[g] : cb[g + 1]]) for g in range(len(common))]) + ";"
        links = n[0] * n[1]
        keys, times = self._pairs(a, b, cuts, links)
        return len(a), len(b), len(common), int(links.sum()), text, keys.tobytes(), times.tobytes()

    def aligned(self, words: list[str], first: list[list[int]], second: list[list[int]]) -> list[tuple]:
        """The same for many short words at once."""
        whole = (" " + " ".join(words)).encode()
        a, b = (np.fromiter(itertools.chain.from_iterable(side), np.int64) for side in (first, second))
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            if len(words) == 1:
                return [NOTHING]
            half = len(words) // 2
            return self.aligned(words[:half], first[:half], second[:half]) + self.aligned(words[half:], first[half:], second[half:])
        of_word = [np.fromiter(map(len, side), np.int64, len(words)) for side in (first, second)]
        ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        common = np.intersect1d(*ends, assume_unique=True)
        cuts = [np.concatenate([[0], np.searchsorted(e, common) + 1]) for e in ends]
        sizes = [np.diff(c) for c in cuts]
        groups = [np.repeat(np.arange(len(common)), n) for n in sizes]
        wide = sizes[1][groups[0]]
        right = np.repeat(cuts[1][groups[0]], wide) + _counted(wide)
        keys = (np.repeat(a, wide) * self.size + b[right]).tobytes()
        # Tokens of both sides in the order of the text of the groups, with what follows each.
        code = np.empty(len(a) + len(b), np.int64)
        last = [np.zeros(len(side), np.int64) for side in (a, b)]
        for flag, cut in zip(last, cuts, strict=True):
            flag[cut[1:] - 1] = 1
        code[np.arange(len(a)) + cuts[1][groups[0]]] = 2 * a + last[0]
        code[np.arange(len(b)) + cuts[0][groups[1] + 1]] = 2 * (len(self.a_bytes) + b) + last[1]
        shown = list(map(self.shown.__getitem__, code.tolist()))
        tokens = [np.concatenate([[0], np.cumsum(n)]) for n in of_word]
        at = np.searchsorted(cuts[0], tokens[0])
        linked = np.concatenate([[0], np.cumsum(wide)])[tokens[0]]
        bounds = (tokens[0] + tokens[1]).tolist()
        counts = zip(*[np.diff(x).tolist() for x in (*tokens, at, linked)], strict=True)
        for n in set(np.diff(linked).tolist()) - self.ones.keys():
            self.ones[n] = np.ones(n, np.int64).tobytes()
        linked = (8 * linked).tolist()
        return [
            (*count, "".join(shown[bounds[i] : bounds[i + 1]]), keys[linked[i] : linked[i + 1]], self.ones[count[3]])
            for i, count in enumerate(counts)
        ]

    def _pairs(self, a, b, cuts, links):
        small = links <= HELD
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0
        order = np.flatnonzero(small)
        for part in np.split(order, np.searchsorted(np.cumsum(links[order]), np.arange(HELD, int(links[order].sum()), HELD))):
            n = np.diff(cuts[1])[part]
            group = np.repeat(part, np.diff(cuts[0])[part])
            left = np.repeat(cuts[0][part], np.diff(cuts[0])[part]) + _counted(np.diff(cuts[0])[part])
            wide = np.diff(cuts[1])[group]
            right = np.repeat(cuts[1][group], wide) + _counted(wide)
            if len(n):
                k, t = np.unique(np.repeat(a[left], wide) * self.size + b[right], return_counts=True)
                keys.append(k)
                times.append(t)
        for g in np.flatnonzero(~small):  # a group of very many tokens: ids of one side in slices
            x, nx = np.unique(a[cuts[0][g] : cuts[0][g + 1]], return_counts=True)
            y, ny = np.unique(b[cuts[1][g] : cuts[1][g + 1]], return_counts=True)
            step = max(1, HELD // len(y))
            for lo in range(0, len(x), step):
                keys.append((x[lo : lo + step, None] * self.size + y[None, :]).ravel())
                times.append((nx[lo : lo + step, None] * ny[None, :]).ravel())
                held += len(keys[-1])
                if held > 4 * HELD:
                    keys, times = ([v] for v in _summed(np.concatenate(keys), np.concatenate(times)))
                    held = 0
        return _summed(np.concatenate(keys), np.concatenate(times))


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


# --- runs --------------------------------------------------------------------------------------

def pack_run(parts) -> bytes:
    """A run of records in key order: blocks of keys, as steps, and counts, each block one zstd frame."""
    packer, out, held = zstandard.ZstdCompressor(level=1), [], [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def put(keys, counts):
        frame = packer.compress(np.diff(keys, prepend=0).astype(np.int64).tobytes() + counts.astype(np.int64).tobytes())
        out.append(struct.pack("<II", len(keys), len(frame)) + frame)

    for part in parts:
        held = [np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]
        while len(held[0]) >= BLOCK:
            put(held[0][:BLOCK], held[1][:BLOCK])
            held = [h[BLOCK:] for h in held]
    if len(held[0]):
        put(*held)
    return b"".join(out)


def blocks_of(run: bytes):
    """The blocks of a run, one at a time."""
    opener, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        n, size = struct.unpack_from("<II", run, at)
        at += 8
        values = np.frombuffer(opener.decompress(run[at : at + size], max_output_size=16 * n), np.int64)
        yield np.cumsum(values[:n]), values[n:]
        at += size


def merge(runs: list[bytes]):
    """Blocks of all keys of ``runs`` in order with summed counts.

    The heap holds the last key of every run's open block; up to the least of them all records are at hand.
    """
    sources = [blocks_of(r) for r in runs]
    opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def pull(i):
        block = next(sources[i], None)
        if block is not None:
            opened[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(sources)):
        pull(i)
    while heap:
        upto, taken = heap[0][0], []
        for i, (keys, counts) in opened.items():
            n = int(np.searchsorted(keys, upto, side="right"))
            if n:
                taken.append((keys[:n], counts[:n]))
                opened[i] = keys[n:], counts[n:]
        yield _summed(*(np.concatenate(side) for side in zip(*taken, strict=True)))
        while heap and heap[0][0] == upto:
            _, i = heapq.heappop(heap)
            del opened[i]
            pull(i)


def whole(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = list(blocks_of(run))
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))


def _pack_answer(counts: np.ndarray, best: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int64).tobytes() + best.astype(np.uint8).tobytes())


def _unpack_answer(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=9 * n) if n else b""
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n) if n else np.zeros(0, np.uint8)


# --- documents -----------------------------------------------------------------------------------

STATS = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(docs: DataFrame, first: str, second: bytes, id_col: str, text_col: str) -> DataFrame:
    """Encode all texts and write the chunks: what is known of each document, its records, and the runs of the chunk."""
    rows = docs.select(docs[text_col].cast("string").alias("_text"), docs[id_col].alias("_id"))
    kind = rows.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches):
        pair, packer = Pair(*shared.value), zstandard.ZstdCompressor(level=1)
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def finish():
            nonlocal at, held, size
            ids = pa.concat_arrays([h[0] for h in held])
            stats = [[s for h in held for s in h[1][i]] for i in range(len(STATS) + 1)]
            keys = np.concatenate([k for h in held for k in h[2]])
            times = np.concatenate([k for h in held for k in h[3]])
            doc = np.repeat(np.arange(len(ids)), [len(k) for h in held for k in h[2]])
            keys, times = _summed(doc * pair.span + keys, times)
            doc, keys = keys // pair.span, keys % pair.span
            distinct, index, n = np.unique(keys, return_inverse=True, return_counts=True)
            radix = (distinct // pair.size) % RADIXES
            order = np.lexsort((distinct, radix))
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            cuts = np.searchsorted(radix[order], np.arange(RADIXES + 1))
            runs, sizes = [], np.diff(cuts)
            for r in np.flatnonzero(sizes):
                mine = order[cuts[r] : cuts[r + 1]]
                runs.append({"radix": int(r), "run": pack_run([(distinct[mine], n[mine])])})
            records = np.bincount(doc, minlength=len(ids))
            arrays = [
                pa.array([at]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *[pa.array([s], pa.list_(pa.int64())) for s in stats[:-1]],
                pa.array([stats[-1]], pa.list_(pa.string())),
                pa.array([records.tolist()], pa.list_(pa.int64())),
                pa.array([packer.compress(place[index].astype(np.int32).tobytes() + times.astype(np.int64).tobytes())]),
                pa.array([sizes.tolist()], pa.list_(pa.int32())),
                pa.array([runs], pa.list_(pa.struct([("radix", pa.int32()), ("run", pa.binary())]))),
            ]
            at, held, size = at + 1, [], 0
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "ids", *STATS, "digests", "records", "index", "sizes", "runs"])

        def take(ids, texts):
            stats, keys, times = [[] for _ in range(len(STATS) + 1)], [], []
            for entries in pair.read(texts):
                for i in range(len(STATS)):
                    stats[i].append(sum([e[i] for e in entries]) if entries else 0)
                stats[-1].append(hashlib.sha256("".join([e[4] for e in entries])[:-1].encode()).hexdigest() if entries else "")
                k, t = (np.frombuffer(b"".join([e[i] for e in entries]), np.int64) if entries else np.zeros(0, np.int64) for i in (5, 6))
                k, t = _summed(k, t) if len(k) > HELD else (k, t)
                keys.append(k)
                times.append(t)
            held.append((ids, stats, keys, times))

        for batch in batches:
            texts, lo, wide = [], 0, 0
            for i in range(batch.num_rows):
                texts.append(batch.column(0)[i].as_py() or "")
                wide += len(texts[-1])
                if wide >= SLICE or i + 1 == batch.num_rows:
                    take(batch.column(1).slice(lo, i + 1 - lo), texts)
                    size, lo, texts, wide = size + wide, i + 1, [], 0
                    if size >= CHUNK:
                        yield finish()
        if held:
            yield finish()

    stats = ", ".join(f"{s} array<long>" for s in STATS)
    schema = f"chunk long, ids array<{kind}>, {stats}, digests array<string>, records array<long>, index binary, sizes array<int>, runs array<struct<radix: int, run: binary>>"
    return keep(rows.mapInArrow(run, schema), "chunks", "uncompressed")


class Alignment:
    """The written chunks and merged runs of a table of texts."""

    def __init__(self, docs: DataFrame, first: str, second: bytes, id_col: str = "doc_id", text_col: str = "text"):
        """Encode ``docs`` by the two tokenizers (the text of a ``tokenizers`` file, the bytes of a ``sentencepiece``
        model) and count the linked pairs of the whole table.

        The first side encodes a space and the text, the second the text. Null and empty texts and texts that a side
        does not keep byte for byte have no tokens: zeros, and '' as digest of the groups. Null and repeated ids
        are kept, every row counts as a document; an empty table gives no rows; other columns are not read. A text is
        encoded whole, its words apart where no token crosses their gap, so memory follows the longest word.
        """
        self.id_col = id_col
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.width = Pair(first, second).size
        self.chunks = _chunks(docs, first, second, id_col, text_col)
        total = self.chunks.count()
        n = max(1, -(-total // FAN))
        runs = self.chunks.select("chunk", F.explode("runs").alias("r")).select("r.radix", F.pmod(F.xxhash64("chunk"), F.lit(n)).alias("up"), F.col("chunk").alias("name"), "r.run")
        self.levels = [runs]  # runs that were merged, with the number of what they went into
        while True:
            made = keep(runs.groupBy("radix", "up").applyInArrow(_merged, "radix int, name long, run binary"), "runs", "uncompressed")
            runs = made.select("radix", F.expr(f"name div {FAN}").alias("up"), "name", "run")
            self.levels.append(runs)
            if n == 1:
                break
            n = -(-n // FAN)

    def pairs(self) -> DataFrame:
        """first, second (ids), documents and best: whether no pair of that first id is in more documents."""
        width = self.width

        def run(batches):
            for batch in batches:
                for data in batch.column("run"):
                    keys, counts = whole(data.as_py())
                    best = _best(keys // width, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys // width, keys % width, counts, best)], names=["first", "second", "documents", "best"])

        return self.levels[-1].select("run").mapInArrow(run, "first long, second long, documents long, best boolean")

    def _answers(self) -> DataFrame:
        """(radix, name, answer) for the runs of chunks: counts and marks of the highest in the order of the run."""
        width = self.width

        def top(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    keys, counts = whole(batch.column("run")[i].as_py())
                    answer = _pack_answer(counts, _best(keys // width, counts))
                    yield pa.RecordBatch.from_arrays([batch.column("radix").slice(i, 1), batch.column("name").slice(i, 1), batch.column("run").slice(i, 1), pa.array([answer])], names=["radix", "up", "run", "answer"])

        told = self.levels[-1].select("radix", "name", "run").mapInArrow(top, "radix int, up long, run binary, answer binary")
        for level in range(len(self.levels) - 2, -1, -1):
            asked = self.levels[level].select("radix", "up", "name", "run")
            met = asked.groupBy("radix", "up").cogroup(told.groupBy("radix", "up"))
            found = met.applyInArrow(_told(level > 0), "radix int, up long, run binary, answer binary")
            told = keep(found, "answers", "uncompressed")
        return told.select("radix", F.col("up").alias("name"), "answer")

    def documents(self) -> DataFrame:
        """One row per input row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        own = self._answers().groupBy("name").agg(F.collect_list(F.struct("radix", "answer")).alias("answers"))
        met = self.chunks.drop("runs").join(own, self.chunks["chunk"] == own["name"], "left")

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    at = lambda name: batch.column(name)[row]  # noqa: B023, E731
                    sizes, records = at("sizes").values.to_numpy(), at("records").values.to_numpy()
                    starts, n, total = np.cumsum(sizes) - sizes, int(records.sum()), int(sizes.sum())
                    counts, best = np.zeros(total, np.int64), np.zeros(total, np.int64)
                    for a in at("answers").as_py() or ():
                        r = a["radix"]
                        part = slice(int(starts[r]), int(starts[r] + sizes[r]))
                        counts[part], best[part] = _unpack_answer(a["answer"], int(sizes[r]))
                    raw = zstandard.ZstdDecompressor().decompress(at("index").as_py(), max_output_size=max(1, 12 * n)) if n else b""
                    index, times = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int64, n, 4 * n) if n else np.zeros(0, np.int64)
                    ends = np.concatenate([[0], np.cumsum(records)])
                    sums = [np.concatenate([[0], np.cumsum(v[index] * times)]) for v in (best, counts)]
                    sums = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
                    known = [at(name).values for name in ("ids", *STATS)]
                    yield pa.RecordBatch.from_arrays([*known, *sums, at("digests").values], names=["_id", *STATS, "n_best", "count_sum", "groups_sha256"])

        schema = f"_id {self.kind}, " + ", ".join(f"{s} long" for s in (*STATS, "n_best", "count_sum")) + ", groups_sha256 string"
        return met.mapInArrow(run, schema).withColumnRenamed("_id", self.id_col)


def _best(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a record has the highest count of its first id; records are in the order of that id."""
    if not len(first):
        return np.zeros(0, bool)
    new = np.concatenate([[True], first[1:] != first[:-1]])
    highest = np.maximum.reduceat(counts, np.flatnonzero(new))
    return counts == highest[np.cumsum(new) - 1]


def _merged(rows: pa.Table) -> pa.Table:
    run = pack_run(merge([r.as_py() for r in rows.column("run")]))
    return pa.table({"radix": rows.column("radix").slice(0, 1), "name": rows.column("up").slice(0, 1).cast(pa.int64()), "run": pa.array([run])})


def _told(with_runs: bool):
    """Task helper: answers to the runs that a merged run was made of."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        radixes, names, runs, answers = [], [], [], []
        if asked.num_rows and told.num_rows:
            keys, _ = whole(told.column("run")[0].as_py())
            counts, best = _unpack_answer(told.column("answer")[0].as_py(), len(keys))
            for i in range(asked.num_rows):
                data = asked.column("run")[i].as_py()
                at = np.searchsorted(keys, whole(data)[0])
                radixes.append(asked.column("radix")[i].as_py())
                names.append(asked.column("name")[i].as_py())
                runs.append(data if with_runs else None)
                answers.append(_pack_answer(counts[at], best[at]))
        return pa.table({"radix": pa.array(radixes, pa.int32()), "up": pa.array(names, pa.int64()), "run": pa.array(runs, pa.binary()), "answer": pa.array(answers, pa.binary())})

    return run


def files(first: str, second: str) -> tuple[str, bytes]:
    """The contents of two vocabulary files, read on the driver (a few MB, whatever the data)."""
    with open(first, encoding="utf-8") as a, open(second, "rb") as b:
        return a.read(), b.read()


def op12(spark, sf_dir):
    import public_tokenizers as public

    both = files(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    return Alignment(table(spark, sf_dir, "documents"), *both).documents()
