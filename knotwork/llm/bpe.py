"""BPE by automaton: the merges become transitions between tokens, words are read by table.

Each merge ``(u, v)`` is a gadget on a deterministic automaton whose arcs are tokens: where ``u`` leads
to a state that has ``v``, that state is copied without ``v``, ``u`` is led to the copy, and a new arc
``uv`` goes where ``v`` went. After all merges, in order, the automaton has one state per last token and
exactly one path for each word, whose arc labels are its tokens. Written out, the table would have a cell
for each pair of tokens; a cell is worked out when a word first needs it, by running the gadgets that
touch the pair, and kept.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from knotwork.llm.common import table

#: Texts are read in slices of about this many characters, cut at white space.
SLICE = 1 << 16
#: Words and table cells kept by a task: so many new ones at most, and those of the time before.
KEPT_WORDS, KEPT_CELLS, KEPT_WINDOWS = 100_000, 120_000, 30_000
#: Words that a worker keeps from task to task for ``digests``, counted in the same way: some 110 MB for each generation.
KEPT_DIGESTED = 300_000
#: Letters of the longest word that is kept.
LONGEST_KEPT = 64
#: Letters whose arcs are looked up at once.
WINDOW = 4

# Fixed value: white space as the tokenizer's patterns take it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_letters() -> str:
    """The letter that stands for each byte: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class Recent:
    """A map of bounded size: what was not asked for since it last filled up is dropped when it fills again."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Automaton:
    """The compiled merges of one vocabulary file; ``encode`` and ``labels`` are all that is needed."""

    def __init__(self, spec: dict, kept_words: int):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.labels = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.merged: dict[tuple[int, int], int] = {}  # pair to rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # token to rank and pair
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = self.ids[left + right]
            pair = self.ids[left], self.ids[right]
            self.merged.setdefault(pair, rank)
            self.parts.setdefault(token, (rank, *pair))
        # Every start of an arc's letters, with the arc that it spells inside a word, if any.
        self.starts: dict[str, int] = {}
        for name in self.ids:
            letters = name.removesuffix(self.suffix) if self.suffix else name
            for stop in range(1, len(letters) + 1):
                self.starts.setdefault(letters[:stop], -1)
        self.starts.update({name: i for name, i in self.ids.items() if name in self.starts})
        self.longer = {name[:WINDOW] for name in self.starts if len(name) > WINDOW}
        self.base = max(self.labels) + 1
        self.windows = Recent(KEPT_WINDOWS)
        self.cells = Recent(KEPT_CELLS)
        bytes_as = _byte_letters()
        self.letters = {b: c for b, c in enumerate(bytes_as)}
        self.pattern = regex.compile(_pattern_of(spec))
        self.gap = regex.compile(f"[{_SPACE}]")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.words = Recent(kept_words)

    def leads(self, state: int, token: int) -> bool:
        """Whether the state after ``state`` has an arc ``token`` once all gadgets have run.

        The gadgets that matter are run backwards. A gadget that joins the end of the first token with
        the start of the second takes the arc away if it ran before the later of the two was made; the
        same gadget wins on the left, where it ran first.
        """
        known = self.cells.get(state * self.base + token)
        if known is not None:
            return known
        a, b, before = state, token, len(self.merged) + 1
        out = None
        while out is None:
            if self.merged.get((a, b), before) < before:
                out = False
                continue
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            if made_a is None and made_b is None:
                out = True
            elif made_b is None or made_a is not None and made_a[0] > made_b[0]:
                before, a = made_a[0], made_a[2]
            else:
                before, b = made_b[0] + 1, made_b[1]
        self.cells.put(state * self.base + token, out)
        return out

    def near(self, letters: str, ends: bool) -> tuple[tuple[int, ...], bool]:
        """Arcs that spell starts of ``letters``, longest first, as length and token in one number.

        ``ends`` says that the word ends with these letters. The flag says whether longer arcs start with them.
        """
        out = []
        for length in range(1, len(letters) + 1):
            start = letters[:length]
            token = self.ids.get(start + self.suffix, -1) if ends and length == len(letters) else self.starts.get(start, -1)
            if token >= 0:
                out.append(length * self.base + token)
        found = tuple(reversed(out)), not ends and letters in self.longer
        self.windows.put(letters + "\n" if ends else letters, found)
        return found

    def arcs(self, word: str, at: int):
        """Arcs that spell what follows ``at``, longest first, as for ``near``."""
        stop = at + WINDOW
        ends = stop >= len(word)
        letters = word[at:stop]
        known = self.windows.get(letters + "\n" if ends else letters)
        arcs, more = known if known is not None else self.near(letters, ends)
        if more:
            far, base = [], self.base
            for length in range(WINDOW + 1, len(word) - at):
                token = self.starts.get(word[at : at + length])
                if token is None:
                    break
                if token >= 0:
                    far.append(length * base + token)
            else:
                token = self.ids.get(word[at:] + self.suffix)
                if token is not None:
                    far.append((len(word) - at) * base + token)
            return iter((*reversed(far), *arcs))
        return iter(arcs)

    def path(self, word: str) -> list[int]:
        """The tokens on the one path through ``word``, spelt in byte letters.

        The longest arc that a state has is taken. A place that led nowhere after a state is not entered again
        from it, so long words take time in proportion to their length.
        """
        token = self.ids.get(word + self.suffix)
        if token is not None:
            return [token]
        size, base, cells = len(word), self.base, self.cells
        out: list[int] = []
        at, places, open_ = 0, [0], [self.arcs(word, 0)]
        dead: set[int] = set()
        while at < size:
            state = out[-1] if out else -1
            for arc in open_[-1]:
                length, token = divmod(arc, base)
                if dead and (at + length) * base + token in dead:
                    continue
                if state >= 0:
                    leads = cells.new.get(state * base + token)
                    if not (self.leads(state, token) if leads is None else leads):
                        continue
                at += length
                out.append(token)
                places.append(at)
                if at < size:
                    open_.append(self.arcs(word, at))
                break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at * base + out.pop())
                places.pop()
                open_.pop()
                at = places[-1]
        return out

    def word(self, word: str, view):
        """What ``view`` makes of the ids of a pre-split word. A task asks for one view only."""
        known = self.words.get(word)
        if known is None:
            spelt = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
            known = view(self.path(spelt))
            if len(word) <= LONGEST_KEPT:
                self.words.put(word, known)
        return known

    def digested(self, path) -> tuple[int, str, str]:
        """How many ids, the ids in decimal and the labels, each joined by spaces."""
        return len(path), " ".join(map(str, path)), self.decode(path)

    def decode(self, ids) -> str:
        """Emit the labels of the arcs."""
        return " ".join([self.labels[i] for i in ids])

    def read(self, text: str, view=lambda path: (path,)):
        """Yield, for each slice of the text, its words and special tokens as ``view`` shows their ids."""
        at = 0
        while at < len(text):
            stop = at + SLICE
            if stop < len(text):
                gap = self.gap.search(text, stop)
                stop = gap.start() if gap else len(text)
            part, at = text[at:stop], stop
            start = 0
            for hit in self.cut.finditer(part):
                yield self._plain(part[start : hit.start()], view)
                yield [view([self.special[hit[0]]])]
                start = hit.end()
            yield self._plain(part[start:], view)

    def _plain(self, part: str, view):
        if not part:
            return []
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        new, out = self.words.new, []
        for word in self.pattern.findall(part.lower()):
            known = new.get(word)
            if known is None:
                known = self.word(word, view)
                new = self.words.new
            out.append(known)
        return out


def _packed(ids) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


def _pattern_of(spec: dict) -> str:
    """The splitting pattern of the file, with white space spelt out."""
    for step in spec["pre_tokenizer"]["pretokenizers"]:
        if step["type"] == "Split":
            return step["pattern"]["Regex"].replace(r"\s", _SPACE)
    raise ValueError("the file has no splitting pattern")


def compiled(text: str) -> Automaton:
    """The automaton of a vocabulary file's content; a task makes its own in some 0.3 s."""
    return Automaton(json.loads(text), KEPT_WORDS)


@functools.lru_cache(maxsize=1)
def digesting(text: str) -> Automaton:
    """The automaton that a worker's tasks share for ``digested``: about half of a task's words were in earlier tasks."""
    return Automaton(json.loads(text), KEPT_DIGESTED)


def vocabulary(path: str):
    """The content of a vocabulary file, read on the driver (a few MB: its size does not follow the data)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``ids``, the tokens of the whole text in order.

    ``vocab`` is the content of a vocabulary file. Null and empty texts have no tokens; repeated rows and
    null ids are kept; further columns are dropped; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        pa.default_memory_pool().release_unused()  # of a worker's tasks before
        machine = compiled(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                texts = batch.column(1).slice(lo, 64)
                ids = [np.frombuffer(b"".join([w for part in machine.read(t.as_py() or "", _packed) for w in part]), np.int32) for t in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 64), lists], names=["_id", "ids"])

    return _on(docs, id_col, text_col).mapInArrow(run, f"_id {_kind(docs, id_col)}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and text, the labels of the tokens joined by spaces; null counts as none."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        machine = compiled(shared.value)
        for batch in batches:
            texts = [machine.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    pairs = tokens.select(tokens[id_col].alias("_id"), tokens[ids_col].alias("_ids"))
    return pairs.mapInArrow(run, f"_id {_kind(tokens, id_col)}, text string").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens and SHA-256 of the ids and of the decoded text.

    Both are hashed slice by slice, so a text's ids are never held whole. A worker keeps the automaton
    and its words for the tasks that follow. Edge cases as in ``encode``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        machine = digesting(shared.value)

        def one(text):
            count, ids, labels = 0, hashlib.sha256(), hashlib.sha256()
            for part in machine.read(text or "", machine.digested):
                if part:
                    gap = " " if count else ""
                    ids.update((gap + " ".join([w[1] for w in part])).encode())
                    labels.update((gap + " ".join([w[2] for w in part])).encode())
                    count += sum([w[0] for w in part])
            return count, ids.hexdigest(), labels.hexdigest()

        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64())]
                + [pa.array([f[i] for f in found], pa.string()) for i in (1, 2)],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"_id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _on(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _on(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))


def op6(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("word_bpe_49k.json")))
