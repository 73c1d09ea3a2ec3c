"""Alignment and pair counts against both libraries on whole texts."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from knotwork.llm import alignment
from knotwork.llm.bpe import _byte_letters

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (None, None),
    (1, ""),
    (1, " "),
    (2, "a  b \n c"),
    (3, "x▁y z"),
    (4, "<|endoftext|> <s>a</s><0x41><unk>"),
    (5, "日本語テキスト 🙂👍🏽 क्षि é é"),
    (6, "z" * 30_000),
    (7, "a\x00b c\xa0d \x85e　f \x1cg h"),
    (8, "'s don't we'll 12 345 ... !!?  \t x"),
    (9, " lead trail "),
    (10, "한국어 " * 50 + "ﷺ​﻿ x"),
    (11, "الحرية لكل" * 300),
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def brute(both, rows):
    a_side, b_side = both
    back = {c: b for b, c in enumerate(_byte_letters())}
    spelt = {i: bytes(back.get(c, 63) for c in t) for t, i in a_side.get_vocab().items()}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    per, held = [], collections.Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        x, y = [spelt[i] for i in a], [piece(i) for i in b]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            per.append((doc, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (x, y)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end, s) + 1 for e, s in zip(ends, (i, j), strict=True)]
            groups.append((a[i : to[0]], b[j : to[1]]))
            i, j = to
        links = [(p, q) for left, right in groups for p in left for q in right]
        held.update(set(links))
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        per.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()))
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    rows = [(d, na, nb, ng, len(li), sum(held[x] == most[x[0]] for x in li), sum(held[x] for x in li), h) for d, na, nb, ng, li, h in per]
    return sorted(map(str, rows)), held


@pytest.mark.parametrize("small", [False, True])
def test_against_libraries(spark, both, monkeypatch, small):
    if small:  # many chunks, levels of merging, blocks of a run and slices of a group
        for name, value in {"FAN": 2, "CHUNK": 500, "SLICE": 100, "BLOCK": 16, "HELD": 64, "LONGEST": 6, "KEPT": 10}.items():
            monkeypatch.setattr(alignment, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ODD + [(100 + r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n_a int")
    made = alignment.Alignment(df, *alignment.files(FIRST, SECOND))
    want, held = brute(both, rows)
    assert sorted(str(tuple(r)) for r in made.documents().collect()) == want
    assert len(made.levels) > (3 if small else 1)
    found = made.pairs().collect()
    assert {(r["first"], r["second"]): r["documents"] for r in found} == dict(held)
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    assert all(r["best"] == (r["documents"] == most[r["first"]]) for r in found)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    made = alignment.Alignment(empty, *alignment.files(FIRST, SECOND))
    assert made.documents().count() == 0 and made.pairs().count() == 0


def test_runs_a_chunk_do_not_grow(spark):
    """A chunk sends one run for each radix at most, and no task merges more than FAN of them, whatever the input."""
    words = lambda n: [(i, " ".join(f"w{(i * 31 + j) % 997}" for j in range(200))) for i in range(n)]
    for n in (50, 800):
        df = spark.createDataFrame(words(n), "doc_id long, text string").repartition(n // 10)
        made = alignment.Alignment(df, *alignment.files(FIRST, SECOND))
        sent = made.levels[0].groupBy("name").count().agg({"count": "max"}).first()[0]
        assert sent <= alignment.RADIXES


def test_merge_of_runs():
    rng = np.random.default_rng(3)
    runs, want = [], collections.Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(-50, 5000, rng.integers(0, 3000)))
        counts = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        runs.append(alignment.pack_run([(keys, counts)]))
    keys, counts = alignment.whole(alignment.pack_run(alignment.merge(runs)))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == dict(want) and keys.tolist() == sorted(want)
