"""The automaton against the library that the vocabulary file is made for."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from knotwork.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    "   \n\t ",
    "Hello, World!! it's we'll I'M 1234 x²",
    "<|startoftext|>a b<|endoftext|>",
    "a<|endoftext|><|endoftext|> b <|ENDOFTEXT|>",
    "ΣΑΣ ΟΔΟΣ İstanbul ǅ ß ﬁ Å é क्षि 日本語テキスト 🙂👍🏽 ​﻿",
    "a b c\x1cd\x85e​f",
    "z" * 5000,
    "ab" * 40_000,
    "\x00\x01\x7f\u0080 ﷺ",
    "’s 't 'Re ''ve don't''' --- ...?!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return bpe.compiled(bpe.vocabulary(PATH))


def test_words(library, machine):
    rng = random.Random(5)
    letters = "etaoinshrdlu" * 3 + "cmfwypvbgkjqxz" + "éèüßñ" + "'-.,!0123456789"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for part in machine.read(text) for w in part for i in w[0]] == want, text


def test_operators(spark, library, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (1, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    vocab = bpe.vocabulary(PATH)
    want = {}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i] = ids, library.decode(ids, skip_special_tokens=False)
    tokens = bpe.encode(docs, vocab)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {i: w[0] for i, w in want.items()}
    assert {r.doc_id: r.text for r in bpe.decode(tokens, vocab).collect()} == {i: w[1] for i, w in want.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.digests(docs, vocab).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, text = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert bpe.digests(docs.limit(0), vocab).count() == 0


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(docs, bpe.vocabulary(PATH)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_small_slices(machine, monkeypatch):
    text = "some words <|endoftext|> and more, of them " * 50
    whole = [i for part in machine.read(text) for w in part for i in w[0]]
    monkeypatch.setattr(bpe, "SLICE", 7)
    assert [i for part in machine.read(text) for w in part for i in w[0]] == whole


def test_worker_keeps_words(monkeypatch):
    machine = bpe.digesting(bpe.vocabulary(PATH))
    assert bpe.digesting(bpe.vocabulary(PATH)) is machine
    found = []
    monkeypatch.setattr(machine, "path", lambda word: found.append(word) or bpe.Automaton.path(machine, word))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:15]]
    for _ in range(2):  # two tasks
        assert sum(len(part) for part in machine.read(" ".join(words), machine.digested)) == len(words) == 263_640
    assert len(found) == len(words)
    list(machine.read("w" * 100_000, machine.digested))
    assert len(found) == len(words) + 1 and "w" * 100_000 not in machine.words.new
