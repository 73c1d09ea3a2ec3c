"""Repetition measures against a plain count."""

import re
from collections import Counter

import pytest

from knotwork.llm.quality import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c\nx y\nx y\n\n \n \nx y",
    "é è\x85ü #*$ %&|<> z\r\nq",
    "w " * 60,
    " ".join(f"word{i}" for i in range(80)),
    " ".join(f"word{i % 40}" for i in range(80)),
    "\n".join(["same old line of words"] * 3 + [f"line number {i} is new" for i in range(30)]),
    " ".join(f"t{i * 7919 % 5003}" for i in range(300_000)),
    "z" * 1_500_000 + " tail",
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
        len(words) < 50 or 100 * len(inside) > 50 * len(words),
    )


def test_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, "one", 1), (None, "x", 1)]
    got = repetition(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, *brute(t)) for i, t, _ in rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[n] for n in names)) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert kept[7] and not kept[6] and not kept[8]


def test_empty(spark):
    assert repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [5, 10])
def test_shares(spark, n):
    clean = " ".join(f"a{i}" for i in range(100))
    half = clean + " " + " ".join(f"a{i}" for i in range(40))
    row = repetition(spark.createDataFrame([(1, half)], "doc_id long, text string")).first()
    chars = sum(map(len, half.split()))
    assert abs(row[f"share_{n}"] - 2 * sum(len(f"a{i}") for i in range(40)) / chars) < 1e-9 and not row.kept
