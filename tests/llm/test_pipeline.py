"""The pipeline against the brute-force versions of its stages, one after another."""

import duckdb
import public_tokenizers
import test_near_dedup
import test_quality
from test_decontaminate import plain
from tokenizers import Tokenizer

import corpus_pipeline
from knotwork.llm.quality import repetition
from knotwork.llm.suffix_dedup import LENGTH

SF = "/root/testdata/sf0.001"


def cut(rows):
    first = {}
    for i, text in rows:
        data = text.encode()
        for s in range(len(data) - LENGTH + 1):
            w = data[s : s + LENGTH]
            first[w] = min(first.get(w, i), i)
    for i, text in rows:
        data = text.encode()
        gone = [False] * len(data)
        for s in range(len(data) - LENGTH + 1):
            if first[data[s : s + LENGTH]] < i:
                gone[s : s + LENGTH] = [True] * LENGTH
        yield i, bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")


def test_run(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    good = {r.doc_id for r in repetition(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert all(not test_quality.brute(t)[-1] for i, t in rows if i in good)
    rows = [(i, t) for i, t in rows if i in good]
    near = test_near_dedup.brute(rows, words=corpus_pipeline.SHINGLE)
    rows = list(cut([(i, t) for i, t in rows if near[i][1] == i]))
    items = [plain(t) for (t,) in con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    grams = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in items]

    def share(text):
        words = plain(text)
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        return max(len(own & g) / max(1, len(g)) for g in grams)

    shares = {i: share(t) for i, t in rows}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if shares[i] < 0.6}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i for i in want if shares[i] < 0.2} <= set(got) <= set(want)
    assert all(ids == want[i] for i, ids in got.items())


def test_stage_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "extra")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == docs.columns


def test_stage_column_names(spark):
    """Columns named like those that the operators add or use come through all stages unchanged."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "component_id", "n_shingles", "kept", "n_words",
             "base_failed", "item_id", "cosine", "lcs", "answer", "ids", "n_tokens", "chunk", "size", "ends", "texts", "_id", "_text", "_c0", "node", "family"]
    fresh = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{fresh} {i} " + " ".join(f"own{i}x{j}" for j in range(80)), "en", "s", 3, *[f"{c} {i}" for c in names]) for i in (1, 2)]
    rows.append((None, None, None, None, None, *[None] * len(names)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == ({1, 2} if name == "quality_rules" else {1, 2, None})
        assert all(got[i][c] == f"{c} {i}" for i in (1, 2) for c in names)
        if name == "repeated_passages":
            assert got[1].text == rows[0][1] and len(got[2].text) < len(rows[1][1]) and got[2].n_chars == len(got[2].text)
        else:
            assert [got[i].text for i in (1, 2)] == [r[1] for r in rows[:2]]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {1, 2, None}
