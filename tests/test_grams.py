"""Texts by what they contain, against plain search, and the index stored with a snapshot."""

import random
import re

import pytest

from helpers import graph, people, rows
from knotwork.operators import grams as G
from knotwork.operators import resolve as N
from knotwork.operators.text import build_text_index, entity_documents
from knotwork.sources import gramstore, tables


def _some(spark, seed=1, n=60):
    r = random.Random(seed)
    word = lambda most: "".join(r.choice("abÄ%_ c") for _ in range(r.randint(0, most)))
    entities = [(f"e{i}", word(7), word(3) or "t", word(12) or None) for i in range(n)]
    wants = sorted({word(5) for _ in range(60)} | {"", "a", "ää", "AB", "zzz", entities[0][3] or "b"})
    return graph(spark, entities), wants, entities


def _plain(entities, wants, fields):
    place = {"name": 1, "entity_type": 2, "description": 3}
    return sorted(
        (w, e[0]) for w in wants for e in entities
        if w and any(w.lower() in (e[place[f]] or "").lower() for f in fields)
    )


@pytest.mark.parametrize("slot_rows", [G.SLOT_ROWS, 3])
@pytest.mark.parametrize("fields", [G.FIELDS, ("name",), ("entity_type", "name")])
def test_contained_texts(spark, monkeypatch, slot_rows, fields):
    monkeypatch.setattr(G, "SLOT_ROWS", slot_rows)
    g, wants, entities = _some(spark)
    index = G.build_gram_index(g)
    asked = spark.createDataFrame([(w,) for w in [*wants, None, wants[1]]], "want string")
    assert rows(G.containing(index, asked, fields), "want", "id") == _plain(entities, wants, fields) != []


def test_a_much_used_substring_is_spread(spark, monkeypatch):
    monkeypatch.setattr(G, "SLOT_ROWS", 10)
    g = people(spark, [f"Customer {i:03d}" for i in range(200)])
    index = G.build_gram_index(g, ["name"])
    (slots,) = rows(index.terms.filter("gram = 'cus'"), "slots")
    parts = rows(index.postings.filter("part like 'name:%:cus'").groupBy("part").count(), "part", "count")
    assert slots == (20,) and sum(n for _, n in parts) == 200 and max(n for _, n in parts) < 40 and len(parts) > 10
    asked = spark.createDataFrame([("tomer 19",), ("us",)], "want string")
    assert G.containing(index, asked).groupBy("want").count().collect() in ([("tomer 19", 10), ("us", 200)], [("us", 200), ("tomer 19", 10)])


def test_fields_outside_the_index(spark):
    index = G.build_gram_index(people(spark, ["abc"]), ["name"])
    with pytest.raises(ValueError):
        G.containing(index, spark.createDataFrame([("a",)], "want string"), ["description"])


def test_empty_tables(spark):
    index = G.build_gram_index(graph(spark))
    asked = spark.createDataFrame([("abc",), ("a",)], "want string")
    assert G.containing(index, asked).count() == 0
    full = G.build_gram_index(people(spark, ["abc"]))
    assert G.containing(full, asked.limit(0)).count() == 0


def test_stored_index(spark, tmp_path):
    store = str(tmp_path / "store")
    g, wants, entities = _some(spark, 2)
    with pytest.raises(ValueError):
        gramstore.save_gram_index(spark, store)
    tables.save_graph(g, store, "v1")
    assert gramstore.load_gram_index(spark, store) is None
    gramstore.save_gram_index(spark, store, buckets=8)
    index, kept = gramstore.load_gram_index(spark, store), tables.load_graph(spark, store)
    asked = spark.createDataFrame([(w,) for w in wants], "want string")
    assert rows(G.containing(index, asked), "want", "id") == _plain(entities, wants, G.FIELDS)
    # A later snapshot with the same entities keeps it, one with others does not.
    tables.save_graph(kept, store, "v2", changed={"observations"})
    assert gramstore.load_gram_index(spark, store) is not None
    kept = tables.load_graph(spark, store)
    tables.save_graph(kept, store, "v3", changed={"entities"})
    assert gramstore.load_gram_index(spark, store) is None
    tables.prune_snapshots(spark, store, 1)
    assert not list((tmp_path / "store" / "grams").iterdir())


def test_few_requests_read_few_buckets(spark, tmp_path):
    store = str(tmp_path / "store")
    tables.save_graph(people(spark, [f"Customer {i:03d}" for i in range(300)]), store, "v1")
    gramstore.save_gram_index(spark, store, buckets=32)
    index = gramstore.load_gram_index(spark, store)
    wanted = spark.createDataFrame([("r 123",)], "want string")
    plan = G.containing(index, wanted)._jdf.queryExecution().executedPlan().toString()
    (read, of), = re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)
    assert (read, of) == ("1", "32")
    parts = spark.createDataFrame([("name:0:123",), ("name:0:r 1",)], "part string")
    plan = G._only(index.postings, "part", parts, True).groupBy("part").count()._jdf.queryExecution().executedPlan().toString()
    (read, of), = re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)
    assert int(read) <= 2 and of == "32"
    assert rows(G.containing(index, wanted), "name") == [("Customer 123",)]


def test_suggestions_from_all_texts(spark):
    g = graph(spark, [("1", "Mercury", "planet", "closest to the sun"), ("2", "Hg", "metal", "mercury by another name"),
                      ("3", "Apollo", "planet craft"), ("4", "Apollo", "god", "sun and music"), ("5", "50%_off", "sale")])
    asked = spark.createDataFrame([("a", "sun"), ("b", "metal"), ("c", "0%_O"), ("d", "qqq"), ("e", "mercury")], "request_id string, name string")
    index = build_text_index(entity_documents(g))
    for out in (N.suggest_names(g, asked), N.suggest_names(g, asked, index=index, grams=G.build_gram_index(g))):
        found = {}
        for r in sorted(out.collect(), key=lambda r: r.rank):
            found.setdefault(r.request_id, []).append(r.suggestion)
        assert found == {"a": found["a"], "b": ["Hg"], "c": ["50%_off"], "e": ["Mercury", "Hg"]}
        assert sorted(found["a"]) == ["Apollo", "Mercury"]


def test_a_name_is_suggested_once(spark):
    g = graph(spark, [(str(i), "Same", "t", "word " * (i + 1)) for i in range(4)])
    asked = spark.createDataFrame([("a", "word")], "request_id string, name string")
    assert rows(N.suggest_names(g, asked, 3), "suggestion", "rank") == [("Same", 1)]


def test_texts_with_substrings_that_many_ask_for(spark, monkeypatch):
    """Numbered names share their substrings: no pairs of a name with all others are made, and the answer stays."""
    g = graph(spark, [(f"s{n}", f"Supplier#{n:04d}", "supplier", "Élan of no. 7" if n % 2 else "") for n in range(40)] + [("x", "fluplier#0007y", "thing"), ("z", "er", "t")])
    wants = [(f"plier#{n:04d}",) for n in range(50)] + [("ÉLAN",), ("Supplier#0007",), ("r#",), ("none such",), ("%",)]
    wanted = spark.createDataFrame(wants, "want string")
    index = G.build_gram_index(g)
    plain = rows(G.containing(index, wanted), "want", "id")
    whole, inner = [], G._met_whole
    monkeypatch.setattr(G, "GRAM_PAIRS", 20)
    monkeypatch.setattr(G, "_met_whole", lambda i, broad, f: whole.append(broad.count()) or inner(i, broad, f))
    assert rows(G.containing(index, wanted), "want", "id") == plain
    texts = {r.id: [r.name, r.description, r.entity_type] for r in g.entities.collect()}
    want = sorted((w, i) for (w,) in wants for i, held in texts.items() if any(w.lower() in t.lower() for t in held))
    assert plain == want and whole and whole[0] > 0
