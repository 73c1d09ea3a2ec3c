"""Bundles written and read back."""

import hashlib

from knotwork.llm import warc
from knotwork.session import scratch_path

LONG = "<p>" + "é" * 60 + "</p>"


def want(rows):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(data) if first.get(data) != i and sum((x or "").encode() == data for _, _, x in rows) > 1 else None
        out.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", -1 if refers is None else refers))
    return sorted(out)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    rows = [(i, f"http://x/{i}", f"{LONG} {i % 30}") for i in range(200)]
    rows += [(300, None, None), (301, "u\r\nX: y", ""), (302, "u", "short"), (303, "u", "short"), (304, "u", "a\r\n\r\nWARC/1.1\r\n" * 30)]
    rows += [(None, "u", f"{LONG} 3"), (305, "u", "dup" * 50), (305, "u", "dup" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc-test")
    index = warc.write_bundles(pages.repartition(3), folder)
    got = warc.read_bundles(index, folder)
    table = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got.collect()]
    assert sorted(table) == want(rows)
    stored = {r.page_id: r.payload.decode() for r in got.filter("record_type = 'response'").collect()}
    assert all(stored[i] == (h or "") for i, _, h in rows if i in stored)
    some = spark.createDataFrame([(5,), (304,), (9999,)], "page_id long")
    assert {r.page_id: r.payload.decode() for r in warc.lookup(index, folder, some).collect()} == {5: rows[5][2], 304: rows[204][2]}
    assert index.select("bundle").distinct().count() > 3


def test_text_ids_and_a_long_page(spark, monkeypatch):
    """Ids with line breaks, blanks and signs come back; a payload may be larger than a frame and a bundle."""
    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    ids = ["a\r\nb", " c ", "é%41: x", "", "\n", None]
    rows = [(i, "u", f"{LONG} {n}") for n, i in enumerate(ids)] + [("z\n", "u", f"{LONG} 0"), ("long", "u", "".join(map(str, range(20_000))))]
    folder = scratch_path(spark, "warc-test")
    index = warc.write_bundles(spark.createDataFrame(rows, "page_id string, url string, html string"), folder)
    got = warc.read_bundles(index, folder).collect()
    assert sorted((r.page_id or "-", r.payload_bytes) for r in got) == sorted((i or "-", len(h.encode())) for i, _, h in rows)
    assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [("z\n", "a\r\nb")]
    some = spark.createDataFrame([("long",), ("a\r\nb",)], "page_id string")
    assert {r.page_id: r.payload.decode() for r in warc.lookup(index, folder, some).collect()} == {"long": rows[-1][2], "a\r\nb": rows[0][2]}


def test_seek_table():
    bundle = warc.Bundle()
    for i in range(10):
        bundle.add(i, str(i), bytes([i]) * 100_000)
    data, rows = bundle.finish()
    frames = warc.read_seek_table(data)
    assert len(frames) == 4 and sum(f[2] for f in frames) == 1_000_000 and len(rows) == 10
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    assert len(reader.read()) == 1_000_000  # a plain reader skips the table


def test_empty(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_bundles(index, folder).count() == 0
