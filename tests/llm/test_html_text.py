"""Main text of pages written by hand."""

import html as H
import re

from knotwork.llm.html_text import extract_text, main_text

SF = "/root/testdata/sf0.001"


def test_parts_left_out():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="ad">Buy</div><article><header><h1>Title &amp; more</h1></header><p>First   part<br>goes
    on &lt;here&gt;. <b>Bold</b> x</p><aside>Side</aside><p>Short.</p><form>Name <input><button>Go</button></form>
    <ul><li>one</li><li>two</li></ul><p>Unclosed one<p>Another paragraph of the text<div id="comments"><p>Reader says
    something that is very long and would look like content to a ratio</p></div></article>
    <section class="comments"><article>Nice!</article></section><footer>&copy; x</footer></body></html>"""
    text, _, _ = main_text(page)
    assert text == "Title & more\nFirst part goes on <here>. Bold x\nShort.\none\ntwo\nUnclosed one\nAnother paragraph of the text"


def test_no_article():
    long = "words of the story that go on and on for a while " * 5
    page = f"<body><div id=top><a href=x>a</a> <a>b</a></div><div id=c><p>{long}</p><p>ok</p><p>{long}</p></div><div><a>z</a></div></body>"
    assert main_text(page)[0] == f"{long.strip()}\nok\n{long.strip()}"


LONG = "words of the story that go on and on for a while " * 5


def test_ratios_choose_among_elements():
    """A short teaser in an article element loses to a long story in a div; articles of text are all taken."""
    teaser = "<article><a href=x>Read</a> <a href=y>more</a> <a href=z>here</a></article>"
    story = f"<div class=k><h2>Head</h2><p>{LONG}</p><p>ok</p><p>{LONG}</p></div>"
    assert main_text(f"<body>{teaser}{story}</body>")[0] == f"Head\n{LONG.strip()}\nok\n{LONG.strip()}"
    two = f"<body><article><p>{LONG}1</p></article><div><a>x</a></div><article><p>{LONG}2</p><p>{LONG}3</p></article>{teaser}</body>"
    assert main_text(two)[0] == f"{LONG}1\n{LONG}2\n{LONG}3"


def test_split_sections_and_titles():
    parts = f"<section><p>{LONG * 4}</p><p>{LONG * 2}</p></section><section><p>{LONG}</p></section>"
    want = f"{(LONG * 4).strip()}\n{(LONG * 2).strip()}\n{LONG.strip()}"
    links = "<ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a><li><a>e</a><li><a>f</a></ul>"
    assert main_text(f"<body><div>{parts}</div><div>{links}</div></body>")[0] == want
    titled = f"<body><div><h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></div><div>{links}</div></body>"
    assert main_text(titled)[0] == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    headed = f"<article><header class='entry-header'><h1>Title</h1></header><p>{LONG}</p></article>"
    assert main_text(headed)[0] == f"Title\n{LONG.strip()}"


def test_page_in_one_form():
    form = f"<body><form id=aspnet><nav>Home</nav><div><p>{LONG}</p><p>{LONG}</p></div><select><option>No</select></form><p>x</p></body>"
    assert main_text(form)[0].split("\n")[:2] == [LONG.strip()] * 2
    assert main_text(f"<div><p>{LONG}</p><form>Your name <input></form></div>")[0] == LONG.strip()


def test_odd_input():
    for page in (None, "", " ", "<", "<article>", "<script>var x", "<!-- x", "</p></div>"):
        assert main_text(page)[0] in ("", "<", "<!-- x")
    assert main_text("just text")[0] == "just text"
    assert main_text("<div>" * 3000 + "deep")[0] == "deep"


def test_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>a</p>", "t")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()) == [
        (0, "", "a", 1),
        (1, "u", "", 0),
        (1, "u", "", 0),
    ]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "t", "<p>a</p>"), (2, None, "<p>" + "long " * 400_000)], "N_chars long, text string, html string")
    got = extract_text(clash, id_col="N_chars", carry=("text",)).orderBy("N_chars").collect()
    assert [(r.text, r.text_, r.n_chars_) for r in got] == [("t", "a", 1), (None, ("long " * 400_000).strip(), 1_999_999)]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text.split("\n") == [x for x in parts if x]


def test_pages_without_marks(spark):
    """The ratios alone find the article when its tag and the class names say nothing."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()
    assert len(rows) > 20
    for r in rows:
        plain = re.sub(r'class="[^"]*"', 'class="k7"', re.sub(r"(</?)article", r"\1div", r.html))
        assert main_text(plain)[0] == main_text(r.html)[0]
