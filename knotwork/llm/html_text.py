"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm.common import table, untaken

#: Width of the smoothing kernel in blocks, and the share of the threshold that a block must reach by itself.
SIGMA, OWN = 1.5, 0.1
#: Shares of the selected text that article and main elements, and that any other element, must hold to be the
#: region; share of the first article's ratio of text to tags that another one, and share of selected text that
#: what is around another element must have, to join.
PRIOR, REGION_SHARE, ALIKE = 0.5, 0.8, 0.5

# Elements of HTML by their role here.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set(
    "script style noscript template head title iframe object svg math canvas audio video map "
    "form button select option textarea input label fieldset datalist dialog nav aside footer menu".split()
)
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|sidebar|sidenav|widgets?|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|"
    r"commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommended|newsletter|subscribe|"
    r"subscription|login|signup|search|toolbar|pagination|pager)(?:$|[\s_-])",
    re.IGNORECASE,
)


class Page(HTMLParser):
    """Collects blocks of text, each with the element that holds it and the tags seen since the last one."""

    def __init__(self, forms: bool = False):
        super().__init__(convert_charrefs=True)
        self.forms = forms  # whether text in forms is read
        self.in_forms = self.seen = 0  # characters hidden by nothing but forms, and read
        self.form_depth = 0
        self.stack: list[tuple[str, bool, int]] = []  # tag, starts a hidden part, container
        self.hidden = 0
        self.parents = [-1]
        self.tags_of = ["html"]
        self.depth = [0]
        self.blocks: list[tuple[str, int, int]] = []  # text, container, tags
        self.parts: list[str] = []
        self.tags = 0

    def container(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((text, self.container(), self.tags))
            self.tags = 0

    def is_hidden(self, tag, attrs) -> bool:
        if tag in HIDDEN:
            return tag != "form" or not self.forms
        inside = any(t in ("article", "main") for t, _, _ in self.stack)
        if tag == "header":
            return not inside  # the head of an article holds its title, whatever its class
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id") and MARKED.search(value):
                return True
            if name == "role" and value.lower() in ROLES:
                return True
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def close_to(self, at: int):
        while len(self.stack) > at:
            if self.stack[-1][0] in BLOCKS:
                self.flush()
            tag, hide, _ = self.stack.pop()
            self.hidden -= hide
            self.form_depth -= hide and tag == "form"

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and not self.hidden:
                self.parts.append(" ")
            return
        if tag in CLOSES_P:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == "p":
                    self.close_to(at)
                    break
                if self.stack[at][0] in BLOCKS:
                    break
        if tag in BLOCKS:
            self.flush()
        hide = self.is_hidden(tag, attrs)
        at = self.container()
        if tag in BLOCKS and tag != "p":
            self.parents.append(at)
            self.tags_of.append(tag)
            self.depth.append(self.depth[at] + 1)
            at = len(self.parents) - 1
        self.stack.append((tag, hide, at))
        self.hidden += hide
        self.form_depth += hide and tag == "form"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "span", "b", "i", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.close_to(at)
                return
            if self.stack[at][0] in ("article", "main", "td", "th") and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            self.seen += len(data.strip())
        elif self.hidden == self.form_depth:
            self.in_forms += len(data.strip())


def _threshold(values: np.ndarray) -> float:
    """Two means in one dimension; the middle between them."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values <= cut], values[values > cut]
        if not len(under) or not len(over):
            return cut if len(over) else -1.0
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _selected(page: Page) -> np.ndarray:
    """Which blocks the smoothed ratios of text to tags select; a heading goes with the block after it."""
    ratio = np.array([len(text) / max(tags, 1) for text, _, tags in page.blocks])
    reach = math.ceil(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, mode="full")[reach : reach + len(ratio)]
    smooth = np.convolve(ratio, kernel, mode="full")[reach : reach + len(ratio)] / weight
    threshold = _threshold(smooth)
    selected = (smooth > threshold) & (ratio >= OWN * threshold)
    if not selected.any():
        selected[:] = True
    for i in range(len(selected) - 2, -1, -1):
        if page.tags_of[page.blocks[i][1]] in HEADINGS:
            selected[i] |= selected[i + 1]
    return selected


def _regions(page: Page, selected: np.ndarray) -> list[int]:
    """The elements that are taken whole.

    Articles and main elements are the region where they hold most of the selected text: that with most of it, the
    innermost of equals, and those beside it with a comparable ratio of text to tags. Else it is the innermost element with
    nearly all selected text, widened as long as what an outer element adds, a short section or a title, is mostly
    selected.
    """
    chosen, whole, tags = np.zeros((3, len(page.parents)))
    for (text, at, before), yes in zip(page.blocks, selected, strict=True):
        whole[at] += len(text)
        tags[at] += max(before, 1)
        chosen[at] += len(text) * bool(yes)
    for at in range(len(page.parents) - 1, 0, -1):  # a child comes after its parent
        chosen[page.parents[at]] += chosen[at]
        whole[page.parents[at]] += whole[at]
        tags[page.parents[at]] += tags[at]

    def above(at: int):
        while at >= 0:
            yield at
            at = page.parents[at]

    marked = [i for i, tag in enumerate(page.tags_of) if tag in ("article", "main") and whole[i]]
    marked.sort(key=lambda i: (chosen[i], whole[i], page.depth[i]), reverse=True)
    taken: list[int] = []
    around: set[int] = set()
    for i in marked:
        alike = not taken or whole[i] / tags[i] >= ALIKE * whole[taken[0]] / tags[taken[0]]
        if alike and i not in around and not any(a in taken for a in above(i)):
            taken.append(i)
            around.update(above(i))
    if taken and sum(chosen[i] for i in taken) >= PRIOR * chosen[0]:
        return taken
    region = max((i for i in range(len(chosen)) if chosen[i] >= REGION_SHARE * chosen[0]), key=lambda i: (page.depth[i], -i))
    while page.parents[region] > 0 and page.tags_of[region] not in ("div", "section", "td", "body"):
        region = page.parents[region]
    for at in above(region):
        more = chosen[at] - chosen[region]
        if more and more >= ALIKE * (whole[at] - whole[region]):
            region = at
    return [region]


def main_text(html: str | None) -> tuple[str, int, int]:
    """The text, the blocks in it and the blocks that the ratios selected."""
    for forms in (False, True):
        page = Page(forms)
        page.feed(html or "")
        page.close()
        page.flush()
        if page.in_forms <= page.seen:
            break
    if not page.blocks:
        return "", 0, 0
    selected = _selected(page)
    inside = np.zeros(len(page.parents), dtype=bool)
    inside[_regions(page, selected)] = True
    for at in range(1, len(page.parents)):
        inside[at] |= inside[page.parents[at]]
    kept = [text for text, at, _ in page.blocks if inside[at]]
    return "\n".join(kept), len(kept), int(selected.sum())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id, carried columns, text, n_chars (code points), n_blocks, n_selected.

    Parts that are never article text (menus, forms, scripts, comments of readers and the like, by
    element, role or class name) are left out while the events stream by; forms that hold more text than the
    rest of the page are read. The ratio of text to tags of each block, smoothed and split by two means, says where
    the content is and so which elements are the region (``_regions``), which is taken whole.
    Null or empty pages give an empty text, an empty table no rows; repeated rows give repeated rows; a long page is
    read whole, in one task; other columns are dropped. Where the id or a carried column has the name of a result
    column, the result column gets an underscore at its end.
    """
    fields = [id_col, *carry]
    results = untaken(["text", "n_chars", "n_blocks", "n_selected"], fields)
    kinds = [pages.schema[c].dataType.simpleString() for c in fields] + ["string", "long", "int", "int"]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in zip([*fields, *results], kinds, strict=True))

    def run(batches):
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            for lo in range(0, len(html), 256):
                found = [main_text(x.as_py()) for x in html.slice(lo, 256)]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, 256) for c in batch.columns[:-1]]
                    + [
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([len(f[0]) for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.int32()),
                        pa.array([f[2] for f in found], pa.int32()),
                    ],
                    names=[*fields, *results],
                )

    return pages.select(*fields, pages[html_col].cast("string").alias("_html")).mapInArrow(run, schema)


def op10(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
