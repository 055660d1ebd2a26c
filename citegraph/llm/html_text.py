"""Operator 4: main text of web pages.

A page is cut into flat text blocks at its block tags.  A block is described by its words and link density,
those of the blocks before and after it, and what encloses it; a decision tree, trained on the small
labelled table `LABELLED`, says whether it belongs to the main text.  The tree is fitted once on the driver (it
has a few nodes) and pages are worked on one by one where they lie.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import map_batches, short_batches

#: elements whose content is never text of the page
_SKIPPED = "script|style|template|noscript|textarea|svg|math|iframe|object|select|datalist|canvas|audio|video|title"
#: those of them that are raw text: without an end tag they run to the end of the page
_RAW = frozenset("script style textarea title".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<skip>" + _SKIPPED + r")(?=[\s/>])(?P<skipped>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_SKIP_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _SKIPPED.split("|")}
#: an attribute's value without quotes at the end of a tag: a slash in it does not close the element
_UNQUOTED = re.compile(r"=\s*[^\s\"']+\Z")
_CLASS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: tags inside a line of text: they do not end a block
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: elements that are tracked because of what they enclose
TRACKED = frozenset("article main nav header footer aside form section div ul ol table dialog menu head button fieldset details figure blockquote body".split())
#: enclosing elements that hold no main text
OUTSIDE = frozenset("nav footer aside form dialog menu head button fieldset".split())
#: words of a class, id or role that mark an enclosing element as no main text ...
MARKED = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs crumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notification warning popup modal overlay dialog comment comments disqus respond reply replies "
    "discussion recommended recommendations sharing subscribe newsletter signup login pagination pager widget copyright disclaimer contentinfo complementary hidden".split()
)
#: ... those that do so only alone or beside other marking words and `FRAME` (``legal-advice`` or ``social-policy`` names a topic) ...
WEAK = frozenset("side header notice alert related more share social follow search form legal skip".split())
FRAME = frozenset("bar box link links list block container wrapper wrap button buttons icon icons area section panel inner outer top bottom page site main global column col media us to for".split())
#: ... those that an inner article keeps (an inner main element is the page's text whatever encloses it) ...
KEPT = frozenset(
    "ad ads advert adverts advertisement adbox sponsor sponsored promo promotion sidebar side nav navbar navigation menu footer comment comments disqus respond reply replies "
    "discussion related recommended recommendations popup modal overlay dialog widget complementary hidden".split()
)
#: ... and first words of a name that tells of the layout around (``has-sidebar``), not of the element
LAYOUT = frozenset("has no not with without".split())
REPLIES = frozenset("comment comments disqus respond reply replies".split())
#: words of a class, id or role that mark an enclosing element as main text
MAIN = frozenset("article post entry story content main body".split())
#: what only a page has: a form around it is no form of the page
PAGE_PARTS = frozenset("article main nav footer h1".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEAD_TAGS = frozenset("meta link base script style title noscript template html head".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "in_outside", "in_marked", "heading", "in_list")


# ------------------------------------------------------------------ blocks
#: an element that is not shown
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|\Z)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")


def is_hidden(attrs: str) -> bool:
    m = _HIDDEN.search(attrs)
    # a value that only mentions the word (title="a hidden place") hides nothing
    return bool(m) and (m[0].strip().lower().startswith(("aria", "style")) or bool(_HIDDEN.search(_VALUE.sub('""', attrs))))


def marks_of(attrs: str) -> set[str]:
    """The words of an element's class, id or role that mark it as no main text."""
    marks, names = set(), set()
    for x in _CLASS.findall(attrs):
        for name in "".join(x).split():
            words = [w.lower() for w in _PART.findall(name)]
            if words and words[0] in LAYOUT:
                continue
            names.update(words)
            marks.update(w for w in words if w in MARKED)
            if all(w in MARKED or w in WEAK or w in FRAME for w in words):
                marks.update(w for w in words if w in WEAK)
    return set() if names & MAIN and not names & {"comment", "comments", "sidebar", "ad", "ads", "related", "footer", "nav"} else marks


class Elements:
    """The tracked elements of a page in order of their start tags.  What an element encloses is decided when the page
    has been read: a form turns out to be a wrapper only behind its start."""

    def __init__(self):
        self.tag, self.parent, self.main, self.outside, self.marks, self.hidden, self.labelled = [], [], [], [], [], [], []
        self.open_forms: list[int] = []

    def start(self, tag: str, attrs: str, parent: int) -> int:
        inside = parent >= 0 and self.main[parent]
        marks = set() if tag in ("body", "article", "main") else marks_of(attrs)
        if tag == "article":
            names = [w for x in _CLASS.findall(attrs) for w in "".join(x).lower().split()]
            if not any(w in ("post", "entry", "story", "hentry") for w in names):
                marks = {"comment"} if any(w in REPLIES or w.split("-")[0] in REPLIES for w in names) else set()
        self.tag.append(tag)
        self.parent.append(parent)
        self.main.append(inside or tag in ("article", "main"))
        self.outside.append(tag in OUTSIDE or tag == "header" and not inside)
        self.marks.append(marks)
        self.hidden.append(tag != "body" and is_hidden(attrs))
        self.labelled.append("data-main" in attrs)
        if tag == "form":
            self.open_forms.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def page_part(self):
        """A part that only pages have begins: the open forms are around the page."""
        for i in self.open_forms:
            self.outside[i] = False
        self.open_forms = []

    def end(self, element: int):
        if self.open_forms and self.tag[element] == "form" and element in self.open_forms:
            self.open_forms.remove(element)

    def enclosed(self) -> list[tuple]:
        """Per element (main, outside, marked, in a list, hidden, labelled), what encloses it counted in; the last entry, for no
        element, is all False."""
        out = []
        kept = []  # whether marks that an article does not lift enclose the element
        for i, tag in enumerate(self.tag):
            p = self.parent[i]
            _, outside, marked, listed, hidden, labelled = out[p] if p >= 0 else (False,) * 6
            firm = p >= 0 and kept[p]
            if tag == "main":
                outside = marked = firm = False
            elif tag == "article" and not firm:
                marked = False
            outside, marked = outside or self.outside[i], marked or bool(self.marks[i])
            kept.append(firm or bool(self.marks[i] & KEPT))
            out.append((self.main[i], outside, marked, listed or tag in ("ul", "ol", "menu"), hidden or self.hidden[i], labelled or self.labelled[i]))
        return [*out, (False,) * 6]


def blocks_of(page: str) -> tuple[list[str], np.ndarray, list[bool]]:
    """(texts, feature matrix, labels) of a page's non-empty blocks that are shown, in order.  Labels come from
    ``data-main`` attributes and matter only for the labelled table."""
    found: list[tuple] = []  # text, words, share of linked words, in a heading, element
    elements = Elements()
    stack: list[int] = []
    pieces: list[str] = []
    words_linked = 0
    in_link = hide = False
    heading = None

    def close_block():
        nonlocal words_linked
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text and not hide:
            n = text.count(" ") + 1
            found.append((text, n, min(1.0, words_linked / n), heading is not None, stack[-1] if stack else -1))
        words_linked = 0

    def add(text: str):
        nonlocal words_linked
        pieces.append(text)
        if in_link:
            words_linked += len(text.split())

    at = 0
    unclosed: set[str] = set()  # skipped elements that have no end tag from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["skip"]:
                skip, attrs = m["skip"].lower(), m["skipped"]
                empty = skip in ("svg", "math") and attrs.endswith("/") and not _UNQUOTED.search(attrs)
                if not empty and skip not in unclosed:
                    if stop := _SKIP_END[skip].search(page, at):
                        at = stop.end()
                    elif skip in _RAW:
                        at = len(page)
                    else:
                        unclosed.add(skip)
                if skip not in ("svg", "math", "title"):
                    pieces.append(" ")
            continue
        end, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag == "a":
            in_link = not end
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        if stack and elements.tag[stack[-1]] == "head" and tag not in _HEAD_TAGS:
            close_block()
            stack.pop()
        close_block()
        hide = not end and tag not in TRACKED and tag not in ("html", "body") and is_hidden(attrs)
        if tag in HEADINGS:
            heading = None if end else tag
        if tag in PAGE_PARTS and not end:
            elements.page_part()
        if tag not in TRACKED:
            continue
        in_link = False
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if elements.tag[stack[i]] == tag:
                    elements.end(stack[i])
                    del stack[i:]
                    break
        elif not attrs.rstrip().endswith("/"):
            stack.append(elements.start(tag, attrs, stack[-1] if stack else -1))
    if at < len(page):
        add(page[at:])
    close_block()
    around = elements.enclosed()
    found = [x for x in found if not around[x[4]][4]]
    texts, labels = [x[0] for x in found], [around[x[4]][5] for x in found]
    if not found:
        return texts, np.zeros((0, len(FEATURES))), labels
    has_main = any(t in ("article", "main") for t in elements.tag)
    own = np.array([(n, links, *around[e][:3], head, around[e][3]) for _, n, links, head, e in found], float)
    size = np.pad(own[:, :2], ((1, 1), (0, 0)))
    place = np.where(own[:, 2] > 0, 1, -1 if has_main else 0)  # inside, outside of, or without an article or main element
    return texts, np.column_stack((own[:, :2], size[:-2], size[2:], place, own[:, 3:])), labels


# ------------------------------------------------------------------ decision tree
def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A binary tree by Gini impurity: ``(share of true,)`` at a leaf, else ``(feature, limit, low, high)``;
    equal gains go to the first feature and the smallest limit."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order].astype(float)
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(cut):
            left = np.cumsum(t)[cut - 1]
            p, q = left / cut, (t.sum() - left) / (len(t) - cut)
            gini = cut * p * (1 - p) + (len(t) - cut) * q * (1 - q)
            i = int(gini.argmin())
            if best is None or gini[i] < best[0] - 1e-12:
                best = (gini[i], f, (v[cut[i]] + v[cut[i] - 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,)
    _, f, limit = best
    low = x[:, f] < limit
    return (f, float(limit), fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1))


def tree_says(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Whether more than half of a leaf's training rows were true, for each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] > 0.5)
    f, limit, low, high = tree
    return np.where(x[:, f] < limit, tree_says(low, x), tree_says(high, x))


_LONG = "The river had risen over night and the lower fields stood under water, so that the carts had to take the road along the hill. "
_SHORT = "Nobody knew when it would fall again."
#: What stands in the main element of the labelled pages ...
_BODIES = (
    f"<h1>The river</h1><p><b>{_LONG}</b><br><p>{_SHORT}</p><p>{_LONG * 2}</p>",
    f"<p>{_LONG * 4}</p><p>Yes.</p><ul><li>One cart</li><li>{_SHORT}</li></ul><p>{_LONG}<a href='/c'>carts</a></p>",
    f"<h2>Carts</h2><p>{_SHORT}</p><p><a href='/d'>Two carts</a></p><p>{_LONG}</p>",
    "<p>Short.</p>",
    f"<p>Yes.</p><p>{_SHORT}</p><p>No.</p>",
    f"{_LONG * 2}<br><br>{_SHORT}",
)
#: ... and around it: `@` stands for the main element, whose blocks are the main text
_PAGES = (
    f"<head><title>River</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>{_SHORT}</div><article @</article><footer>&copy; river.example {_SHORT}</footer></body>",
    f"<header><h1>Daily paper</h1><p>{_SHORT}</p></header><div class='cookie-notice'>{_LONG * 2}</div><aside class='sidebar'><p>{_LONG * 4}</p></aside><article><div @</div>"
    f"<div class='related'><a href='/x'>{_SHORT}</a></div><form><p>{_LONG}</p><button>Send</button></form><section class='comments'><h2>Comments</h2><p>{_LONG * 2}</p><p>Yes.</p></section></article><p>{_SHORT}</p><footer>{_LONG * 4}</footer>",
    f"<nav><a href='/'>Start</a></nav><main @</main><aside>{_LONG}</aside><div><p>{_LONG * 4}</p><p>Yes.</p></div>",
    f"<div><p>{_LONG * 2}</p><h2>Paper</h2></div><article><div class='advert'>{_LONG * 3}</div><section @</section><div class='ad'>Buy now</div><section @</section></article><section id='comments'><p>{_LONG * 4}</p><p>{_SHORT}</p></section><footer><p>{_LONG * 2}</p></footer>",
    f"<header><p>{_LONG * 2}</p></header><nav>{_LONG * 2}</nav><main><aside>Buy</aside><div @</div><aside><p>{_LONG * 4}</p></aside><form><p>{_LONG * 2}</p></form></main><p>{_SHORT}</p>",
)
#: pages without an article or main element
_PLAIN = (
    f"<div id='menu'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='post-content' @</div><div class='share'><a href='/s'>Share</a></div><div id='comments'><p>{_LONG * 2}</p></div><div id='footer'>{_SHORT}</div>",
    f"<div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/o'>Older</a></div><div @</div><div><a href='/p'>Privacy</a></div><div class='sidebar'>{_LONG * 4}</div>",
    f"<ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul><div class='notice'>{_LONG * 2}</div><div @</div><div class='newsletter'><p>{_LONG}</p></div><footer>{_LONG * 2}</footer><form>{_LONG * 4}</form>",
    "<body @</body>",
    f"<div @</div><ul><li><a href='/q'>Next page of the river news</a></li><li><a href='/r'>Back</a></li></ul><div class='comment-list'>{_LONG * 4}</div>",
)
#: The labelled table: pages whose main text lies in elements with a ``data-main`` attribute.
LABELLED = tuple(page.replace("@", "data-main>" + body) for page in (*_PAGES, *_PLAIN) for body in _BODIES)


def labelled_tree() -> tuple:
    x, y = zip(*((f, np.array(lab, bool)) for _, f, lab in map(blocks_of, LABELLED)))
    return fit_tree(np.vstack(x), np.concatenate(y))


def main_text(page: str | None, tree: tuple) -> str:
    """The main blocks of a page, joined by one blank."""
    if not page:
        return ""
    texts, x, _ = blocks_of(page)
    return " ".join(t for t, keep in zip(texts, tree_says(tree, x)) if keep) if texts else ""


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Columns `keep` of `pages` with text and n_chars (its code points), one row per row of `pages`.

    A null or empty page, or one without main text, gives the empty text and 0.  Character references are
    decoded once, white space within a block (no-break spaces too) becomes one blank, and the main blocks are
    joined by one blank in page order; whole pages are read; what is hidden is not text.  Unclosed elements, comments and scripts end with the page.  Repeated
    rows and null ids are pages like others; further columns are not read; an empty table gives no rows.
    """
    short_batches(pages.sparkSession)
    tree = labelled_tree()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py(), tree) for x in b.column(b.num_columns - 1)]
        cols = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "text", "n_chars"])

    cols = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1]]
    return map_batches(cols, run, ", ".join([*kinds, "text string", "n_chars long"]))
