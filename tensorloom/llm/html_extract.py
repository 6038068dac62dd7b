"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a flat run of text blocks, split at block-level tags. Each
block has its word count, its link density, the same of its two neighbours, the
length of the page's longest plain block, and
marks of where it stands (containers and the words of their class and id). A
decision tree (CART, Gini) classifies blocks as main text or not; it is trained
here on the small labelled table below, once for each process.

Whole pages are read; nothing is capped. Map-only: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import batches, pick, whole_texts

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style".split())
_RAW_ENDS = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in RAW_TAGS}
SILENT_TAGS = frozenset("head title noscript template svg math object iframe noframes noembed canvas audio video select datalist option textarea button".split())
#: Boilerplate by the words of class, id and role.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "edge": "header masthead banner footer foot topbar bottombar copyright colophon",
    "side": "sidebar aside side rail widget widgets related recommended trending popular",
    "notice": "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login alert paywall disclaimer",
    "advert": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted banner",
    "comment": "comment comments commentlist reply replies respond disqus discussion",
    "tools": "share sharing social meta byline tags tools toolbar skip search form print complementary contentinfo",
}
#: Words that may stand beside a boilerplate word without changing what it says.
_PLAIN = frozenset("box wrap wrapper container content section block area list inner outer main top bottom left right posts post links link item items body text".split())
_HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
# Attributes by state: a quote opens a value right after "=" only; a value whose quote never closes ends like an unquoted one.
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^=>]++|=\s*+(?:{_VALUE}))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s=/>]++)(?:\s*+=\s*+({_VALUE}))?+")
_CLOSES_ITSELF = re.compile(r"(?:^|[\s\"'/]|^[^=]*)/\Z")
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "longest", "outside", "article", "heading", "nav", "header", "footer", "aside", "form", "hint")
#: Features that come from where a block stands; the others are counted over the flat run of blocks.
PLACES = FEATURES[8:]
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_MARK_OF = {"article": 0, "main": 0, **dict.fromkeys(_HEADINGS, 1), "nav": 2, "menu": 2, "header": 3, "footer": 4, "aside": 5, "form": 6, "dialog": 6}
#: Tags that end an open tag of their kind, up to the nearest container.
_IMPLIED = frozenset("p li option dt dd tr td th a".split())
_CONTAINERS = frozenset("ul ol dl table div section article main aside nav header footer form td blockquote".split())


@dataclass
class Block:
    """A stretch of text between block-level tags, and where it stands."""

    text: str
    words: int
    link_words: int
    place: tuple[int, ...]
    label: int = -1


def _hint(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role mention boilerplate, whether one of their names says nothing else, and whether the element is hidden."""
    hinted = pure = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or ""
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", token))]
                marked = [w for w in words if w in _HINT_OF]
                hinted |= bool(marked)
                pure |= bool(marked) and not {"left", "right"} & set(words) and all(w in _HINT_OF or w in _PLAIN for w in words)
    return hinted, pure, hidden


@dataclass(slots=True)
class _Open:
    """An open element with running counts over the stack up to it, so that nothing walks the stack."""

    name: str
    #: Elements of each mark of :data:`PLACES` but the last.
    marks: tuple[int, ...]
    #: Names that mention boilerplate since the innermost article, and names that say nothing else.
    loose: int
    pure: int
    silent: int
    links: int
    #: How many of each of :data:`_IMPLIED` are open since the nearest container.
    scope: dict[str, int | str]
    #: An inline element that is a block of its own, as its name says that it is boilerplate.
    apart: bool


_BOTTOM = _Open("", (0,) * (len(PLACES) - 1), 0, 0, 0, 0, {}, False)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. Unclosed, misnested and cut-off tags are tolerated; hidden elements have no text."""
    out: list[Block] = []
    stack: list[_Open] = []
    open_names: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    at, raw_end = 0, None

    def close_block() -> None:
        if not pieces:
            return
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            top = stack[-1] if stack else _BOTTOM
            # Inside an article every mention counts; around it only names that say nothing else, as
            # layouts carry names like "with-sidebar".
            place = (*(int(x > 0) for x in top.marks), int(top.loose + top.pure > 0))
            n = len(text.split())
            out.append(Block(text, n, min(n, len(html.unescape("".join(linked)).split())), place))
        pieces.clear()
        linked.clear()

    def add(text: str) -> None:
        top = stack[-1] if stack else _BOTTOM
        if not top.silent:
            pieces.append(text)
            if top.links:
                linked.append(text)

    def push(name: str, loose: bool, pure: bool, hidden: bool) -> None:
        top = stack[-1] if stack else _BOTTOM
        mark, inner = _MARK_OF.get(name), name in ("article", "main")
        if name in ("html", "body"):
            loose = pure = False
        apart = pure and name not in BLOCK_TAGS and not hidden
        if apart:
            close_block()
        marks = top.marks if mark is None else (*top.marks[:mark], top.marks[mark] + 1, *top.marks[mark + 1 :])
        # A scope knows its container, as a cell ends a cell.
        scope = {"": name} if name in _CONTAINERS else top.scope if stack else bottom
        if name in _IMPLIED:
            outer = top.scope if stack else bottom
            outer[name] = outer.get(name, 0) + 1
        stack.append(_Open(name, marks, int(loose) + (0 if inner else top.loose), top.pure + pure, top.silent + (hidden or name in SILENT_TAGS), top.links + (name == "a"), scope, apart))
        open_names[name] += 1

    def pop() -> str:
        gone = stack[-1]
        if gone.apart:
            close_block()
        if gone.name == "a":
            # Links that stand side by side are words of their own.
            linked.append(" ")
        stack.pop()
        open_names[gone.name] -= 1
        if gone.name in _IMPLIED:
            outer = stack[-1].scope if stack else bottom
            outer[gone.name] -= 1
        return gone.name

    bottom: dict[str, int | str] = {}
    while at < len(page):
        if raw_end is not None:
            m = _RAW_ENDS[raw_end].search(page, at)
            at, raw_end = (m.end() if m else len(page)), None
            continue
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            add(" ")
            continue
        if name in BLOCK_TAGS:
            close_block()
        if closing:
            if open_names[name]:
                # Closing a container closes what was left open in it.
                while pop() != name:
                    pass
            continue
        if name in RAW_TAGS:
            raw_end = name
            continue
        if name in VOID_TAGS or name not in BLOCK_TAGS and _CLOSES_ITSELF.search(m[3]):
            continue
        if name in _IMPLIED:
            scope = stack[-1].scope if stack else bottom
            if scope.get(name) or scope.get("") == name:
                while pop() != name:
                    pass
        elif name == "body":
            # A head that was left open ends here.
            while stack:
                pop()
        push(name, *_hint(m[3]))
    close_block()
    return out


def table(found: list[Block]) -> np.ndarray:
    """A row of :data:`FEATURES` for each block; missing neighbours count as empty."""
    own = np.array([(b.words, b.link_words / max(1, b.words)) for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.vstack([none, own[:-1]])[: len(own)], np.vstack([own[1:], none])[: len(own)]
    places = np.array([b.place for b in found], float).reshape(len(own), len(PLACES))
    # The longest block of plain text says what is long on this page; where an article is marked, all else stands outside.
    plain = own[:, 0] * (own[:, 1] < 1 / 3)
    longest = np.full((len(own), 1), plain.max(initial=0))
    outside = (places[:, :1].any() & (places[:, :1] == 0)).astype(float)
    return np.hstack([own, before, after, longest, outside, places])


# The labelled table: small pages as (label, markup), + for main text and - for the rest. W<n> stands
# for about n words and W* for any number of them; each page is drawn DRAWS times.
DRAWS = 25
_MENU = "<ul>" + "<li><a>W2</a></li>" * 5 + "</ul>"
_ARTICLE = "<h1>W*</h1><p>W*</p><p>W*</p><p>W*</p>"
LABELLED = (
    # landmarks decide, whatever the length
    [("-", f"<nav>{_MENU}</nav>"), ("-", '<div class="ad">W*</div>'), ("+", f"<article>{_ARTICLE}<h2>W4</h2><p>W*</p></article>"), ("-", "<footer>W*</footer>")],
    [("-", "<header><h1>W3</h1><p>W*</p></header>"), ("+", f"<article>{_ARTICLE}<ul><li>W4</li><li>W7</li></ul></article>"), ("-", "<aside><h3>W2</h3><p>W*</p></aside>"), ("-", "<footer><p>W*</p><p>W*</p></footer>")],
    [("-", '<div class="menu"><a>W2</a> <a>W1</a></div>'), ("+", f"<main>{_ARTICLE}<blockquote>W*</blockquote><p>W3 <a>W9</a></p></main>"), ("-", '<div id="comments"><p>W*</p><p>W*</p></div>')],
    [("-", f"<nav>{_MENU}</nav>"), ("-", '<div class="cookie-notice">W*</div>'), ("+", "<article><h1>W*</h1><p>W1</p></article>"), ("-", "<aside>W*</aside>")],
    # an article and what is inside it but does not belong to it
    [("+", "<article><h1>W*</h1><p>W*</p></article>"), ("-", '<article><div class="ad">W*</div></article>'), ("+", "<article><p>W*</p></article>"), ("-", "<article><aside>W*</aside></article>"), ("-", "<article><form>W*</form></article>"), ("-", "<article><footer>W*</footer></article>")],
    [("+", "<article><p>W*</p></article>"), ("-", '<article><div class="share"><a>W1</a> <a>W1</a></div></article>'), ("-", "<article><nav><a>W4</a></nav></article>"), ("-", "<article><header>W*</header></article>"), ("-", '<article><div class="comment">W*</div></article>')],
    [("+", "<main><h1>W*</h1><p>W*</p><p>W*</p></main>"), ("-", '<main><section id="comments"><h3>W2</h3><p>W*</p><p>W*</p></section></main>'), ("-", '<main><div class="related"><ul><li><a>W6</a></li><li><a>W7</a></li></ul></div></main>')],
    # pages that end inside the text, that are nothing but text, and text full of links
    [("-", f"<nav>{_MENU}</nav>"), ("+", f"<article>{_ARTICLE}</article>")],
    [("+", "<article>W*</article>")],
    [("+", "<article><p>W* <a>W*</a></p><p><a>W*</a> W*</p><p>W* <a>W*</a> W*</p><p><a>W5</a></p><p>W*</p></article>"), ("-", "<footer>W*</footer>")],
    [("+", "<main><p>W*</p><p><a>W*</a> W*</p><p><a>W*</a></p><p>W* <a>W*</a></p></main>")],
    [("-", "<div>W*</div>"), ("+", "<article><h1>W5</h1><p>W*</p></article>"), ("-", "<p>W*</p><div><a>W*</a></div>")],
    [("+", "W60")],
    [("+", "<p>W40</p><p>W25 <a>W3</a></p>")],
    # no landmarks: links tell a list from an article of the same lengths
    [("-", "<div><a>W*</a></div>" * 6), ("+", "<h1>W6</h1><p>W*</p><p>W*</p><p>W60</p><p>W*</p><p>W*</p>"), ("-", "<p><a>W*</a></p>" * 5)],
    [("-", "<p><a>W*</a></p>" * 4), ("+", "<p>W*</p><p>W50</p><p>W* <a>W2</a></p><p>W12</p><p>W*</p>"), ("-", "<div><a>W4</a> <a>W3</a> W1</div>" * 3)],
    [("-", "<li><a>W9</a></li>" * 6), ("+", "<p>W9</p>" * 6), ("-", "<li><a>W5</a> W1</li>" * 5)],
    [("-", "<div><a>W*</a> W2</div>" * 5), ("+", "<div>W*</div>" * 5), ("-", "<div>W2 <a>W*</a></div>" * 4)],
    [("+", "<p>W45</p><p>W* <a>W4</a></p><p>W30 <a>W8</a></p><p>W5</p><p>W*</p>"), ("-", "<li><a>W6</a></li>" * 8)],
    # no landmarks and nothing long: what is not a link is the page
    [("+", "<h1>W3</h1><p>W5</p><p>W2</p>")],
    [("+", '<div class="content"><p>W12</p><p>W5</p></div>')],
    [("-", f"<div>{_MENU}</div>"), ("+", "<h1>W4</h1><p>W9</p><p>W14</p><p>W6</p>")],
    [("-", "<div><a>W1</a> <a>W2</a> <a>W1</a></div>"), ("+", "<p>W8</p><p>W3</p><p>W11</p>"), ("-", "<div><a>W2</a> <a>W2</a></div>")],
    [("+", "<h2>W4</h2><div>W7 <a>W1</a></div><div>W10</div>")],
    # no landmarks: length, links and neighbours decide
    [("-", f"<div><a>W1</a> <a>W2</a> <a>W1</a></div>{_MENU}"), ("+", "<h1>W6</h1><div>W55</div><p>W80</p><p>W30</p><p>W25</p>"), ("-", "<div>W4 <a>W3</a></div><div><a>W3</a></div><div>W6</div>")],
    [("-", "<td><a>W2</a></td><td><a>W2</a></td><td>W3</td>"), ("+", "<td>W48</td><td>W33</td><td>W120</td>"), ("-", "<td>W2</td><td><a>W5</a></td><td>W4 <a>W4</a></td>")],
    [("-", "<div>W3</div><div>W2</div>"), ("-", "<div><a>W12</a></div><div><a>W11</a></div>"), ("+", "<div>W65</div><div>W18</div><div>W42</div>"), ("-", "<div>W5</div><div>W3</div><div>W2</div>")],
    # boilerplate by its container, however long its text, without an article element
    [("-", '<div class="cookie-notice">W*</div>'), ("-", '<div id="sidebar"><p>W*</p><p>W*</p></div>'), ("+", '<div class="content"><h2>W5</h2><p>W75</p><p>W24</p><p>W38</p></div>'), ("-", '<div id="comments"><p>W*</p><p>W*</p></div>'), ("-", "<form><p>W*</p></form>"), ("-", "<footer><p>W*</p></footer>")],
    [("-", "<header><p>W*</p></header>"), ("-", "<nav><p>W*</p></nav>"), ("-", "<aside><p>W*</p></aside>"), ("+", "<p>W44</p><p>W28</p><p>W52</p>"), ("-", '<div class="promo">W*</div>')],
    [("-", "<header><h1>W2</h1></header>"), ("+", "<h1>W4</h1><p>W6</p><p>W9</p>"), ("-", "<footer>W5</footer>"), ("-", '<p>W3 <span class="advert">W4</span></p>'.replace("W3 ", ""))],
)


def _fill(markup: str, rng: np.random.Generator) -> str:
    def words(m: re.Match) -> str:
        n = np.exp(rng.uniform(0, np.log(200))) if m[1] == "*" else int(m[1]) * rng.uniform(0.7, 1.4)
        return " ".join(["word"] * max(1, round(n)))

    return re.sub(r"W(\d+|\*)", words, markup)


def training_table() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for page in LABELLED * DRAWS:
        found: list[Block] = []
        for label, markup in page:
            for block in blocks(_fill(markup, rng)):
                block.label = int(label == "+")
                found.append(block)
        rows.append(table(found))
        labels += [b.label for b in found]
    return np.vstack(rows), np.array(labels)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 16, least: int = 8) -> tuple:
    """A CART tree: ``(share,)`` for a leaf, else ``(share, feature, threshold, low, high)``."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            n = low.sum()
            if min(n, len(low) - n) >= least:
                a, b = labels[low].mean(), labels[~low].mean()
                impurity = (n * a * (1 - a) + (len(low) - n) * b * (1 - b)) / len(low)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), low)
    if best is None or best[0] >= share * (1 - share) - 1e-12:
        return (share,)
    _, f, cut, low = best
    return share, f, cut, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least)


@lru_cache(maxsize=1)
def model() -> tuple:
    return grow(*training_table())


def is_main(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree[0] >= 0.5


def extract(page: str | None, tree: tuple | None = None) -> str:
    """Main text of one page, blocks joined by a space; null, empty and text-free pages give ''."""
    found = blocks(page or "")
    if not found:
        return ""
    tree = tree or model()
    return " ".join(b.text for b, row in zip(found, table(found)) if is_main(tree, row))


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null ids and urls stay null; repeated rows each get a row; other columns are
    ignored; an empty table gives an empty result.
    """

    tree = model()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for part in parts:
                for page_id, url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    text = extract(page.as_py(), tree)
                    yield {"page_id": page_id, "url": url, "text": text, "n_chars": len(text)}

        yield from batches(rows(), RESULT, text="text")

    rows = whole_texts(pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.col("html").cast("string")))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
