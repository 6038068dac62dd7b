"""Kernels of the training-data operators without Spark."""

import html.parser
import random
import re
import time

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tensorloom.llm import html_extract, piece_bpe, quality, simhash
from tensorloom.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.load(tokenizer_file())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


def agree(coder, library, text):
    ids = library.encode(text, num_threads=1)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)
    n, joined, decoded = coder.coded(text)
    assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_runs_of_one_character(coder, library):
    for n in range(0, 80):
        for text in (" " * n, "a" + " " * n + "the", "=" * n, "\n" * n, "0" * n, "ab" * n, "▁" * n + "x"):
            agree(coder, library, text)


def test_random_texts(coder, library):
    rng = random.Random(1)
    alphabet = "aabbcdeeinorst ▁\n\t.,;!?$%{}()=+<>/\\0123éüßñçдж世界😀\x00​ "
    pieces = list(coder.ids)
    for _ in range(3000):
        agree(coder, library, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))))
        agree(coder, library, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(coder, library, text):
    agree(coder, library, text)


def test_long_text_and_full_table(coder, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "TABLE_ENTRIES", 5)
    agree(coder, library, "some words come back again and again, some words do not; " * 300)
    agree(coder, library, "x" * 20_000)


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "a b c a b c a b c a", "É é \x0bx\x0cy", "w " * 300, "no break space"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_across_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    text = " ".join(str(i * i % 97) for i in range(200))
    assert simhash.fingerprint(text) == plain_fingerprint(text) and simhash.fingerprint(text, 5) == plain_fingerprint(text, 5)


def test_masks_cover_every_difference():
    masks = simhash.masks(3)
    assert len(masks) == 15 and all(m.bit_count() == 32 for m in masks)
    rng = random.Random(2)
    for _ in range(20_000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
        assert any(not difference & m for m in masks)


ARTICLE = "<h1>Title</h1><p>Short.</p><p>Some <a href=x>linked text</a> here&nbsp;and&#x41; there&hellip;</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title></head><body></body></html>", ""),
        (f"<body><nav><a>Home</a></nav><article>{ARTICLE}</article><footer>&copy; 2020 by all of us here</footer>", "Title Short. Some linked text here andA there…"),
        (f"<article>{ARTICLE}", "Title Short. Some linked text here andA there…"),
        ("<article>x<!-- c --> y<script>var a='</article>'</script> z<br>w<b>v</b></article>", "x y z wv"),
        ("<article><p>one\n\t two</p><aside>three four</aside><form>five <input> six</form><p>seven</p></article>", "one two seven"),
        ('<article><p>text</p><div class="comments"><p>I like this a lot and I say so</p></div></article>', "text"),
        ('<article><p>text</p></article><div id="cookieNotice">We use cookies to do many things for all of our readers</div>', "text"),
        ("<header><h1>Site</h1></header><main><p>Body text</p></main>", "Body text"),
        ("<article><p>a &lt;b&gt; &amp;amp; c</p></article>", "a <b> &amp; c"),
        ('<div class="page with-sidebar sidebar-right"><article><p>kept text</p></article><div class="sidebar"><p>some other words that stand beside it</p></div></div>', "kept text"),
        ('<main><p>body</p></main><div id="comments"><article class="comment-body"><p>I say so</p></article></div>', "body"),
        ('<div class="related-posts"><article><p>teaser of another page</p></article></div><article><p>own</p></article>', "own"),
        ("<style>p{}</style><article>ok</article><style>never closed", "ok"),
        ("<body><h1>My Story</h1><p>First short paragraph of news.</p><p>Second para.</p></body>", "My Story First short paragraph of news. Second para."),
        ('<div class="content"><p>one two three four five six seven eight nine ten eleven twelve</p><p>and five more of them</p></div>', "one two three four five six seven eight nine ten eleven twelve and five more of them"),
        ("<p title=it's>some words stand here</p><p>we don't lose these</p>", "some words stand here we don't lose these"),
        ("<p title=it's>some words stand here</p><p>nor these</p>", "some words stand here nor these"),
        ('<p class="x>some words stand here</p><p>and here</p>', "some words stand here and here"),
        ('<article title="a > b">kept <a href=/x/>link</a> too</article>', "kept link too"),
        ('<article><p>a<span hidden>secret</span>b</p><div style="display: none">gone</div><p>x <span class="advert">Buy now</span> y</p></article>', "ab x y"),
        ("<table><tr><td>one two three<td>four five six</table>", "one two three four five six"),
    ],
)
def test_main_text(page, text):
    assert html_extract.extract(page) == text


def test_tree_fits_its_table():
    rows, labels = html_extract.training_table()
    tree = html_extract.model()
    assert np.mean([html_extract.is_main(tree, r) == bool(y) for r, y in zip(rows, labels)]) > 0.98


#: A second labelled set, of other layouts than the training table's.
HELD_OUT = (
    [("-", "<table><tr><td><a href=1>Start</a><td><a href=2>Our team</a><td><a href=3>Where to find us</a></tr></table>"), ("+", "<center><h2>Annual report of the club</h2></center><p>" + "We met often in this year. " * 9 + "</p><p>The <a href=4>minutes</a> are in the library.</p><p>" + "New members came and old ones left. " * 6 + "</p>"), ("-", "<p><a href=5>Back</a> <a href=6>Top of page</a></p>")],
    [("-", "<ul>" + "<li><a href=x>A headline of eight words stands right here</a></li>" * 7 + "</ul>"), ("+", "<h3>A headline of eight words stands right here</h3>" + "<p>A sentence of eight words stands right here.</p>" * 7)],
    [("-", "<div><a href=a>Shop</a> | <a href=b>Cart</a> | <a href=c>Login</a></div>"), ("+", "<div><h1>Walnut table</h1><div>Made by hand in spring.</div><div>Oiled twice, never varnished.</div></div>"), ("-", "<div><a href=a>Terms</a> | <a href=b>Privacy</a></div>")],
    [("-", '<div id="topbar">Welcome to the site of all sites</div>'), ("+", '<div id="page"><p>' + "It rained for many days. " * 12 + "</p><blockquote>She said so herself.</blockquote><p>" + "Then the sun came out again. " * 8 + "</p></div>"), ("-", '<div class="sidebar-right"><p>Read this too, it is as long as any other text here, and longer than some of them are.</p></div>')],
    [("-", '<header class="masthead"><span>The Paper</span></header>'), ("+", "<main><h1>News</h1><p>Short.</p><p>" + "A longer one. " * 20 + "</p><ul><li>first</li><li>second</li></ul></main>"), ("-", '<div>Not in the main part, though it is a text of some length that stands alone.</div><section class="comments"><p>I liked this very much</p></section>')],
    [("-", "<nav role=navigation><a href=1>one</a><a href=2>two</a></nav>"), ("+", "<article><h2>Of cats</h2><p>They sleep.</p><p>They <a href=x>eat</a>.</p></article>"), ("-", '<div class="newsletter-signup"><p>Give us your address and we write to you each week about all that is new.</p></div>')],
    [("-", "<p><a href=1>Previous chapter</a> <a href=2>Next chapter</a></p>"), ("+", "<p>" + "And so the story went on. " * 30 + "</p><p>He nodded.</p><p>She did not.</p><p>" + "The road was long and dusty. " * 15 + "</p>"), ("-", "<p><a href=1>Previous chapter</a> <a href=2>Next chapter</a></p>")],
)


def test_accuracy_on_a_second_labelled_set():
    tree, right, n = html_extract.model(), 0, 0
    for page in HELD_OUT:
        found, labels = [], []
        for label, markup in page:
            more = html_extract.blocks(markup)
            found += more
            labels += [label == "+"] * len(more)
        assert [b.text for b in html_extract.blocks("".join(m for _, m in page))] == [b.text for b in found]
        said = [html_extract.is_main(tree, r) for r in html_extract.table(found)]
        right += sum(a == b for a, b in zip(said, labels))
        n += len(labels)
    assert right / n >= 0.95


def test_tree_splits_on_link_density():
    def used(tree):
        return {html_extract.FEATURES[tree[1]]} | used(tree[3]) | used(tree[4]) if len(tree) > 1 else set()

    assert {"links", "words", "longest", "article", "hint"} <= used(html_extract.model())
    assert {"links_before", "words_before", "words_after", "links_after"} & used(html_extract.model())
    # Equal but for the links.
    text = "<p>A sentence of eight words stands right here.</p>" * 6
    assert html_extract.extract(text) and not html_extract.extract(text.replace("<p>", "<p><a href=x>").replace("</p>", "</a></p>") + "<p>" + "word " * 60 + "</p>").startswith("A")


class Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.depth = "", 0

    def handle_starttag(self, tag, attrs):
        self.depth += bool(self.depth) or tag in ("script", "style", "svg") or "hidden" in dict(attrs)
        self.words += " " * (tag in html_extract.BLOCK_TAGS)

    def handle_endtag(self, tag):
        self.depth -= bool(self.depth)
        self.words += " " * (tag in html_extract.BLOCK_TAGS)

    def handle_data(self, data):
        self.words += data * (not self.depth)


def test_blocks_match_a_plain_parser():
    rng = random.Random(6)

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word", "two words", " ", "&amp;", "&lt;b&gt;", "caf\u00e9 ", "it's", 'a "quote" '])
        tag = rng.choice("div p span b a section h2 article aside script".split())
        attrs = rng.choice(["", ' class="x > y"', " title='say \"x\"'", ' data-a=it', " hidden", ' href="/a/"'])
        if tag == "script":
            return "<script>if (a < b) { x = '<p>' }</script>"
        # A paragraph or link ends one that it stands in.
        inner = "".join(node(depth - 1) for _ in range(rng.randrange(4)))
        return inner if tag in ("p", "a") and f"<{tag}" in inner or tag == "p" and re.search("<(div|section|h2|article|aside)", inner) else f"<{tag}{attrs}>{inner}</{tag}>"

    for _ in range(400):
        page = "".join(node(4) for _ in range(4))
        plain = Visible()
        plain.feed(page)
        assert " ".join(b.text for b in html_extract.blocks(page)).split() == plain.words.split()


def test_time_is_linear_in_open_tags():
    for tag in ("<div>a", "<b>", "<i><p>", "<span class=ad>a", "</x>", "<a>", "<li>a<b>", "<td>", '<p class="', "<ul><li>a"):
        began = time.monotonic()
        html_extract.extract(tag * 100_000)
        assert time.monotonic() - began < 20


def test_very_long_page_and_deep_nesting():
    assert html_extract.extract("<article>" + "<p>word</p>" * 5000) == " ".join(["word"] * 5000)
    assert html_extract.extract("<div>" * 3000 + "<article>deep</article>") == "deep"
    html_extract.extract("<" * 20_000)
    html_extract.extract("<a " * 5000)


def test_prior_estimate():
    rng = np.random.default_rng(3)
    positive = rng.normal(2, 1, 5000)
    for share in (0.3, 0.6, 0.9):
        mixed = np.concatenate([rng.normal(2, 1, int(5000 * share)), rng.normal(-3, 1, 5000 - int(5000 * share))])
        assert abs(quality.estimate_prior(positive, mixed) - share) < 0.06


def test_quality_without_data():
    model = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros((0, len(quality.NAMES))))
    assert (model.score(np.array([quality.features(None), quality.features("a b"), quality.features("x" * 10**6)])) == 0.5).all()


def test_risk_is_not_negative_and_separates():
    rng = np.random.default_rng(4)
    good = np.abs(rng.normal(1, 0.1, (2000, len(quality.NAMES))))
    bad = np.abs(rng.normal(2, 0.1, (2000, len(quality.NAMES))))
    model = quality.fit(good[:1000], np.vstack([good[1000:], bad[:500]]), iterations=400)
    assert (model.score(good[1000:]) >= 0.5).mean() > 0.98 and (model.score(bad[500:]) < 0.5).mean() > 0.98
