"""Operator 10: main text of HTML pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. A tag costs; a word scores the log-odds, learned from the labelled pages
below, that a word under its open elements (their names, but those of plain boxes, and the words of their class, id and
role) is content; cue words of a short text count too.
One linear scan finds the contiguous region of the highest sum. Blocks of the region whose own words score
negative (an advert inside an article) are left out of it; nothing else is dropped.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two line
feeds. Script, style and comments are no words, wherever they end. A null or empty page, or one without a positive
word, gives the empty text; unclosed and broken tags are read as browsers do in essence (a new block closes an open
paragraph, an unmatched end is ignored). Time and memory are in proportion to the page, however deep or broken it is.
Main text in several regions with much between them is found in its best region alone. Repeated rows give one row each;
further columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|([!?/]))")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
BROKEN = re.compile(r"[^<>]*+>?")
MARK = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
PART = re.compile(r"[a-z]+")
#: Elements whose content is no text; it ends at their end tag.
RAW = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "template", "textarea", "noscript")}
SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")

#: Elements that end a block of text; all others are part of a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening block closes, up to the nearest container.
CLOSED = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that say nothing of what they hold.
PLAIN = frozenset("html body div span table tbody thead tr td th center font b i u em strong small big br".split())
#: Words that short blocks beside the main text hold, and the length up to which a piece of text counts as one.
CUE = re.compile(r"\b(?:copyright|reserved|cookies|newsletter|subscribe|advertisement|sponsored|share)\b|©|&copy;")
CUE_LONGEST = 160
LINES = frozenset(("b", "i", "u", "em", "strong", "span", "a", "font", "small", "big", "code", "sub", "sup", "s", "q", "cite", "mark"))

#: Labelled pages: what lies in <x->...</x-> is content. Names of elements and words of class, id and role are what is learned.
LABELLED = (
    '<html><head><title>Site news</title></head><body><header><h1>My site name</h1><nav><ul><li><a href="/">Home page</a></li><li><a href="/b">About us</a></li></ul></nav></header><x-><main><article><h1>The real headline of it</h1><p>First words of the main text go on for a while here.</p><p>And a <b>second</b> paragraph with a <a href="/c">link inside</a> it.</p><ul><li>one point of the list</li><li>another point of it</li></ul></article></main></x-><aside class="sidebar related"><p>Read also this other story of ours</p></aside><footer>All rights reserved by the site</footer></body></html>',
    '<html><head><title>A page</title></head><body><div class="cookie notice banner"><p>We use cookies on this site</p><button>Accept all</button></div><div id="menu"><a href="/1">One</a> <a href="/2">Two</a></div><x-><div class="content post"><h2>A headline here</h2><p>Some text that people came to read on this page.</p><blockquote>Someone said something worth a quote.</blockquote><p>More text after the quote, of some length.</p></div></x-><div class="comments" id="comments"><div class="comment"><p>Nice story, thank you for it</p></div><div class="comment"><p>I do not agree at all</p></div></div><div class="footer">Contact and imprint</div></body></html>',
    '<html><head><title>T</title></head><body><nav class="breadcrumb"><a href="/">Start</a></nav><div class="ad advert ads">Buy this thing now while it is cheap</div><x-><article><h1>Title words</h1><p>Words of the story come here, quite a few.</p></article></x-><article-><div class="promo sponsored">Our sponsor has an offer for you</div></article-><form class="newsletter subscribe"><label>Your mail</label><button>Send</button></form><section class="share social"><a href="/s">Share it</a></section><footer><p>Terms and privacy</p></footer></body></html>',
    '<html><head><title>T</title></head><body><x-><h1>Only a heading</h1><p>And a plain page of text without any container at all.</p><table><tr><td>cell of a table</td><td>another cell</td></tr></table><pre>code is kept</pre></x-><div class="widget popup modal overlay">Sign up for it</div><footer>footer words</footer></body></html>',
    '<html><head><title>T</title></head><body><div role="navigation">Jump to a part</div><div role="banner">Name of site</div><x-><main><section><h2>Part one</h2><p>Some text of part one that goes on.</p></section><section><h3>Part two</h3><p>Some text of part two that goes on.</p><figure><figcaption>What the picture shows</figcaption></figure></section></main></x-><aside><h3>Other stories</h3><ul><li><a href="/x">Story x</a></li><li><a href="/y">Story y</a></li></ul></aside><select><option>English</option><option>German</option></select><div role="contentinfo">Imprint</div></body></html>',
    '<html><body><div id="page"><div class="header">Site</div><div id="wrapper"><x-><div><div><h1>Headline within plain boxes</h1><div><p>Text within boxes of no name at all, as many pages have it.</p><p>A further paragraph of the same text.</p></div><div>Text without a paragraph, right in its box, goes on for long.</div></div></div></x-></div><div class="sidebar">Side words of the site</div></div></body></html>',
    '<html><body><main><article><x-><h1>An article that holds other things</h1><p>It begins with a paragraph of its own text.</p></x-><aside class="related"><p>Read another story of this site</p></aside><x-><p>The text goes on after the aside for some words.</p></x-><nav class="toc"><ul><li><a href="/1">Part one of it</a></li></ul></nav><x-><p>And on after the list of its parts.</p></x-><div class="ad advert"><p>Buy this now</p></div><x-><p>The last words of the article.</p></x-><form class="form"><p>Leave your address here</p></form><section class="comments"><p>A comment of a reader</p></section><footer class="meta"><p>Shared ten times</p></footer></article></main></body></html>',
    '<html><body><header class="header top"><p>Welcome to our site today</p></header><x-><article><header><h1>Headline inside its article</h1></header><p>Text under it follows here.</p></article></x-><section class="comments replies discussion"><h3>Reader comments</h3><article class="comment"><p>First comment by a reader here</p></article></section><dialog>Please log in</dialog></body></html>',
    '<html><body><div class="topbar">Log in or sign up</div><div class="logo">The paper</div><x-><div class="story"><div>A story told in plain boxes that goes on for a while, as many do.</div><div>More of the same story in one more box, with some further words.</div></div></x-><div class="bottom">Copyright of the paper</div><p>Copyright 2019 The paper</p></body></html>',
    '<html><body><table><tr><td class="nav"><a href="/">Start</a> <a href="/n">News</a></td></tr><tr><td><x->The whole text of an old page lies in a cell of a table, without paragraphs.<br>A second line of it goes on after the break, and a third.</x-></td></tr><tr><td class="copyright">All rights reserved</td></tr></table></body></html>',
    '<html><body><ul class="links"><li><a href="/a">First of some links</a></li><li><a href="/b">Second of some links</a></li></ul><x-><div id="text"><p>The first paragraph of the text in its box, some words long.</p><div>And text of it without a paragraph.</div></div></x-><div class="links"><a href="/c">More of this</a> <a href="/d">More of that</a></div><div>© 2020 The site, all rights reserved</div></body></html>',
    '<html><body><div class="entry"><x-><div class="entry-body"><span>Words of an entry of a journal, in a box in a box, go on here.</span> And on without a mark, for the length of a line.</div></x-></div><div class="tags"><a href="/t">one tag</a> <a href="/u">another tag</a></div><div class="pager"><a href="/o">Older</a> <a href="/n">Newer</a></div><div class="share">Share this on a network</div><div>Subscribe to the newsletter</div></body></html>',
    '<html><body><div><div><div><x-><section class="body"><div class="text">Deep in boxes lies the text, which has a good many words to it, as one would hope.</div><div class="text">It has a second box of text with more words.</div></section></x-></div></div><div class="meta">By someone at some time</div></div><div class="recommended"><h4>You may like these</h4><div>A story of another kind</div></div><div class="cookie">This site uses cookies</div></body></html>',
    '<html><body><nav>Jump to the part that you want</nav><div class="menu">Home and news and sport</div><div><button>Accept all of them</button> <label>Your name goes here</label></div><x-><div>Between such things there is a text of some length that somebody wrote.</div></x-><ul><li><a href="/p">Story p</a></li><li><a href="/q">Story q</a></li></ul><div class="breadcrumb">Home and news</div><div class="social">Follow us there</div><button>Back to the top</button></body></html>',
    '<html><body><x-><div>A page that is one box of text and nothing else, with words enough to be read.</div><div>And a second box.</div></x-></body></html>',
    '<html><body><div class="head"><a href="/">Home</a></div><x-><div class="post-text"><p>A question that someone asks, with all its detail.</p><pre>a line of code</pre><ol><li>first step of it</li><li>second step of it</li></ol></div></x-><div class="reply comment"><p>A remark of a reader</p></div><div class="login">Log in to reply</div></body></html>',
)


def scan(page: str) -> Iterator[tuple[int, str, str]]:
    """(0, text, ""), (1, name, attributes) of start tags and (2, name, "") of end tags, in one pass.

    A tag ends at the first > outside quotes. Where a quote never closes, quotes count no more from there on.
    """
    at, quotes = 0, True
    while at < len(page):
        m = START.search(page, at)
        if not m:
            yield 0, page[at:], ""
            return
        if m.start() > at:
            yield 0, page[at : m.start()], ""
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        if m[4]:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
            continue
        rest = ATTRIBUTES.match(page, m.end()) if quotes else None
        if rest is None:
            quotes, rest = False, BROKEN.match(page, m.end())
        name, at = m[3].lower(), rest.end()
        if m[2]:
            yield 2, name, ""
        elif name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
        else:
            yield 1, name, rest[0].rstrip(">")


class Path:
    """The open elements of a place in a page, and the score of a word there; each step costs what it opens or closes."""

    def __init__(self, weight: dict[str, float], own: float) -> None:
        self.weight = weight
        self.active: dict[str, int] = {}
        self.open: dict[str, int] = {}
        self.stack: list[tuple[str, tuple[str, ...], int, float]] = []  # name, features, first closable element, score before
        self.score = own

    def features(self) -> list[str]:
        return [f for f, n in self.active.items() if n]

    def push(self, name: str, attributes: str) -> None:
        marks = [w for x in MARK.findall(attributes) for w in PART.findall((x[0] or x[1] or x[2]).lower())] if attributes else []
        found = tuple(dict.fromkeys(([] if name in PLAIN else [name]) + ["." + w for w in marks]))
        last = self.stack[-1][2] if self.stack else -1
        closable = last if name in LINES else (last if last >= 0 else len(self.stack)) if name in CLOSED else -1
        self.stack.append((name, found, closable, self.score))
        self.open[name] = self.open.get(name, 0) + 1
        for f in found:
            if not self.active.get(f):
                self.score += self.weight.get(f, 0.0)
            self.active[f] = self.active.get(f, 0) + 1

    def pop(self) -> str:
        name, found, _, self.score = self.stack.pop()
        self.open[name] -= 1
        for f in found:
            self.active[f] -= 1
        return name

    def step(self, kind: int, name: str, attributes: str) -> None:
        if kind == 2:
            if self.open.get(name):
                while self.pop() != name:
                    pass
            return
        if name in BLOCKS and name != "hr" and self.stack and (first := self.stack[-1][2]) >= 0:
            while len(self.stack) > first:
                self.pop()
        if name == "li" and self.stack and self.stack[-1][0] == "li":
            self.pop()
        if name not in VOID and not attributes.endswith("/"):
            self.push(name, attributes)


def tokens(page: str, path: Path) -> Iterator[tuple[int, str, bool]]:
    """The page's parts in order, with ``path`` at their place: (1, text, begins a block) and (0, name, False) for tags."""
    fresh = True
    for kind, name, attributes in scan(page):
        if not kind:
            yield 1, name, fresh
            fresh = False
            continue
        path.step(kind, name, attributes)
        yield 0, name, False
        if name in BLOCKS:
            fresh = True
        elif name == "br":
            yield 1, " ", False


def told(text: str) -> list[str]:
    """The cue words of a block's text, as features."""
    return sorted({f"={w}" for w in CUE.findall(text.lower())}) if len(text) <= CUE_LONGEST else []


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], float, float]:
    """Each feature's weight, a word's own weight, and a tag's cost, by logistic regression over the labelled pages."""
    names: dict[str, int] = {"": 0}
    rows: list[tuple[list[int], int, int]] = []
    tags = [0, 0]
    for page in LABELLED:
        path = Path({}, 0.0)
        for kind, text, _ in tokens(page, path):
            inside = path.open.get("x-", 0) > 0
            if kind and text.split():
                own = [names.setdefault(f, len(names)) for f in [*path.features(), *told(text)] if not f.endswith("-")]
                rows.append(([0, *own], int(inside), len(text.split())))
            elif not kind:
                tags[inside] += 1
    x = np.zeros((len(rows), len(names)))
    for k, (own, _, _) in enumerate(rows):
        x[k, own] = 1
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w = np.zeros(len(names))
    prior = np.r_[0.01, np.full(len(names) - 1, 0.05)]  # a word of no features leans to what the labelled pages have
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(prior)
        w += np.linalg.solve(h, x.T @ (n * (y - p)) - prior * w)
    inside_words = float((n * y).sum())
    cost = float(np.log((tags[1] + 1) / (inside_words + 1)) - np.log((tags[0] + 1) / (n.sum() - inside_words + 1)))
    return {f: float(w[k]) for f, k in names.items() if f}, float(w[0]), min(-0.05, cost)


def extract(page: str) -> str:
    """The page's main text: blocks in page order, two line feeds between them."""
    weight, own, cost = weights()
    path = Path(weight, own)
    blocks: list[list[tuple[str, float]]] = []
    steps: list[tuple[float, int]] = []  # score, block (-1: a tag)
    for kind, text, first in tokens(page, path):
        if not kind:
            steps.append((cost, -1))
            continue
        if first or not blocks:
            blocks.append([])
        value = min(4.0, max(-4.0, path.score + sum(weight.get(f, 0.0) for f in told(text))))
        n = len(text.split())
        blocks[-1].append((text, value * n))
        if n:
            steps.append((value * n, len(blocks) - 1))
    best, total, start, low, high = 0.0, 0.0, 0, 0, 0
    for k, (value, _) in enumerate(steps):
        if total <= 0:
            total, start = 0.0, k
        total += value
        if total > best:
            best, low, high = total, start, k + 1
    inside = dict.fromkeys(b for _, b in steps[low:high] if b >= 0)
    out = []
    for b in inside:
        text = SPACE.sub(" ", html.unescape("".join(t for t, _ in blocks[b]))).strip(" ")
        if text and sum(v for _, v in blocks[b]) > 0:
            out.append(text)
    return "\n\n".join(out)


def main_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the columns ``keep``, ``text`` and ``n_chars`` (code points)."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                own = batch.slice(first, 500)
                texts = [extract(x) if x else "" for x in own.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return pages.select(*(F.col(c) for c in keep), F.col(html_col)).mapInArrow(run, schema)
