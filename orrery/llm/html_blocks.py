"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut at block tags into flat text blocks.  Each block is described by
its own number of words and link density, those of its neighbours, and what
encloses it: an article or main element, an element that is no article by its tag or
role (navigation, aside, form and the like), a container that a class or id names so.
Names mislead, so they are a hint only: paragraphs are not judged by their own class,
and the tree sees how much of the page's text stands under such names.  A decision
tree, grown once from the small labelled table below, says which blocks are content.
That table holds pages without an article, without names and with wrong ones, so
that words and link density have to decide.

Blocks keep page order; white space inside a block becomes one space, blocks are
joined by one space, character references are decoded, nothing is capped.

Defined results: a null or empty page gives an empty text; markup that is cut off
or not closed is read as far as it goes; repeated rows get equal rows; an empty
table gives no rows; extra columns do not enter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed lists of HTML element names.
HIDDEN_TAGS = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button title".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class and id values that name something other than the article.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies disclaimer disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar tooltip tracking widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
#: Containers, whose names say something of what they hold.
NAMED_TAGS = frozenset("div section ul ol dl table".split())
#: Elements that an opening tag of the same kind closes, as their end tags may be left out.
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TAGS}
WORD_IN_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    article: bool = False
    boiler: bool = False
    named: bool = False
    heading: bool = False
    label: str = ""
    text: str = ""
    words: int = 0
    density: float = 0.0

    def close(self) -> bool:
        self.text = " ".join(html.unescape("".join(self.parts)).split())
        self.words = len(self.text.split())
        self.density = min(1.0, len("".join(html.unescape("".join(self.linked)).split())) / max(1, len(self.text.replace(" ", ""))))
        return bool(self.text)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _role(tag: str, raw: str, in_content: bool) -> tuple[bool, bool, bool, bool, str]:
    """(hidden, boiler, named, content, label) of an element."""
    if tag in HIDDEN_TAGS:
        return True, False, False, False, ""
    boiler = tag in BOILER_TAGS or (tag == "header" and not in_content)
    content = tag in CONTENT_TAGS
    if not raw.strip(" /\t\n"):
        return False, boiler, False, content, ""
    at = _attributes(raw)
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").lower().replace(" ", "")
    boiler |= at.get("role", "").lower() in BOILER_ROLES
    content |= at.get("role", "").lower() == "main"
    named = False
    if tag in NAMED_TAGS:
        names = set(WORD_IN_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{at.get('class', '')} {at.get('id', '')}").lower()))
        named = bool(names & BOILER_WORDS) and not names & CONTENT_WORDS
        content |= tag in ("div", "section") and bool(names & CONTENT_WORDS) and not names & BOILER_WORDS and not boiler
    return hidden, boiler, named, content, at.get("data-label", "")


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order, without those of elements that are never shown."""
    out: list[Block] = []
    # Open elements: tag, hidden, boiler, named, content, heading, link, label.
    stack: list[tuple] = [("", False, False, False, False, False, False, "")]
    block = Block()

    def cut() -> None:
        nonlocal block
        if block.parts and block.close():
            out.append(block)
        block = Block()

    def add(text: str) -> None:
        _, hidden, boiler, named, content, heading, link, label = stack[-1]
        if hidden or not text:
            return
        if not block.parts or text.strip():
            block.article, block.boiler, block.named, block.heading, block.label = content, boiler, named, heading, label
        block.parts.append(text)
        if link:
            block.linked.append(text)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            cut()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID_TAGS:
            continue
        within = SELF_CLOSING.get(tag)
        if within:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        _, hidden, boiler, named, content, heading, link, label = stack[-1]
        own_hidden, own_boiler, own_named, own_content, own_label = _role(tag, raw, content)
        if tag in CONTENT_TAGS and not boiler:
            content = True
        if tag in RAW_END:
            found = RAW_END[tag].search(page, at)
            if not raw.rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                at = found.start() if found else n
        if raw.rstrip().endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_END:
            continue
        stack.append((tag, hidden or own_hidden, boiler or own_boiler, named or own_named, content or own_content, heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), link or tag == "a", own_label or label))
    cut()
    return out


#: More words than these say nothing more of a block.
MANY_WORDS = 25
FEATURES = "words density before_words before_density after_words after_density in_article in_boiler in_named page_has_article named_share heading".split()


def describe(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    words = np.array([b.words for b in found], float)
    density = np.array([b.density for b in found])
    plain = words * (1 - density)
    words = np.minimum(words, MANY_WORDS)
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    article, boiler, named = (np.array(f) for f in zip(*[(b.article, b.boiler, b.named) for b in found]))
    x[:, 6], x[:, 7], x[:, 8] = article, boiler, named
    x[:, 9] = (article & ~boiler & ~named).any()
    x[:, 10] = plain[named & ~boiler].sum() / max(1.0, plain[~boiler].sum())
    x[:, 11] = [b.heading for b in found]
    return x


def _words(n: int) -> str:
    return " ".join(["word"] * n)


def _links(n: int, words: int) -> str:
    return "<ul>" + f"<li><a href=x>{_words(words)}</a>" * n + "</ul>"


LONG = _words(28)
#: The labelled table, as pages: each block's data-label is y (content) or n.
LABELLED = [
    f"<nav data-label=n><a href=1>Home</a><li><a href=2>World news today</a></nav><article data-label=y><h1>Title of it</h1><p>{LONG}<p>Short.<p>{LONG} {LONG}</article><footer data-label=n>&copy; site and some words that go on for a while here</footer>",
    f"<div class=ad data-label=n>Buy now and save a lot of money today with this</div><main data-label=y><h2>Head</h2><p>{LONG}</p><p>A few words</p><ul><li>item one</li><li><a href=1>item two</a></li><li>item three</ul></main><aside data-label=n><p>{LONG}</aside>",
    f"<article><header data-label=y><h1>Name of the story</h1></header><div data-label=y><p>{LONG}<p><a href=x>linked paragraph in the article with some words</a></div><section class=comments data-label=n><p>{LONG}<p>nice post</section></article>",
    f"<article data-label=y><p>One.</p><p>{LONG}</p><div class=share data-label=n><a href=f>Share</a><a href=g>Tweet</a></div><p>Two words</p></article><form data-label=n><p>Your mail address please here</form>",
    f"<article data-label=y><p>One two.</p><p>{LONG}</p><div class=newsletter data-label=n><p>Your mail address</div><p>Two words<div class=notice data-label=n>{LONG}</div><p>And</article>",
    f"<div id=header data-label=n><p>{LONG}</div><div data-label=y><h1>Some heading</h1><p>{LONG} {LONG}<p>{LONG}</div><div data-label=n><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div data-label=n>Imprint and contact</div>",
    f"<div data-label=n><a href=1>Home</a></div><div data-label=n><a href=2>About us</a></div><div data-label=y><p>{LONG}<p>brief words between here<p>{LONG}</div><div data-label=n><a href=3>Next article in this list of articles</a></div>",
    f"<div class=cookie-notice data-label=n><p>{LONG}</div><p data-label=y>{LONG} {LONG}<p data-label=y>{LONG}<div class=related data-label=n><p>{LONG} <a href=1>{LONG}</a></div>",
    f"<p data-label=n><a href=1>Log in</a> or <a href=2>sign up</a><p data-label=n>12 May<p data-label=y>{LONG}<p data-label=y>{LONG} {LONG} {LONG}<p data-label=n>All rights reserved",
    f"<nav data-label=n><a href=1>Home</a></nav><article data-label=y><h1>Last</h1><p>{LONG}<p>{LONG} {LONG}<p>The end.",
    f"<div data-label=n><a href=1>Home</a> <a href=1>Away</a></div><div data-label=y><p>{LONG}<p>{LONG} {LONG}",
    "<article data-label=y>Only one line",
    f"<article data-label=y><p>{LONG}<p><a href=1>read the source</a></article>",
    f"<article data-label=y><p>{LONG} <a href=1>link</a><p>and<p>so<p>on</article><div data-label=n><p>{LONG} {LONG}</div><p data-label=n>some words outside of it",
]
#: More of it by rule, over lengths of text: lists of links in and out of articles, pages of links
#: alone, articles without any mark, names on paragraphs, and names around the whole page.
for _n in (1, 2, 3, 5, 7, 10, 14, 19, 40):
    _menu, _text = f"<div data-label=n>{_links(4, _n)}</div>", f"<p data-label=y>{_words(10 + _n)}"
    LABELLED += [
        f"<article data-label=y><h1>{_words(_n)}</h1><p>{LONG}<p>{_words(_n)}<p class=related-work>{_words(_n)}<p>{LONG}</article>{_menu}",
        f"<article data-label=y><p>{_words(_n)}<p>{LONG}<p>{_words(_n)}{_menu}</article><div data-label=n>{_words(_n)}</div>",
        f"<article data-label=y><p>{LONG}<p>{_words(_n)}{_menu}</article>",
        f"<article data-label=y><p>{LONG}{_menu}<p>{_words(_n)}</article>",
        f"{_menu}{_text}{_text}{_text}<div data-label=n><a href=1>{_words(_n)}</a></div>",
        f"{_menu}<div data-label=n><a href=1>{_words(_n)}</a></div>",
        f"<article data-label=y><h1>{_words(5)}</h1><p>{_words(_n)}</article><p data-label=n>{_words(_n)}<p data-label=n>{LONG}",
        f"<p data-label=n>{_words(_n)}<p data-label=n>{LONG}<article data-label=y><p>{LONG}<p>{_words(_n)}<p>{_words(_n)}</article>",
        f"{_text}<div data-label=n><a href=1>{_words(10 + _n)}</a></div>",
        f"<article data-label=y><p>{LONG}<aside data-label=n><p>{_words(_n)}<p>{LONG}</aside><p>{_words(_n)}<form data-label=n>{_words(_n)}</form><p>{LONG}<p>{_words(_n)}<footer data-label=n><p>{_words(_n)}</footer></article>",
        f"<header data-label=n><p>{_words(_n)}<p>{LONG}</header>{_text}{_text}<aside data-label=n><p>{_words(_n)}<p>{LONG}</aside>{_text}<form data-label=n><p>{_words(_n)}</form><footer data-label=n><p>{_words(_n)}<p>{LONG}</footer>",
        f"<div class=with-sidebar>{_menu}{_text}{_text}<p data-label=y>{_words(_n)}{_text}{_menu}</div>",
        f"<div class=content-header>{_text}{_text}</div>",
        f"{_text}{_text}{_text}{_text}<div class=comments data-label=n><p>{_words(_n)}<p>{LONG}</div>",
        f"<article data-label=y><p>{LONG}<p>{LONG}<div class=comments data-label=n><p>{_words(_n)}<p>{LONG}</div></article><div class=sidebar data-label=n><p>{_words(_n)}</div>",
    ]


def grow(x: np.ndarray, y: np.ndarray, least: int = 1) -> list[tuple]:
    """A decision tree by Gini impurity: nodes (feature, threshold, low child, high child) or (label,)."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append((bool(y[rows].mean() > 0.5),))
        if y[rows].min() == y[rows].max():
            return at
        gini = lambda r: len(r) * 2 * y[r].mean() * (1 - y[r].mean()) if len(r) else 0.0
        best = (gini(rows) - 1e-9, 0, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[rows, f] <= t
                if low.sum() >= least and (~low).sum() >= least:
                    best = min(best, (round(gini(rows[low]) + gini(rows[~low]), 9), f, t))
        if best[0] < gini(rows) - 1e-9:
            low = x[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], build(rows[low]), build(rows[~low]))
        return at

    build(np.arange(len(y)))
    return nodes


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    found = [blocks(page) for page in LABELLED]
    return np.concatenate([describe(b) for b in found]), np.array([b.label == "y" for page in found for b in page], float)


_tree: list[tuple] | None = None


def content_tree() -> list[tuple]:
    global _tree
    if _tree is None:
        _tree = grow(*labelled_table())
    return _tree


def is_content(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """The tree's verdict on each row, level by level."""
    out = np.zeros(len(x), bool)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        node = tree[at]
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def main_text(page: str | None, tree: list[tuple] | None = None) -> str:
    found = blocks(page or "")
    keep = is_content(tree or content_tree(), describe(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = content_tree()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [main_text(h.as_py(), tree) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
