"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are nodes of a tree. Each is content, furniture, or a frame that holds
content somewhere below. A node's emissions (its tag, words of its class and id, length of its own text,
share of link text) depend on its state, a child's state on its parent's. Messages are passed from the
leaves to the root and back (sum-product), which gives each node's exact marginals. Blocks whose node
is content with a probability near that of the page's surest block (SHARE) are the text, so that a bare page of few lines, where
little is sure, is not empty. A wrapper that only holds another wrapper is one node with it.

Probabilities are counted on labelled pages: the skeletons below, labelled by hand, and a sample of at
most SAMPLE_PAGES given pages with exactly one ``article`` or ``main``, labelled by it. So that pages without such
an element are known as well, half of these are counted with its tag hidden.

Scripts, styles, drawings, comments and other markup never are text; formulas are, as part of their
line. Character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space.

Defined cases: null or empty html gives an empty text; plain text without tags is one block of the root
and is content; broken or unclosed tags are read as far as they go; repeated rows come out as often as they
go in; an empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400
#: Longest page, in code points, of the training sample.
LONGEST = 200_000
SMOOTHING = 0.5
#: How often a skeleton counts; they are few.
SKELETON_COUNT = 60
#: A block is content if its probability is at least this share of that of the page's surest block, and at least this much.
SHARE, LEAST = 0.4, 0.1
FURNITURE, CONTENT, FRAME = range(3)

# Elements of HTML by how they are read.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul"
    " button select option optgroup datalist label legend textarea iframe object noscript".split()
)
RAW = "script|style|title|template|svg|textarea|iframe"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that a start tag ends, and what bounds the search for it.
ENDED_BY = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
        " h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split(),
        (frozenset(["p"]), frozenset(["button", "table", "td", "th"])),
    ),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
ITEMS = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"]))}
#: Elements that only hold others, and those of them that say something about what they hold.
WRAPPERS = frozenset(["div", "section", "center", "article", "main"])
TELLING = frozenset(["article", "main"])
#: Words in a class or id that tell what an element is for.
CUES = frozenset(
    "ad ads advert advertisement alert article author banner body bottom breadcrumb byline comment comments content cookie"
    " copyright disqus entry footer form gdpr header login main masthead menu nav navbar navigation newsletter notice pagination"
    " popup post promo related reply respond search share sidebar signup skip social sponsor sponsored story subscribe tags text"
    " toolbar top widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # Closed by itself, so nothing up to an end tag is its own.
    r"|<svg(?=[\s/>])(?:[^>\"'/]|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    # A quote opens a value only after the sign of equality.
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>"
    r"|<[a-zA-Z/][^<>]*+>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

_TEXT = (
    "<p>Running text of a page, a sentence or two that say something about it.</p><p>A longer paragraph, as most of a page's text is made of such, with"
    " more than one sentence in it. It goes on.</p><p>Short text.</p><p>Another paragraph of the text, with <a>a link</a> in it that leads elsewhere.</p>"
)

# Labelled by hand: ``data-content`` marks the elements that are the text, with all below them but those in a "0".
SKELETONS = [
    "<body><header class=header><a href=#>Home</a><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav></header><aside class=sidebar><h3>Related</h3><ul>"
    "<li><a>Some other story</a></li><li><a>And another</a></li></ul></aside><article data-content><h1>A title</h1><p>A first paragraph with enough words to be"
    " read as running text.</p><p>A second one, <a>with a link</a>, that also goes on for a while.</p>" + _TEXT + "<ul><li>A point</li><li>Another point</li></ul></article>"
    "<section class=comments><h2>Comments</h2><div class=comment><p>I read this with interest and do not agree at all.</p></div><div class=comment>"
    "<p>Thanks for sharing this long and fine story with us.</p></div></section><footer><p>Copyright and other small print of the site.</p></footer></body>",
    "<body><div class='cookie notice'><p>We use cookies so that this site works as it should.</p><button>Accept</button></div><div id=menu class=menu><a>Home</a>"
    " <a>News</a></div><div id=main><div class='content post' data-content><h1>A title</h1><div>Text in a division, as long as a paragraph would be, for a"
    " reader.</div><blockquote><p>A quotation that belongs to the text and is as long.</p></blockquote>" + _TEXT + "<pre>some code of the text</pre></div><div class=comments>"
    "<ul><li class=comment><p>A reader comment, which may be as long as the text above it.</p></li></ul></div><form class=newsletter><label>Your address</label>"
    "<p>Sign up for our letter and never miss a thing.</p><button>Send</button></form></div><div class=sidebar><div class='widget ad'><p>Buy this thing now,"
    " it is cheap and good.</p></div></div><div class=footer>Imprint <a>Contact</a></div></body>",
    "<body><nav><a>Start</a> <a>Shop</a></nav><div class=ad>An advert of a few words only.</div><main data-content><h1>A title</h1>" + _TEXT + "<table><tr><th>Name</th><td>Value of a table in the text</td></tr></table><aside data-content=0><p>Read also what others wrote about"
    " it.</p></aside><form data-content=0><label>Vote</label><select><option>Yes</option></select></form><div class=ad data-content=0><p>Another advert, with"
    " a few more words in it.</p></div><p>More text after it.</p></main><div class='share social'><a>Share</a></div><footer>All rights reserved by us.</footer></body>",
    "<div data-content>" + _TEXT + "</div>",
    "<p data-content>Nothing but a word.",
    "<div data-content>Text straight in a division, with no paragraph around it at all.</div>",
    "<body><div><div data-content>" + _TEXT + _TEXT + "</div></div></body>",
    "<div data-content>A short text.</div>",
    "<div data-content>A line of text.</div><p data-content>And one more line.</p>",
    "<body><div data-content>A line of text in a division.</div><div data-content>Another.</div></body>",
    "<body><dl data-content><dt>Word</dt><dd>What it means, in a line.</dd><dt>Other</dt><dd>Its meaning.</dd></dl></body>",
    "<body><h1 data-content>A title</h1><p data-content>A line.</p><ul data-content><li>A point</li><li>Another point</li></ul></body>",
    "<body><header><h1>Name of the site</h1><p>What the site is about in a line.</p></header><section data-content><h2>A title</h2>" + _TEXT + "<h3>Part</h3><p>Another paragraph with more of the text in it.</p><ol><li>First of all, an item.</li></ol></section><aside>"
    "<div class='related promo'><p>You may also like these stories of ours.</p></div><form><p>Search this site</p></form></aside><div class='popup alert'>"
    "<p>Please turn off your blocker to go on.</p></div><footer class=footer><ul><li><a>Terms</a></li></ul></footer></body>",
]
for _named in ("", " class=content", " class='post entry'", " class='article body'", " id=main class=text", " class=story"):
    SKELETONS += [
        "<body><div><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div data-content" + _named + "><h1>A title</h1>" + _TEXT
        + "<form data-content=0><p>Vote here for what you like.</p></form><p>More text.</p></div><div><a>Imprint</a> <a>Contact</a></div></body>",
        "<body><nav><a>Home</a></nav><div><div data-content" + _named + "><h1>A title</h1>" + _TEXT + "<div><p>Text in a division of the text.</p></div>"
        "<div class=ad data-content=0>Buy this good thing.</div><p>End of it.</p></div><div class=sidebar><p>Something else altogether, and"
        " not so short.</p></div></div><footer><p>Small print of the site.</p></footer></body>",
    ]


@dataclass
class Node:
    tag: str
    cues: frozenset[str]
    parent: int
    label: int = 0
    #: Indexes of the blocks of text that are this node's own.
    own: list[int] = field(default_factory=list)
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[str]


def _cues(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    values = " ".join("".join(m) for m in _NAMED.findall(attributes))
    return CUES.intersection(re.split(r"[^a-z]+", values.lower())) if values else frozenset()


def parse(html: str) -> Page:
    """The tree of block elements and the blocks of text in page order. Parents come before children."""
    page = Page([Node("#root", frozenset(), -1)], [])
    nodes, stack, words = page.nodes, [0], []
    links = 0

    def flush() -> None:
        text = " ".join(words)
        words.clear()
        text = _SPACE.sub(" ", text).strip(" ")
        if text:
            nodes[stack[-1]].own.append(len(page.blocks))
            page.blocks.append(text)

    pieces: list[str] = []

    def say(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        node = nodes[stack[-1]]
        n = len(text) - text.count(" ")
        node.chars += n
        if links:
            node.linked += n

    def end_block() -> None:
        if pieces:
            words.append("".join(pieces))
            pieces.clear()
            flush()

    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag

    def deepest(tags: frozenset[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(tags: frozenset[str], bounds: frozenset[str]) -> None:
        depth = deepest(tags)
        if depth > deepest(bounds):
            end_block()
            for node in stack[depth:]:
                depths[nodes[node].tag].pop()
            del stack[depth:]

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            say(html[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if token["end"] else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS:
            if token["end"]:
                end_block()
                close(frozenset([tag]), frozenset())
                links = 0
                continue
            if tag in ITEMS:
                close(*ITEMS[tag])
            if tag in ENDED_BY:
                close(*ENDED_BY[tag])
            end_block()
            if tag not in VOID:
                marked = re.search(r"data-content(=0)?", token["attributes"]) if "data-content" in token["attributes"] else None
                label = nodes[stack[-1]].label if marked is None else int(marked[1] is None)
                nodes.append(Node(tag, _cues(token["attributes"]), stack[-1], label))
                depths[tag].append(len(stack))
                stack.append(len(nodes) - 1)
    if at < len(html):
        say(html[at:])
    end_block()
    return _without_wrappers(page)


def _without_wrappers(page: Page) -> Page:
    """A page in which a wrapper that holds nothing but another one is one node with it, so that content does not fade with the
    number of wrappers around it. The node has the cues of all and the tag of the one that says most."""
    nodes = page.nodes
    children = [0] * len(nodes)
    for node in nodes[1:]:
        children[node.parent] += 1
    kept: list[Node] = []
    place = [0] * len(nodes)
    for i, node in enumerate(nodes):
        above = nodes[node.parent] if i else None
        if above is not None and node.tag in WRAPPERS and above.tag in WRAPPERS and children[node.parent] == 1 and not above.own:
            into = kept[place[node.parent]]
            into.tag = node.tag if node.tag in TELLING or into.tag not in TELLING else into.tag
            into.cues |= node.cues
            into.label, into.own, into.chars, into.linked = node.label, node.own, into.chars + node.chars, into.linked + node.linked
            place[i] = place[node.parent]
        else:
            place[i] = len(kept)
            kept.append(replace(node, parent=place[node.parent] if i else -1))
    return Page(kept, page.blocks)


def emissions(node: Node, chars: int, linked: int, hidden: frozenset[str] = frozenset()) -> list[str]:
    """What a node shows. chars and linked count the whole subtree; a tag or cue that is hidden isn't shown."""
    shown = [f"tag {node.tag if node.tag not in hidden else 'div'}"]
    shown += [f"cue {cue}" for cue in sorted(node.cues - hidden)]
    own = "none" if not node.own else "short" if node.chars < 25 else "middle" if node.chars < 100 else "long"
    share = "none" if chars == 0 else "few" if linked * 10 < chars else "some" if linked * 10 < 6 * chars else "most"
    return [*shown, "cues" if node.cues else "no cues", f"own {own}", f"links {share}"]


def _subtrees(page: Page) -> list[tuple[int, int]]:
    sums = [[n.chars, n.linked] for n in page.nodes]
    for i in range(len(page.nodes) - 1, 0, -1):
        up = sums[page.nodes[i].parent]
        up[0] += sums[i][0]
        up[1] += sums[i][1]
    return [(a, b) for a, b in sums]


def _frames(page: Page) -> Page:
    """Makes frames of the nodes outside of content that have content below."""
    for node in reversed(page.nodes):
        if node.label != FURNITURE and node.parent >= 0 and page.nodes[node.parent].label == FURNITURE:
            page.nodes[node.parent].label = FRAME
    return page


@dataclass(frozen=True)
class Model:
    """The root's prior, a child's state by its parent's, and logarithms of emissions by state."""

    prior: list[float]
    passed: list[list[float]]
    emitted: dict[str, list[float]]


def train(labelled: list[tuple[Page, int, frozenset[str]]]) -> Model:
    """Shares counted over (page, times, hidden tags)."""
    prior = np.full(3, SMOOTHING)
    passed = np.full((3, 3), SMOOTHING)
    states = np.zeros(3)
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    for page, times, hidden in labelled:
        for node, sums in zip(page.nodes, _subtrees(page), strict=True):
            states[node.label] += times
            for shown in emissions(node, *sums, hidden):
                counts[shown][node.label] += times
            if node.parent < 0:
                prior[node.label] += times
            else:
                passed[page.nodes[node.parent].label, node.label] += times
    emitted = {k: np.log((v + SMOOTHING) / (states + 2 * SMOOTHING)).tolist() for k, v in counts.items()}
    return Model((prior / prior.sum()).tolist(), (passed / passed.sum(axis=1, keepdims=True)).tolist(), emitted)


def _shares(logs: list[float]) -> tuple[float, float, float]:
    top = max(logs)
    a, b, c = exp(logs[0] - top), exp(logs[1] - top), exp(logs[2] - top)
    total = a + b + c
    return a / total, b / total, c / total


def marginals(page: Page, model: Model) -> list[float]:
    """Each node's probability of being content, by messages up the tree and down again."""
    nodes, n = page.nodes, len(page.nodes)
    seen = [[0.0, 0.0, 0.0] for _ in nodes]  # logarithms: own emissions and messages of the children
    for i, (node, sums) in enumerate(zip(nodes, _subtrees(page), strict=True)):
        here = seen[i]
        for shown in emissions(node, *sums):
            if (known := model.emitted.get(shown)) is not None:
                here[0] += known[0]
                here[1] += known[1]
                here[2] += known[2]
    (p00, p01, p02), (p10, p11, p12), (p20, p21, p22) = model.passed
    up: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        a, b, c = _shares(seen[i])
        up[i] = x, y, z = log(p00 * a + p01 * b + p02 * c), log(p10 * a + p11 * b + p12 * c), log(p20 * a + p21 * b + p22 * c)
        above = seen[nodes[i].parent]
        above[0] += x
        above[1] += y
        above[2] += z
    full = seen  # with the message from above, once it is there
    full[0] = [v + log(p) for v, p in zip(full[0], model.prior, strict=True)]
    for i in range(1, n):
        above, mine, here = full[nodes[i].parent], up[i], full[i]
        a, b, c = _shares([above[0] - mine[0], above[1] - mine[1], above[2] - mine[2]])
        here[0] += log(a * p00 + b * p10 + c * p20)
        here[1] += log(a * p01 + b * p11 + c * p21)
        here[2] += log(a * p02 + b * p12 + c * p22)
    return [_shares(logs)[CONTENT] for logs in full]


def main_text(html: str, model: Model) -> str:
    page = parse(html)
    if len(page.nodes) == 1:
        return " ".join(page.blocks)
    content = marginals(page, model)
    owner = {b: i for i, node in enumerate(page.nodes) for b in node.own}
    best = max((content[i] for i in owner.values()), default=0.0)
    bar = max(LEAST, SHARE * best)
    return " ".join(text for b, text in enumerate(page.blocks) if content[owner[b]] >= bar)


def _labelled(html: str) -> Page | None:
    """A page labelled by its only article or main; None if it has none or several."""
    page = parse(html)
    marks = [i for i, node in enumerate(page.nodes) if node.tag in ("article", "main")]
    if len(marks) != 1:
        return None
    for i, node in enumerate(page.nodes):
        known_other = node.tag in ("nav", "aside", "footer", "form")
        node.label = int(i == marks[0] or (node.parent >= 0 and page.nodes[node.parent].label and not known_other))
    return _frames(page)


def trained(pages: DataFrame) -> Model:
    """The model of a table of pages. At most SAMPLE_PAGES pages reach the driver, the first by hash of html."""
    first = pages.filter(F.char_length("html") <= LONGEST).select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(SAMPLE_PAGES)
    # At most SAMPLE_PAGES hashes are broadcast; equal pages are taken once.
    rows = pages.select("html", F.xxhash64("html").alias("h")).join(F.broadcast(first), "h").groupBy("h").agg(F.min("html").alias("html"))
    found = [_labelled(r["html"]) for r in rows.orderBy("h").limit(SAMPLE_PAGES).collect()]
    hidden = frozenset(["article", "main"])
    sample = [(page, 1, hidden if i % 2 else frozenset()) for i, page in enumerate(p for p in found if p)]
    by_hand = [(_frames(parse(s)), SKELETON_COUNT, h) for s in SKELETONS for h in (frozenset(), hidden)]
    return train(sample + by_hand)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), one row per page."""
    model = trained(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string")
