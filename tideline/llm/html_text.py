"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page form a tree. Each node is "content" or not; its tag, attribute words, length, link share
and punctuation, and for boxes the length and link share of all in them, give a node potential, and each edge has a potential
P(child state | parent state, kind of child, whether the child lies loose on the page).
Sum-product messages run from the leaves to the root and back, which gives every node its exact content marginal; the
text of nodes with a marginal over one half is kept; if there is none, but the page is likely enough to have content at all,
marginals given that it has. All potentials are smoothed counts over labelled pages, in which
an attribute data-main="1" marks content and data-main="0" its end. Learning runs over a DataFrame of such pages;
without one, over TRAINING_PAGES invented pages with labels (a parameter and the bound of what the model is fitted on).

Text rules: character references are decoded; white space inside a block becomes one space; blocks are joined in page
order by a newline. Scripts, styles, heads, comments and markup never count as text; formulas do. A skipped element that is
not raw text and has no end tag, as any svg closed by "/>", takes nothing after its tag with it. Unclosed and misnested tags are
closed as browsers do for the elements in CLOSES. Pages of any length are parsed whole, in one pass.

Defined cases: null or empty html gives an empty text; html without any tag is one block under the root; rows are
judged one by one, so repeated pages agree.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_PAGES = 1000
#: Where no block is content by itself, but some content is at least this likely, marginals are taken given that there is some.
MIN_CONTENT = 0.05

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
#: Elements whose text is never shown or never part of a page's body.
SKIPPED = frozenset("script style noscript template title textarea iframe svg annotation annotation-xml object select option datalist".split())
#: Of these, those whose content is plain text: all up to their end tag, or to the end of the page, is theirs.
RAW = frozenset("script style title textarea iframe".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
HEAD_END = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
    " math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr"
    " munder munderover semantics".split()
)
#: What an opening tag closes, if it is open in the same section.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
#: Where such closing stops.
SECTIONS = frozenset("html body ul ol dl table article section aside nav header footer main div form blockquote".split())
#: Elements that may stand in a paragraph; any other block closes it.
KINDS = {"p": "text", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell"}
#: What makes no place of its own: blocks straight in them lie loose on the page.
PAGE = frozenset(("#root", "html", "body"))
NAMED = frozenset("article main nav header footer aside form section div ul ol dl table tr body html blockquote pre figure figcaption button fieldset address".split())


class Node:
    """words, link_words: of its own text; below, links_below: of all text in it; loose: whether it lies straight on the page."""

    __slots__ = ("tag", "parent", "marks", "words", "link_words", "stop", "main", "below", "links_below", "loose")

    def __init__(self, tag: str, parent: int, marks: tuple[str, ...] = (), main: bool = False):
        self.tag, self.parent, self.marks, self.main = tag, parent, marks, main
        self.words = self.link_words = self.below = self.links_below = 0
        self.stop = self.loose = False


def sum_up(nodes: list[Node]) -> None:
    """Fills in what nodes (parents before children) have from others."""
    for node in nodes:
        node.below, node.links_below = node.words, node.link_words
        node.loose = node.parent >= 0 and nodes[node.parent].tag in PAGE
    for node in reversed(nodes[1:]):
        parent = nodes[node.parent]
        parent.below += node.below
        parent.links_below += node.links_below


def attribute_marks(attributes: str) -> tuple[tuple[str, ...], str | None]:
    """(attribute words, the value of data-main)."""
    marks, main = [], None
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "data-main":
            main = value
        elif name == "hidden":
            marks.append("hidden")
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                marks.append("hidden")
        else:
            marks += WORDS.findall(value)
    return tuple(dict.fromkeys(marks)), main


def is_closed(attributes: str) -> bool:
    """Whether a tag ends in "/>"; a slash at the end of a value without quotes is the value's."""
    return attributes.endswith("/") and not re.search(r"=[^\s\"']*$", attributes)


def raw_end(html: str, tag: str, at: int) -> int:
    over = RAW_ENDS[tag].search(html, at)
    return over.end() if over else len(html)


def skipped_ends(html: str) -> dict[int, int]:
    """Where each skipped element that is not raw ends, by the end of its opening tag; one without an end tag is left out, so
    that it takes nothing with it."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED - RAW}
    at = 0
    while found := TAG.search(html, at):
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if tag not in SKIPPED:
            continue
        closed = is_closed(found[3] or found[6] or "")
        if found[1] or found[4]:
            if tag in opened and opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in RAW:
            if not (closed and opened["svg"]):
                at = raw_end(html, tag, at)
        elif not (closed and tag == "svg"):
            opened[tag].append(at)
    return ends


def option_end(html: str, at: int) -> int:
    """An option holds text up to its end tag or to any other block."""
    while found := TAG.search(html, at):
        tag = (found[2] or found[5] or "").lower()
        if tag == "option" and (found[1] or found[4]):
            return found.end()
        if tag and tag not in INLINE and tag not in VOID:
            return found.start()
        at = found.end()
    return len(html)


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes, parents before children; (node, text) of every block of text in page order)."""
    nodes = [Node("#root", -1)]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    places: dict[str, list[int]] = {}  # of open blocks in the stack, by tag
    sections = [0]  # of open sections in the stack
    headless = False  # no head ends any more
    pieces: list[str] = []
    links = link_words = 0
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal link_words
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                node = nodes[stack[-1]]
                node.words += text.count(" ") + 1
                node.link_words += link_words
                node.stop |= text[-1] in ".!?…:;\"'”»)"
                blocks.append((stack[-1], text))
        link_words = 0

    def cut(depth: int) -> None:
        """Closes all blocks from a place in the stack on."""
        for k in stack[depth:]:
            places[nodes[k].tag].pop()
        while sections[-1] >= depth:
            sections.pop()
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        found = TAG.search(html, at)
        text = html[at : found.start() if found else end]
        if text:
            pieces.append(text)
            if links:
                link_words += len(text.split())
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(found[1] or found[4])
        if tag in INLINE or tag in VOID:
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "hr", "img", "mtd"):
                pieces.append(" ")
            continue
        if tag in SKIPPED or tag == "head":
            if closing:
                continue
            if tag == "head":
                over = None if headless else HEAD_END.search(html, at)
                headless = over is None
                at = over.end() if over else at
            elif tag in RAW:
                at = raw_end(html, tag, at)
            elif tag == "option":
                at = option_end(html, at)
            else:
                ends = skipped_ends(html) if ends is None else ends
                at = ends.get(at, at)
            continue
        flush()
        links = 0
        if closing:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        inside = [own[k] for own in (places.get(t, ()) for t in CLOSES.get(tag, ("p",))) if (k := bisect(own, sections[-1])) < len(own)]
        if inside:
            cut(min(inside))
        marks, main = attribute_marks(found[3] or found[6] or "")
        parent = stack[-1]
        nodes.append(Node(tag, parent, marks, nodes[parent].main if main is None else main == "1"))
        places.setdefault(tag, []).append(len(stack))
        if tag in SECTIONS:
            sections.append(len(stack))
        stack.append(len(nodes) - 1)
    flush()
    sum_up(nodes)
    return nodes, blocks


def share(links: int, words: int) -> str:
    return "none" if not links else "some" if links < 0.5 * words else "most"


def features(node: Node) -> list[str]:
    words, below = node.words, node.below
    size = "none" if not words else "1" if words < 3 else "3" if words < 8 else "8" if words < 25 else "25"
    tag = node.tag if node.tag in NAMED or node.tag in KINDS else "other"
    found = [f"tag:{tag}", f"size:{size}"]
    if words:
        found.append(f"links:{share(node.link_words, words)}")
        found.append(f"stop:{node.stop}")
    if below > words:  # a box of blocks
        found.append(f"below:{'1' if below < 12 else '12' if below < 40 else '40' if below < 120 else '120'}")
        found.append(f"links below:{tag}:{share(node.links_below, below)}")
    return found + [f"mark:{m}" for m in node.marks]


def kind(node: Node) -> str:
    return ("loose " if node.loose else "") + KINDS.get(node.tag, "box")


def page_counts(html: str) -> Counter:
    """Training counts of a labelled page: (what, state) of node features, (kind, parent state, state) of edges."""
    counts: Counter = Counter()
    nodes, _ = parse(html)
    for node in nodes[1:]:
        state = int(node.main)
        counts["node", "", state] += 1
        for f in features(node):
            counts["feature", f, state] += 1
        counts["edge", f"{kind(node)}:{int(nodes[node.parent].main)}", state] += 1
    return counts


class Model:
    """Node and edge potentials from counts (add-half smoothing; a word never seen says nothing)."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        total = [counts.get(("node", "", s), 0) + 1.0 for s in (0, 1)]
        self.node = {}
        for f in {k[1] for k in counts if k[0] == "feature"}:
            a, b = ((counts.get(("feature", f, s), 0) + 0.5) / (total[s] + 1) for s in (0, 1))
            self.node[f] = math.log(b / a)
        self.edge = {}
        for k in (where + what for where in ("", "loose ") for what in ("text", "head", "item", "cell", "box")):
            for parent in (0, 1):
                off, on = (counts.get(("edge", f"{k}:{parent}", s), 0) + 0.5 for s in (0, 1))
                self.edge[k, parent] = (off / (off + on), on / (off + on))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by one upward and one downward pass."""
        return self.beliefs(nodes)[0]

    def beliefs(self, nodes: list[Node]) -> tuple[list[float], float]:
        """(marginals; P(any node is content), from what the upward pass sums up to)."""
        n = len(nodes)
        none, every = 0.0, 0.0  # logarithms of the weight of "no content" and of all states
        own0, own1 = [1.0] * n, [1.0] * n
        own1[0] = 0.0  # the root is not content
        up0, up1 = [1.0] * n, [1.0] * n
        edges = [None] + [(self.edge[kind(x), 0], self.edge[kind(x), 1]) for x in nodes[1:]]
        for k in range(1, n):
            odds = math.exp(max(-30.0, min(30.0, sum(self.node.get(f, 0.0) for f in features(nodes[k])))))
            own0[k], own1[k] = 1 / (1 + odds), odds / (1 + odds)
            none += math.log(own0[k] * edges[k][0][0])
        for k in range(n - 1, 0, -1):
            total = own0[k] + own1[k]
            every += math.log(total)
            a, b = own0[k] / total, own1[k] / total
            own0[k], own1[k] = a, b
            from0, from1 = edges[k]
            up0[k], up1[k] = from0[0] * a + from0[1] * b, from1[0] * a + from1[1] * b
            parent = nodes[k].parent
            p0, p1 = own0[parent] * up0[k], own1[parent] * up1[k]
            own0[parent], own1[parent] = p0 / (p0 + p1), p1 / (p0 + p1)
            every += math.log(p0 + p1)
        belief = [0.0] * n
        for k in range(1, n):
            parent = belief[nodes[k].parent]
            d0, d1 = (1 - parent) / up0[k], parent / up1[k]
            from0, from1 = edges[k]
            b0 = own0[k] * (d0 * from0[0] + d1 * from1[0])
            b1 = own1[k] * (d0 * from0[1] + d1 * from1[1])
            belief[k] = b1 / (b0 + b1)
        return belief, max(0.0, -math.expm1(min(0.0, none - every)))

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        nodes, blocks = parse(html)
        if len(nodes) == 1:
            return "\n".join(text for _, text in blocks)
        belief, some = self.beliefs(nodes)
        least = 0.5
        if some >= MIN_CONTENT and not any(belief[k] > least for k, _ in blocks):
            least *= some  # marginals given that there is content
        return "\n".join(text for k, text in blocks if belief[k] > least)


def invented_page(seed: int) -> str:
    """A labelled page: one of many layouts around an article of paragraphs, headings, lists and quotes."""
    r = random.Random(seed)
    syllables = "an be co da el fi go hu is ja ka lo mi no or pe qu ra so ta un vi wo za".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentences = lambda a, b: " ".join(words(3, 14).capitalize() + r.choice("...!?") for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}{r.choice(['</li>', ''])}" for _ in range(r.randint(a, b))) + "</ul>"
    box = lambda names, inner, tag=None: f'<{(t := tag or r.choice(["div", "div", "section"]))} {r.choice(["class", "class", "id"])}="{r.choice(names.split())}">{inner}</{t}>'

    def paragraph(mark: str = "") -> str:
        text = sentences(1, 6) if r.random() < 0.9 else words(1, 6)
        if r.random() < 0.2:
            text = f"<b>{text}" + r.choice(["</b>", "<br>"])
        if r.random() < 0.15:
            text += " " + link() + " " + sentences(1, 1)
        return f"<p{mark}>{text}" + r.choice(["</p>"] * 5 + [""])

    def body(mark: str = "") -> str:
        """An article's blocks; mark: labels of their own where nothing around them is labelled."""
        parts = []
        for _ in range(r.randint(1, 10)):
            x = r.random()
            if x < 0.72:
                parts.append(paragraph(mark))
            elif x < 0.82:
                parts.append(f"<h{(h := r.randint(2, 4))}{mark}>{words(2, 8)}</h{h}>")
            elif x < 0.88:
                parts.append(f"<ul{mark}>" + "".join(f"<li>{sentences(1, 2) if r.random() < 0.6 else words(1, 8)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.92:
                parts.append(f"<blockquote{mark}>{sentences(1, 3)}</blockquote>")
            elif x < 0.95:
                parts.append(f"<table{mark}>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.97:
                parts.append(f"<pre{mark}>{words(4, 20)}</pre>")
            else:
                parts.append('<div data-main="0" class="' + r.choice(["ad", "advert", "promo", "related", "share", "newsletter"]) + f'">{sentences(1, 1)}</div>')
        return "".join(parts)

    comment = lambda: f'<div class="comment"><p>{sentences(1, 3)}</p></div>'
    before = [
        lambda: f"<nav>{links(3, 8)}</nav>",
        lambda: box("nav menu navbar topnav navigation breadcrumb breadcrumbs", r.choice([links(2, 8), " ".join(link() for _ in range(4))])),
        lambda: f"<header>{r.choice([words(1, 5), f'<h1>{words(1, 4)}</h1>', f'<p>{sentences(1, 1)}</p>'])}{r.choice(['', links(2, 5)])}</header>",
        lambda: box("header masthead topbar banner site-header logo", f"<p>{words(1, 8)}</p>"),
        lambda: box("ad ads advert advertisement sponsor sponsored banner promo promotion", r.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p>", link()])),
        lambda: box("cookie cookies notice cookie-notice consent gdpr alert popup modal", r.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p>"]) + "<button>OK</button>"),
        lambda: f'<form action="/s">{words(1, 4)} <input name="q"><button>{word()}</button>{r.choice(["", f"<p>{sentences(1, 2)}</p>"])}</form>',
        lambda: f"<aside>{r.choice([links(3, 8), f'<h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p>'])}</aside>",
        lambda: box("sidebar side widget related recommended rail", r.choice([links(3, 8), f"<h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p>"])),
    ]
    after = before[4:] + [
        lambda: f"<footer>{r.choice(['', '<p>'])}&copy; {words(1, 3)} &middot; {sentences(1, 2)}</footer>",
        lambda: f"<footer>{links(2, 6)}<p>{sentences(1, 2)}</p></footer>",
        lambda: box("footer site-footer bottom copyright legal disclaimer", r.choice([words(3, 9), f"<p>{sentences(1, 2)}</p>", links(2, 5)])),
        lambda: box("comments comment-list responses replies discussion reader-comments", f"<h3>{words(1, 3)}</h3>" + "".join(comment() for _ in range(r.randint(1, 5)))),
        lambda: f'<section class="comments">{"".join(comment() for _ in range(r.randint(1, 4)))}</section>',
        lambda: box("share social sharing follow tags subscribe newsletter signup", r.choice([links(2, 5), f"<p>{sentences(1, 2)}</p>"])),
    ]
    title = f"<h1>{words(2, 10)}</h1>"
    own = ' data-main="1"'
    loose = f"<h1{own}>{words(2, 10)}</h1>{body(own)}"
    lines = "<br><br>".join(sentences(2, 6) for _ in range(r.randint(1, 5)))
    main = r.choice(
        [
            f'<article data-main="1">{title}{body()}</article>',
            f'<article data-main="1">{title}{body()}</article>',
            f'<main data-main="1">{title}{body()}</main>',
            f'<main><article data-main="1">{title}{body()}</article></main>',
            f'<div data-main="1" class="{r.choice("content article post entry story main text body post-content entry-content article-body".split())}">{title}{body()}</div>',
            f'<div class="{r.choice("wrapper container page row".split())}"><div data-main="1" id="{r.choice("content main article post story".split())}">{title}{body()}</div></div>',
            f'<div data-main="1" class="{r.choice("content article post entry story main text body post-content entry-content article-body".split())}">{title}{body()}</div>',
            # without a wrapper, in wrappers that have no names, and in a table's cell
            loose,
            loose,
            f"<div{own}>{title}{body()}</div>",
            f"<div><div><div{own}>{title}{body()}</div></div></div>",
            f"<section{own}>{title}{body()}</section>",
            f"<div{own}>{lines}</div>",
            f"<table><tr><td>{links(2, 6)}</td><td{own}>{title}{body()}</td></tr></table>",
            f'<div class="row"><div class="col">{links(2, 6)}</div><div class="col"{own}>{title}{body()}</div></div>',
        ]
    )
    head = "".join(x() for x in r.sample(before, r.randint(1, 4)))
    foot = "".join(x() for x in r.sample(after, r.randint(1, 4)))
    inner = f"{head}{main}{foot}"
    if main is not loose and r.random() < 0.3:
        inner = f'<div class="{r.choice("wrapper container page site".split())}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{inner}</body></html>"


def training_pages(spark: SparkSession, n: int = TRAINING_PAGES) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"html": [invented_page(int(k)) for k in frame["id"]]})

    return spark.range(n).mapInPandas(run, "html string")


def learn_model(labelled: DataFrame) -> Model:
    """From pages with data-main labels; only counts by feature come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for html in frame["html"].dropna():
                counts.update(page_counts(html))
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["what", "name", "state", "n"])

    rows = labelled.select("html").mapInPandas(run, "what string, name string, state int, n long")
    return Model({(r.what, r.name, r.state): r.n for r in rows.groupBy("what", "name", "state").agg(F.sum("n").alias("n")).collect()})


def extract_text(pages: DataFrame, model: Model, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns of pages, text and n_chars."""
    own = pages.select(*columns, F.col("html").alias("page_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(h) for h in batch.column("page_html").to_pylist()]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            kept += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, [*batch.schema.names[:-1], "text", "n_chars"])

    return own.mapInArrow(run, kinds + ", text string, n_chars long")
