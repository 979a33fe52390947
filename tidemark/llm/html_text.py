"""Main text of web pages by composite text density.

Every DOM node gets its text density: characters for each tag, adjusted for characters in links.
A block's density sum is that of the blocks right below it and of its own text beside them, or its own
density if there are none.  The block with the largest sum is the core of the article; the smallest
density on the path from it up to the page's frame is the threshold, and the text is taken from the
smallest subtree that holds the core, every block beside it that reaches the threshold, has a tenth of
its text or is a heading.  The blocks on the way up from the core reach the threshold by definition and
do not count.  Lists of links that neither are in such a block nor hold one stay out.

An article element is taken whole if it has the core and others are short, or if it is the only one and
has more than a tenth of the core's text; in a main element only lists of links stay out.  Elements that HTML itself
or their class, id or role name as menus, adverts, forms and the like are no content, unless they hold
the page's article or most of its text: such containers are judged by density.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, small_batches, whole_text

AT_ONCE = 4 << 20

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"""
    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<loose>[^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
TARGET = re.compile(r"\bhref\b", re.I)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select article aside section div body main nav header footer form td th".split())

#: Elements and words in class, id or role that name what is not the article.
NO_CONTENT = frozenset("nav footer aside form script style head title noscript template iframe button select textarea svg menu "
                       "dialog object canvas input".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply widget "
    "pagination pager toolbar search complementary contentinfo dialog hidden".split())
#: What a node named as no content must hold of the page's text outside links to be entered after all: NEVER is never,
#: CLOSED only with the page's article in it.  NAMED is for nodes that have no other name, MIXED for the others.
NEVER, CLOSED, NAMED, MIXED = 2.0, 1.0, 0.9, 0.5
ENTERED = {"nav": CLOSED, "footer": CLOSED, "menu": CLOSED, "aside": NAMED, "header": NAMED, "dialog": NAMED, "object": NAMED, "form": MIXED}
#: Headings that belong to the article wherever they stand, and the part of the core's text that is too much to leave out.
HEADINGS, MUCH = ("h1", "h2"), 0.1


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "links", "tags", "link_tags", "density", "sum", "skip", "inline", "target",
                 "linked", "own", "own_links", "first", "last")

    def __init__(self, tag: str, parent: Node | None, skip: float, target: bool = False):
        self.tag, self.parent, self.skip, self.target = tag, parent, skip, target
        self.children: list[Node | str] = []
        self.inline = tag in INLINE
        self.linked = False
        self.chars = self.links = self.tags = self.link_tags = 0
        #: Characters outside the blocks below, and the positions of the subtree among the measured nodes.
        self.own = self.own_links = self.first = self.last = 0
        self.density = self.sum = 0.0


def _no_content(tag: str, attributes: str, inside_article: bool) -> float:
    """0 for content, else how much of the page's text the node must hold to be entered."""
    least = 0.0
    if tag in NO_CONTENT or tag == "header" and not inside_article:
        least = ENTERED.get(tag, NEVER)
    names, named = set(), False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return NEVER
        if name == "style" and "display:none" in value.replace(" ", ""):
            return NEVER
        if name in ("class", "id", "role"):
            words = set(NAME_PARTS.findall(value))
            names |= words
            if words & NO_CONTENT_WORDS and tag not in ("body", "html", "article", "main"):
                named = True
            if "header" in words and not inside_article or words & {"comment", "comments"}:
                named = True
    if named:
        least = max(least, MIXED if names - NO_CONTENT_WORDS - {"header"} else NAMED)
    return least


def parse(html: str) -> Node:
    """The tree of a page, forgiving as browsers are: unclosed, stray and crossed tags never lose text."""
    root = Node("html", None, 0.0)
    here, at, articles = root, 0, 0
    for found in TAG.finditer(html):
        begin = found.start()
        if begin < at:  # inside raw text that was passed over
            continue
        if begin > at:
            here.children.append(html[at:begin])
        at = found.end()
        kind = found.lastgroup
        if kind is None:
            continue
        if found["data"] is not None:
            here.children.append(found["data"])
            continue
        name = found["end"]
        if name is not None:
            name, node = name.lower(), here
            while node is not root and node.tag != name:
                node = node.parent
            if node is not root:
                while here is not node:
                    articles -= here.tag in ("article", "main")
                    here = here.parent
                articles -= here.tag in ("article", "main")
                # An unclosed link must not make links of all that follows.
                here.linked = here.target
                here = here.parent
            elif name in ("br", "p"):
                here.children.append("\n")
            continue
        name, rest = (found["start"] or found["odd"]).lower(), found["rest"] if found["start"] else found["loose"]
        if name in ("html", "body"):
            continue
        ends = CLOSED_BY.get(name, ()) or (("p",) if name in CLOSES_P else ())
        if ends:
            node = here
            while node is not root and node.tag not in ends and (node.tag not in SCOPES or node.tag in ends):
                node = node.parent
            if node is not root and node.tag in ends:
                while here is not node.parent:
                    articles -= here.tag in ("article", "main")
                    here = here.parent
        node = Node(name, here, _no_content(name, rest, articles > 0), name == "a" and TARGET.search(rest) is not None)
        here.children.append(node)
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(html, at)
            at = close.start() if close else len(html)
            if close:
                end = html.find(">", at)
                at = end + 1 if end >= 0 else len(html)
        elif name not in VOID and not rest.endswith("/"):
            articles += name in ("article", "main")
            here = node
    if at < len(html):
        here.children.append(html[at:])
    return root


def enter_containers(root: Node) -> Node:
    """Take the mark of no content from nodes around the page's article, or around more of its text than their mark asks for.

    The page's article is its longest article or main element by text outside links; a list of several such elements, none
    of which has half of the list's text, is no container of it.
    """
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and c.skip != NEVER)
    if not any(n.skip for n in nodes):
        return root
    text: dict[int, tuple[int, int, int]] = {}  # outside links and closed nodes; of the longest article; of all articles
    for node in reversed(nodes):
        plain = 0 if node.tag == "a" else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        longest = all_articles = 0
        for c in node.children:
            if isinstance(c, Node) and id(c) in text:
                own, long, whole = text[id(c)]
                plain, longest, all_articles = plain + (own if node.tag != "a" and c.skip != CLOSED else 0), max(longest, long), all_articles + whole
        if node.tag in ("article", "main") and not node.skip:
            longest, all_articles = plain, plain
        text[id(node)] = plain, longest, all_articles
    page, article, _ = text[id(root)]
    for node in nodes:
        plain, longest, all_articles = text[id(node)]
        if node.skip and (article and longest == article and 2 * longest >= all_articles or plain > node.skip * page):
            node.skip = 0.0
    return root


def _density(chars: int, links: int, tags: int, link_tags: int, rate: float) -> float:
    base = math.log(chars / max(1, chars - links) * links + rate * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / max(1, links) * tags / max(1, link_tags))) / base


def measure(root: Node) -> list[Node]:
    """Count characters, tags and links below every content node; gives the nodes, parents first, in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        node.first = node.last = len(nodes)
        node.linked |= node is not root and node.parent.linked
        nodes.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip)
    for node in reversed(nodes):
        text = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.chars, node.own, node.tags = node.chars + text, node.own + text, node.tags + 1
        if node.linked:
            node.links, node.own_links = node.chars, node.own
        if node.tag == "a":
            node.link_tags += node.linked
        if node is not root:
            up = node.parent
            up.chars, up.links, up.tags, up.link_tags = (up.chars + node.chars, up.links + node.links, up.tags + node.tags,
                                                         up.link_tags + node.link_tags)
            up.last = max(up.last, node.last)
            if node.inline:
                up.own, up.own_links = up.own + node.own, up.own_links + node.own_links
    rate = root.links / max(1, root.chars)
    for node in reversed(nodes):
        if node.chars and not node.linked:
            node.density = _density(node.chars, node.links, node.tags, node.link_tags, rate)
            if not node.inline:
                if node.own == node.chars:
                    node.sum = node.density
                elif node.own:
                    node.sum += _density(node.own, node.own_links, 1, 1 if node.own_links else 0, rate)
        if node is not root:
            node.parent.sum += node.sum if node.inline else node.density
    return nodes


def chosen(root: Node) -> Node:
    """The article's subtree; blocks in it that are mere lists of links get the mark of no content."""
    nodes = measure(root)
    named = sorted(_outermost(nodes, ("article", "main")), key=lambda n: -n.chars)
    main = named[0] if named and named[0].tag == "main" else None
    if main is not None:
        root, nodes = main, nodes[main.first:main.last + 1]
    core = max((n for n in nodes if not n.inline), key=lambda n: n.sum)
    if not core.sum:
        return named[0] if len(named) == 1 else root
    while below := [c for c in core.children if isinstance(c, Node) and not c.skip and not c.inline and c.sum == core.sum]:
        core = below[0]
    if main is None and named and (len(named) == 1 or 2 * named[1].chars < named[0].chars):
        article = named[0]
        least = MUCH if len(named) == 1 else 0.5  # less beside the core is a teaser
        if _holds(article, core) or (len(named) == 1 or _holds(core, article)) and article.chars > least * core.chars:
            return article
    threshold, per_tag = _thresholds(core, root, [n.first for n in nodes if _link_list(n)])
    marks, until = [core], -1
    for n in nodes:
        if n.first <= until or n.inline or not n.chars or _holds(n, core):
            continue
        plain = 2 * n.links <= n.chars
        dense = n.density >= threshold or plain and (n.chars >= per_tag * n.tags or n.chars - n.links >= MUCH * core.chars)
        if dense or _link_list(n):
            until = n.last  # what is in a dense block stays, headings of lists of links are none of the article's
        if dense or plain and n.tag in HEADINGS:
            marks.append(n)
    start, end = min(n.first for n in marks), max(n.last for n in marks)
    node = main or core
    while node.first > start or node.last < end:
        node = node.parent
    if 2 * node.links <= node.chars:
        _leave_link_lists(node, [n for n in marks if n is not root])
    return node


def _thresholds(core: Node, root: Node, lists: list[int]) -> tuple[float, float]:
    """The smallest density, and characters for each tag, of the core and what is above it.

    Containers that also hold a list of links beside the core are the page's frame: as thin as its menus, they tell nothing.
    """
    threshold, per_tag, node = core.density, core.chars / core.tags, core
    while node is not root:
        node = node.parent
        outside = bisect_left(lists, core.first) - bisect_left(lists, node.first)
        beside = outside + bisect_left(lists, node.last + 1) - bisect_left(lists, core.last + 1)
        if beside:
            break
        threshold, per_tag = min(threshold, node.density), min(per_tag, node.chars / node.tags)
    return threshold, per_tag


def _outermost(nodes: list[Node], tags: tuple[str, ...]) -> list[Node]:
    out, until = [], -1
    for n in nodes:
        if n.first > until and n.chars and n.tag in tags:
            out.append(n)
            until = n.last
    return out


def _holds(node: Node, other: Node) -> bool:
    return node.first <= other.first <= node.last


def _link_list(node: Node) -> bool:
    return not node.inline and node.link_tags > 1 and 2 * node.links > node.chars


def _leave_link_lists(node: Node, marks: list[Node]) -> None:
    """Close the blocks of several links, and of little else, that are in no mark and hold none."""
    marked, starts = {id(n) for n in marks}, sorted(n.first for n in marks)
    stack = [node]
    while stack:
        node = stack.pop()
        if id(node) in marked or not node.chars:
            continue
        at = bisect_left(starts, node.first)
        if _link_list(node) and (at == len(starts) or starts[at] > node.last):
            node.skip = NEVER
            continue
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.skip)


def text_of(node: Node) -> str:
    """Text below a node: inline elements join, blocks and line breaks part; white space becomes one space."""
    out, stack = [], [node]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        if top.skip:
            if not top.inline:
                out.append(" ")
            continue
        apart = not top.inline
        if apart:
            out.append(" ")
            stack.append(" ")
        stack.extend(reversed(top.children))
    return " ".join(unescape("".join(out)).split())


def main_text(html: str) -> str:
    return text_of(chosen(enter_containers(parse(html)))) if html else ""


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, text, n_chars (code points) for every row, from the whole page.

    A missing or empty page, or one without text, gives the empty text; repeated rows give equal rows; an empty
    table gives an empty result; other columns are not read.
    """

    small_batches(pages.sparkSession)
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", AT_ONCE):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array(list(map(len, texts)), pa.int64())], names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), whole_text(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(read, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
