"""Main text of HTML pages by composite text density (Sun, Song and Liao, 2011).

Every DOM node gets the characters and tags of its subtree and, of these, those
in links. Its density is characters per tag, scaled down by a logarithm whose
base grows with the links' share. A node's children's densities, its own bare
text counted as one, are summed; the box with the largest sum is the text. The
densities on its path up to body give the thresholds for what stands beside it:
another box belongs to the text if it is as dense as the chosen one or, within
the same box, as the least dense on the path; paragraphs, headings and bare text
of the boxes on the path follow their box unless they are mostly links. From a
list or quotation, or one of several sections, the choice is widened to the box
that holds it; a page's only h1 beside the path is its title.

Only what a main text never holds is taken out before, so that no long comment
can be chosen: elements for menus, forms, scripts, embedded media and the like
(``DROPPED``), a header or footer (but for an article's own header), roles, what
is hidden, and boxes with a class or id that is, as a whole, a name of furniture:
one word of ``FURNITURE``, maybe with words of place or shape (``NEUTRAL``) and
numbers. Paragraphs, headings and tables are never judged by their names.

A block's white space becomes single spaces; blocks are joined by one newline
in page order. Null and empty pages, and pages without text, give an empty
text. Very long and deeply nested pages are read whole, without recursion. Pages
are independent: repeated rows and ids give repeated rows, an empty table gives
an empty one, extra columns stay, those named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

# Element names of the HTML standard and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("script style textarea title noscript iframe noembed noframes template nav aside form button select option input label fieldset svg canvas audio video object embed map dialog menu head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div main section td table tbody blockquote details figure html ul ol dl".split())
PARTS = frozenset("blockquote details figure ul ol dl".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: An opening tag ends these open elements, up to a boundary.
IMPLIED_END = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
# Words that name furniture, and words of place and shape that may stand beside them.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments commentlist replies respond disqus cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe signup login paywall share sharing social related recommended recommendations pagination pager tags copyright disclaimer search skip hidden".split()
)
NEUTRAL = frozenset("site page main top bottom left right upper lower global primary secondary post posts article articles entry user users reader readers the my box area block bar wrap wrapper container inner outer list item items section slot unit panel widget thread form links link buttons button message text content icons".split())
#: Elements that a name can take out; an article only by a name of comments.
BOXES = frozenset("div section article ul ol dl li span figure center details".split())
COMMENTS = frozenset("comment comments commentlist replies respond disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Children of a box on the path follow it unless the share MOSTLY_LINKS of their characters is in links.
FOLLOWING = frozenset("p h1 h2 h3 h4 h5 h6 pre address table blockquote figure details ul ol dl".split())
MOSTLY_LINKS = 0.5

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


_NAMED = re.compile(r"[A-Za-z]+|[0-9]+")


def names_furniture(name: str, words: frozenset[str] = FURNITURE) -> bool:
    """Whether a class or id, as a whole, is a name of furniture: a word of ``words``, and beside such only neutral ones and numbers."""
    parts = [x.lower() for x in _NAMED.findall(name)]
    return any(x in words for x in parts) and all(x in words or x in FURNITURE or x in NEUTRAL or x.isdigit() or len(x) == 1 for x in parts)


def _is_furniture(tag: str, attributes: str, parent: Node) -> bool:
    if tag in ("header", "footer"):
        while tag == "header" and parent is not None:  # an article's own header stays
            if parent.tag == "article":
                return False
            parent = parent.parent
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag in BOXES:
            if any(names_furniture(x, COMMENTS if tag == "article" else FURNITURE) for x in value.split()):
                return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of the page's elements and texts; tolerant of unclosed and stray tags."""
    root = Node("html", None)
    node, at, n, lower = root, 0, len(page), None
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        for quote in "\"'":
            if attributes.count(quote) % 2 and '="' in attributes + '="' and attributes.rfind("=" + quote) >= 0 and attributes.count(quote, attributes.rfind("=" + quote)) == 1:
                close = page.find(quote, at)  # a > inside a quoted value
                if close >= 0:
                    end = page.find(">", close)
                    attributes += page[at - 1 : close + 1]
                    at = end + 1 if end >= 0 else n
                break
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in ("html", "body"):
            if tag == "body" and node.tag == "head":
                node = node.parent
            if tag == "html":
                continue
        if tag in CLOSES_P or tag in IMPLIED_END:
            ends, stops = IMPLIED_END.get(tag, ({"p"}, set()))
            if tag in CLOSES_P:
                ends = ends | {"p"}
            up, found = node, None
            while up is not root and up.tag not in stops and not (up.tag in CONTAINERS and up.tag not in ends):
                if up.tag in ends:
                    found = up
                up = up.parent
            if found is not None:
                node = found.parent
        if node.tag == "head" and tag not in DROPPED and tag not in ("meta", "link", "base"):
            node = node.parent
        if tag == "br":
            node.parts.append(" ")
            continue
        new = Node(tag, node, tag in DROPPED or _is_furniture(tag, attributes, node))
        node.parts.append(new)
        if tag in RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != n:  # a letter whose lower case is longer
                    lower = "".join(c.lower() if c < "\x80" else c for c in page)
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            node = new
    return root


def _order(root: Node) -> list[Node]:
    """Kept nodes, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            out.append(node)
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is the share of body's characters that are in links."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    value = max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.0)
    return chars / tags * math.log(value + math.e - 1) / base


def measure(nodes: list[Node], body: Node) -> None:
    """Counts, densities and density sums of every node, children before parents."""
    own = {id(n): sum(len("".join(p.split())) for p in n.parts if isinstance(p, str)) for n in nodes}
    in_link: set[int] = set()
    for n in nodes:
        if n.tag == "a" or n.parent is not None and id(n.parent) in in_link:
            in_link.add(id(n))
    for n in reversed(nodes):
        linked = id(n) in in_link
        n.chars, n.tags = own[id(n)], 1
        n.link_chars, n.link_tags = (n.chars, 1) if linked else (0, 0)
        for p in n.parts:
            if isinstance(p, Node) and not p.dropped:
                n.chars += p.chars
                n.tags += p.tags
                n.link_chars += p.link_chars
                n.link_tags += p.link_tags
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(nodes):
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        bare, linked = own[id(n)], id(n) in in_link
        n.total = density(bare, 1, bare if linked else 0, int(linked), share) + sum(p.density for p in n.parts if isinstance(p, Node) and not p.dropped)


def _contents(body: Node) -> list[Node]:
    """The selected subtrees in page order."""
    nodes = _order(body)
    measure(nodes, body)
    if not body.chars:
        return []
    share = body.link_chars / body.chars
    boxes = [x for x in nodes if x.tag in CONTAINERS and x.chars]
    best = max(boxes, key=lambda x: x.total, default=body)  # the first of equals
    dense = best.density
    best = _whole(best, body)
    path = _path(best, body)
    least = min([dense, *(x.density for x in path)])
    near = {id(x) for x in path}
    title = None
    if not any(x.tag == "h1" for x in _order(best)):
        titles = [x for x in nodes if x.tag == "h1" and x.chars]
        title = titles[0] if len(titles) == 1 else None
    above = {id(x) for x in _path(title, body)} if title else set()
    chosen: list[Node] = []
    stack: list[tuple[Node, bool]] = [(body, False)]
    while stack:
        node, inside = stack.pop()
        if node is best or node is title:
            chosen.append(node)
        elif id(node) in near:
            # What stands in body itself has no box that tells whose it is.
            stack += [(x, node is not body) for x in reversed(_pieces(node, near | above | {id(best), id(title)}, share))]
        elif node.link_chars < MOSTLY_LINKS * node.chars and node.density >= (0.0 if inside and node.tag in FOLLOWING else least if node.tag in FOLLOWING else dense):
            chosen.append(node)
        elif id(node) in above:
            chosen.append(title)
    return chosen


def _pieces(node: Node, whole: set[int], share: float) -> list[Node]:
    """The children of a box; runs of bare text and inline elements as paragraphs of their own."""
    out: list[Node] = []
    run: Node | None = None
    for p in node.parts:
        if isinstance(p, str) or p.tag not in BLOCKS and id(p) not in whole:
            if run is None:
                run = Node("p", node)
                out.append(run)
            run.parts.append(p)
            run.chars += len("".join(p.split())) if isinstance(p, str) else p.chars
            if isinstance(p, Node) and not p.dropped:
                run.tags += p.tags
                run.link_chars += p.link_chars
                run.link_tags += p.link_tags
        else:
            out.append(p)
            run = None
    for x in out:
        if x.density == 0 and x.chars:
            x.density = density(x.chars, x.tags + 1, x.link_chars, x.link_tags, share)
    return [x for x in out if x.chars and not x.dropped]


def _path(node: Node, body: Node) -> list[Node]:
    """The ancestors of a node up to body."""
    out = []
    while node is not body and node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def _whole(node: Node, body: Node) -> Node:
    """The box around a list or quotation, or around several sections: parts of one text."""
    for up in _path(node, body):
        several = node.tag == "section" and sum(isinstance(p, Node) and p.tag == "section" and not p.dropped for p in up.parts) > 1
        if node.tag not in PARTS and not several:
            break
        node = up
    return node


def text_of(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    body = next((p for p in root.parts if isinstance(p, Node) and p.tag == "body"), root)
    blocks: list[str] = []
    for content in _contents(body):
        line: list[str] = []
        stack: list[Node | str | None] = [content]  # None closes a block
        while stack:
            part = stack.pop()
            if part is None:
                blocks.append("".join(line))
                line = []
            elif isinstance(part, str):
                line.append(part)
            elif not part.dropped:
                block = part.tag in BLOCKS
                if block:
                    blocks.append("".join(line))
                    line = []
                    stack.append(None)
                stack += reversed(part.parts)
        blocks.append("".join(line))
    return "\n".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))


OUTPUT = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars (code points)."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            texts = [text_of(p) for p in batch.column("html").to_pylist()]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_texts(pages, "html", OUTPUT, make)
