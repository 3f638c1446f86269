"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their parent and, halved, to their grandparent; a container's points
are discounted by the share of its text inside links. The best container is kept, with those siblings that score well
or are paragraphs, headings, lists, quotes or tables of plain text. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are taken out of the tree before.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from skywharf.llm.rows import text_batches
from skywharf.llm.words import bounded

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
#: Raw elements that reach to the end of a page where nothing closes them, and those that may close themselves.
ENDLESS, DRAWN = frozenset("script style textarea title xmp noframes".split()), frozenset(("svg", "math"))
CUT = RAW | frozenset("head nav header footer aside form button select option dialog menu object applet canvas audio video label fieldset".split())
BLOCK = frozenset(
    "html body address article section main div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hr "
    "details summary center".split()
) | CUT
PARAGRAPH = frozenset("p pre td blockquote".split())
#: Elements that are never the whole of a text: the container around them is.
PARTS = frozenset("tr td th tbody thead tfoot table li ul ol dl dd dt p pre blockquote span b i em strong a font".split())
#: Siblings of the best container that are kept for their own text.
ALONGSIDE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl blockquote pre table figure".split())
#: What an opening tag closes, and the elements beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role that name what is not main text, and those that keep an element all the same.
SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav|navbar|navigation|menu|menubar|"
    r"breadcrumbs?|side|sidebar|aside|widget|header|masthead|topbar|footer|foot|bottombar|comments?|commentlist|respond|replies|reply|disqus|discussion|responses|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|complementary|contentinfo|copyright|skip|hidden)(?=$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|text|body)(?=$|[\s_-])", re.I)
#: Names such as with-sidebar tell of a neighbour, not of the element.
NEIGHBOUR = re.compile(r"(?<![\w-])(?:has|with|without|no)[-_][\w-]+", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "items", "hint", "cut", "size", "linked", "points")

    def __init__(self, tag: str, parent: Node | None, hint: str = "", cut: bool = False):
        self.tag, self.parent, self.hint, self.cut = tag, parent, hint, cut
        self.items: list = []
        self.size = self.linked = 0
        self.points = 0.0


def parse(page: str) -> Node:
    """Tree of a page; unclosed and stray tags are tolerated, text of raw elements is skipped.

    Open elements are counted by name, so a tag that closes nothing costs nothing, and others walk over what they close.
    """
    root = node = Node("html", None)
    at, low, opened = 0, None, Counter()

    def up_to(to: Node) -> Node:
        up = node
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            if token[0][0] != "<" or token[0] == "<":
                node.items.append(html.unescape(token[0]))
            continue
        tag = tag.lower()
        if token[1]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = up_to(up.parent)
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if tag in DRAWN and token[3].rstrip().endswith("/"):
                continue
            if low is None:
                low = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda m: m[0].lower(), page)
            end = low.find(f"</{tag}", at)
            if end >= 0:
                close = page.find(">", end)
                at = len(page) if close < 0 else close + 1
            elif tag in ENDLESS:
                at = len(page)
            continue
        if tag in BLOCK and opened["p"] > 0:
            node = up_to(_close_paragraph(node, root))
        if tag in CLOSES:
            node = up_to(_close(node, root, *CLOSES[tag], opened))
        hint, cut = "", tag in CUT
        if tag not in ("p", "b", "br", "i", "em", "strong", "li", "h1") or token[3]:
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(token[3])} if token[3] else {}
            hint = " ".join(found.get(k, "") for k in ("class", "id", "role") if k in found)
            style = found.get("style", "").replace(" ", "").lower()
            cut = cut or "display:none" in style or found.get("aria-hidden") == "true" or bool(hint and tag not in ("article", "main") and SIDE.search(NEIGHBOUR.sub("", hint)))
        child = Node(tag, node, hint, cut)
        node.items.append(child)
        if tag not in VOID:
            opened[tag] += 1
            node = child
    return root


def _close_paragraph(node: Node, root: Node) -> Node:
    """A block closes an open paragraph, with the inline elements left open inside it."""
    up = node
    while up is not root and up.tag not in BLOCK:
        up = up.parent
    return up.parent if up.tag == "p" and up is not root else node


def _close(node: Node, root: Node, what: set, beyond: set, opened: Counter) -> Node:
    up, to, left = node, node, sum(opened[tag] for tag in what)
    while left and up is not root and up.tag not in beyond:
        if up.tag in what:
            to, left = up.parent, left - 1
        up = up.parent
    return to


def score(root: Node) -> list[Node]:
    """Sets sizes, linked sizes and points of all kept nodes; returns the nodes that got points."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.items if isinstance(c, Node) and not c.cut)
    scored: dict[int, Node] = {}
    commas: dict[int, int] = {}
    for node in reversed(order):
        count = 0
        for item in node.items:
            if isinstance(item, str):
                node.size += len(SPACE.sub(" ", item).strip())
                count += item.count(",") + item.count("，") + item.count("、")
            elif not item.cut:
                node.size += item.size
                node.linked += item.linked
                count += commas[id(item)]
        commas[id(node)] = count
        if node.tag == "a":
            node.linked = node.size
    for node in order:
        plain = node.tag in PARAGRAPH or node.tag in ("div", "section") and any(isinstance(x, str) and x.strip() for x in node.items)
        if plain and node.size and node.parent is not None:
            points = (1 + commas[id(node)] + min(node.size / 100, 3)) * (1 - node.linked / node.size)
            for up, part in ((node.parent, 1), (node.parent.parent, 0.5)):
                if up is not None:
                    if id(up) not in scored:
                        scored[id(up)] = up
                        up.points += 25 if up.tag in ("article", "main") else 10 if MAIN.search(up.hint) else 0
                    up.points += points * part
    return list(scored.values())


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def chosen(root: Node) -> list[Node]:
    """The best container and the siblings to keep with it, in page order."""
    scored = score(root)
    if not scored:
        return [root]
    best = max(scored, key=lambda n: n.points * (1 - density(n)))
    while best.tag in PARTS and best.parent is not None:
        best = best.parent
    # An article inside is part of its page; a page of several articles keeps them all.
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points * (1 - density(best)))
    kept = []
    for item in best.parent.items:
        if not isinstance(item, Node) or item.cut:
            continue
        same = item.tag == best.tag and item.tag in ("article", "main") and density(item) < 0.5
        plain = item.tag in ALONGSIDE and item.size and density(item) < 0.25
        if item is best or same or plain or item.points * (1 - density(item)) >= least:
            kept.append(item)
    return kept


def blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below a node in page order, white space made single and trimmed."""
    parts: list[str] = []

    def flush():
        if text := SPACE.sub(" ", "".join(parts)).strip():
            out.append(text)
        parts.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(item)
        elif item.cut:
            continue
        elif item.tag in ("br", "wbr", "img", "hr"):
            parts.append("" if item.tag == "wbr" else " ")
        else:
            edge = item.tag in BLOCK
            if edge:
                flush()
                stack.append(None)
            stack.extend(reversed(item.items))
    flush()


def main_text(page: str | None) -> str:
    """Main text of a page; empty for null, empty or textless pages. Text without markup is kept whole."""
    if not page:
        return ""
    out: list[str] = []
    for node in chosen(parse(page)):
        blocks(node, out)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Whole pages are parsed; a null or empty page has an empty text. Repeated rows are taken one by one, other columns
    are ignored, an empty table gives an empty result.
    """
    text_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in bounded(batches, "html"):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
