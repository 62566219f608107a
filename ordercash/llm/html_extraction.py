"""Main text of web pages by scoring the tree of elements.

Every paragraph passes points, 1 and one for each comma and each hundred characters up to three, to its
parent, half of them to the grandparent and less to the next three ancestors. A container's sum is
discounted by the share of its text that is in links. The best container is kept, with those of its
siblings that score well, or are headings or paragraphs beside it. An ``article`` or ``main`` around the best
container, or one that makes up most of it, stands for it.

Left out wherever they stand: scripts, styles, navigation, forms, headers, footers, asides and hidden
elements, elements whose class, id or role names one of these or adverts, notices, comments and the
like, unless the page's first heading or ``main`` is in them, and lists of nothing but links. A page without any
paragraph long enough for points gives what is left of its article, or of its body.

A block's text is what stands between the borders of block elements; references are decoded, white space
(as ``str.split`` has it, and a line break) is one space. Blocks are joined by an empty line.

Pages are worked on one by one, in batches, without a shuffle. A null or empty page gives an empty text; nothing
is cut, whatever the length or depth. Equal pages give equal rows; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ordercash.llm.common import ship

ship(__name__)

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = HEADINGS | frozenset(
    "html body article section div p ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "blockquote figure figcaption address main header footer aside nav form fieldset legend details summary "
    "hr center hgroup menu dialog search".split()
)
#: Never part of a text.
NEVER = frozenset(
    "head title script style noscript noframes template svg iframe object canvas audio video map nav select "
    "textarea button option datalist label legend".split()
)
#: Left out unless the page's heading is in them.
ASIDE = frozenset("header footer aside form menu dialog fieldset search".split())
#: Words of classes, ids and roles that say the same.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
    "aside nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer colophon "
    "contentinfo complementary comment comments disqus replies respond cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations outbrain taboola widget pagination pager "
    "toolbar search form skip copyright legal disclaimer hidden".split()
)
#: Open elements that a start tag ends, and those it doesn't look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CELLS = frozenset({"table", "td", "th", "caption"})
TABLE_TAGS = CELLS | {"thead", "tbody", "tfoot", "tr", "html", "body"}
#: Parts of a container rather than containers.
PARTS = frozenset("p li ul ol dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr".split()) | HEADINGS
LINKED = frozenset("ul ol dl div section table menu".split())

WORD = re.compile("[a-z]+")
CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
COMMAS = re.compile("[,،、，]")
CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
LONG = 25  # characters of a paragraph that counts
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)


class Node:
    __slots__ = ("tag", "parent", "kids", "hinted", "main", "mixed", "out", "size", "linked", "links", "points")

    def __init__(self, tag: str, parent: Node | None, hinted: bool = False):
        self.tag, self.parent, self.hinted = tag, parent, hinted
        self.kids: list[Node | str] = []
        self.main = tag in ("h1", "main")
        self.mixed = self.out = False
        self.size = self.linked = self.links = 0
        self.points = 0.0

    @property
    def density(self) -> float:
        return self.linked / self.size if self.size else 0.0

    @property
    def score(self) -> float:
        return self.points * (1 - self.density)


def _hinted(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name in ("class", "id", "role"):
            if not HINTS.isdisjoint(WORD.findall(CAMEL.sub(" ", value).lower())):
                return True
        elif name == "style" and HIDES.search(value.lower()):
            return True
    return False


class Tree(HTMLParser):
    """The elements of a page in page order, unclosed and misnested ones put right."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", None)]
        self.open = [self.nodes[0]]
        self.count: Counter[str] = Counter()

    def _end(self, tags: set[str] | frozenset[str], border: set[str] | frozenset[str]) -> None:
        """End the nearest open element of these tags and all in it, if it is on this side of the border."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                for node in self.open[i:]:
                    self.count[node.tag] -= 1
                del self.open[i:]
                return
            if tag in border:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if tag == "body" or (self.open[-1].tag == "head"):
                self._end({"head"}, frozenset())
            self._end({"p"}, CELLS | {"button"})
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self._end(HEADINGS, frozenset())
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("html", "body") and self.count[tag]:
            return
        top = self.open[-1]
        node = Node(tag, top, _hinted(attrs) if attrs else False)
        top.kids.append(node)
        self.nodes.append(node)
        if tag in BLOCKS:
            while top is not None and not top.mixed:
                top.mixed = True
                top = top.parent
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in TABLE_TAGS:
            self._end({tag}, frozenset())
        else:
            self._end({tag}, CELLS if tag in BLOCKS else BLOCKS)

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parsed(html: str) -> list[Node]:
    tree = Tree()
    tree.feed(CUT_TAG.sub("", html))
    tree.close()
    # Children come after their parents.
    for node in reversed(tree.nodes):
        for kid in node.kids:
            if isinstance(kid, Node):
                node.main |= kid.main
        node.out = node.tag in NEVER or (
            (node.tag in ASIDE or node.hinted) and not node.main and node.tag not in ("html", "body")
        )
        if node.out:
            continue
        for kid in node.kids:
            if isinstance(kid, str):
                node.size += 0 if kid.isspace() else len(kid)
            else:
                node.size += kid.size
                node.linked += kid.linked
                node.links += kid.links
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        elif node.tag in LINKED and node.links > 2 and node.linked >= 0.8 * node.size:
            node.out = True
            node.size = node.linked = node.links = 0
    return tree.nodes


def blocks(top: Node) -> Iterator[tuple[Node, str]]:
    """Texts of the blocks below an element in page order, each with the block element it stands in."""
    run: list[str] = []

    def text() -> str:
        whole = " ".join("".join(run).split())
        run.clear()
        return whole

    owner = top
    path = [(top, iter(top.kids))]
    while path:
        node, kids = path[-1]
        for kid in kids:
            if isinstance(kid, str):
                run.append(kid)
            elif kid.tag == "br":
                run.append(" ")
            elif not kid.out:
                if kid.tag in BLOCKS:
                    if whole := text():
                        yield owner, whole
                    owner = kid
                path.append((kid, iter(kid.kids)))
                break
        else:
            path.pop()
            if node.tag in BLOCKS or not path:
                if whole := text():
                    yield owner, whole
                while owner is not top and (owner is node or owner.tag not in BLOCKS):
                    owner = owner.parent


def _scored(page: Node) -> None:
    for owner, text in blocks(page):
        if len(text) < LONG or owner.tag in HEADINGS:
            continue
        points = 1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)
        at = owner if owner.mixed else owner.parent
        for share in SHARES:
            if at is None:
                break
            at.points += points * share
            at = at.parent


def _around(node: Node, tag: str) -> Node | None:
    at: Node | None = node
    while at is not None and at.tag != tag:
        at = at.parent
    return at


def chosen(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    page = nodes[0]
    _scored(page)
    # The earliest of equals.
    best = max(nodes, key=lambda n: 0.0 if n.out else n.score)
    named = [n for n in nodes if n.tag in ("article", "main") and n.size and not _left_out(n)]
    if best.score <= 0:
        return [max(named, key=lambda n: n.size, default=page)]
    while best.tag in PARTS and best.parent is not None:
        best = best.parent
    around = _around(best, "article") or _around(best, "main")
    if around is not None:
        best = around
    else:
        inside = [n for n in named if _within(n, best) and 2 * n.size >= best.size]
        if inside:
            best = inside[0]
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.score)
    plain = best.tag not in ("article", "main")

    def beside(node: Node | str) -> bool:
        if isinstance(node, str) or node.out or not node.size:
            return False
        if node.tag in PARTS:
            return plain and node.density < 0.25
        return node.score >= least and node.density < 0.25

    return [n for n in best.parent.kids if n is best or beside(n)]


def _left_out(node: Node | None) -> bool:
    while node is not None:
        if node.out:
            return True
        node = node.parent
    return False


def _within(node: Node | None, top: Node) -> bool:
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n\n".join(text for node in chosen(parsed(html)) for _, text in blocks(node))


def _texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extracted(pages: DataFrame, html_column: str = "html", text_name: str = "text") -> DataFrame:
    """``pages`` with the main text of their html."""
    html: Column = F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    return pages.withColumn(text_name, F.pandas_udf(_texts, StringType())(html))
