"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph-like block of some length earns points for its
length and commas and passes them to its container, half of them to the element around that, half of
those to the next, and so on; an element's sum is discounted by its link density. The best container,
or the article around it, is kept, with articles of text beside that one. Without an article,
everything beside the container or beside an element around it is kept as well where few of its
letters are links, however short it is; and lists of nothing but links are menus there if they come
before the first paragraph, or if the links stand in a box without being items of a list or table.
Lists of links elsewhere, such as sources, are text.

Menus, headers, footers, sidebars, notices, adverts, scripts and reader comments are cut out by
element and role. Names of classes and forms are weaker signs, which the text itself overrules: such
an element stays if it holds an article, if it holds at least two paragraphs and two thirds of the
points of the article around it (of the page, if that has no article), or, for words of more than one
meaning such as share or legal, if it holds three paragraphs of full length within an article.

The text of each block has its character references decoded and white space turned into one space;
blocks are joined by an empty line, in page order. Nothing else is dropped or shortened. Parsing and
scoring take time linear in the page, nested as deep as it may be.

Defined results: null and empty pages have an empty text; a tag that the page's end cuts off is
left out; unclosed elements end with their parent; a page without long paragraphs gives all that
the cuts leave of its article, or else of its body; repeated rows are read as often as they occur.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import made_columns

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?(?=</(?P=raw)[\s/>])|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^<>]*>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
UNFINISHED = re.compile(r"<[a-z/!?]", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
CUT_TAGS = frozenset("head nav header footer aside button select option input dialog menu svg canvas object embed audio video map script style".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CUT_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login"
    " sidebar sidebars sidenav rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar header masthead footer"
    " foot colophon copyright legal share sharing social related recommended recommendations widget widgets pager pagination"
    " skip search form".split()
)
#: Those of CUT_CLASSES that articles use for their own text as well.
WEAK_CLASSES = frozenset(
    "notice notices alert alerts banner banners header foot legal copyright share sharing social related recommended widget"
    " widgets search form promo promos promotion subscription rail skip overlay".split()
)
COMMENT_CLASSES = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
NOT_OF_IT = frozenset("has with no without not is".split())
EXEMPT = frozenset({"html", "body", "main"})
ARTICLES = frozenset({"article", "main"})
#: Blocks whose points go to the element around them.
ITEMS = frozenset({"p", "pre", "td", "blockquote", "li", "dd"})
#: start tag -> open elements that it ends, if none of the second set lies between
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
P_SCOPE = frozenset({"td", "th", "table", "button", "caption", "object"})
MIN_BLOCK = 25
FULL = 100
#: Blocks with a smaller share of letters in links are text.
LINKED = 0.25
ARTICLE_BONUS = 25.0
#: Lists and boxes of nearly nothing but links may be menus.
LISTS = frozenset({"ul", "ol", "dl", "div", "section", "table"})
MENU_LINKS, MENU_DENSITY = 3, 0.8
#: Signs of elements that are cut unless their text speaks against it.
WEAK, STRONG = 1, 2
MOST_PARAGRAPHS, MANY_PARAGRAPHS = 2, 3


class Node:
    __slots__ = ("tag", "parent", "order", "cut", "sign", "links", "points", "paragraphs", "full", "plain")
    __slots__ += ("holds", "scope", "dropped", "score", "chars", "link_chars", "inside", "menu", "bare")

    def __init__(self, tag: str, parent: Node | None, order: int) -> None:
        self.tag, self.parent, self.order = tag, parent, order
        self.cut, self.sign, self.links = False, 0, 0
        self.points, self.paragraphs, self.full, self.plain = 0, 0, 0, 0
        self.holds, self.scope, self.dropped = False, None, False
        self.score, self.chars, self.link_chars = 0.0, 0, 0
        self.inside, self.menu, self.bare = False, False, False

    @property
    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0


class Block:
    __slots__ = ("node", "text", "link_chars", "points")

    def __init__(self, node: Node, text: str, link_chars: int) -> None:
        self.node, self.text, self.link_chars = node, text, link_chars
        self.points = 1 + text.count(",") + min(len(text) // FULL, 3) if len(text) >= MIN_BLOCK else 0

    @property
    def linked(self) -> bool:
        return self.link_chars >= LINKED * len(self.text)


def class_words(value: str) -> list[list[str]]:
    """Words of each class or id: ``post-comments`` and ``postComments`` are post, comments."""
    return [[w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w] for name in value.split()]


def _cut_by_attributes(tag: str, rest: str) -> tuple[bool, int]:
    """Whether an element is cut for good; how strong a sign its class is."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if tag in EXEMPT:
        return False, 0
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True, 0
    if found.get("role", "").lower() in CUT_ROLES:
        return True, 0
    sign = 0
    for words in class_words(found.get("class", "") + " " + found.get("id", "")):
        for i, w in enumerate(words):
            if i and words[i - 1] in NOT_OF_IT:
                continue
            if w in COMMENT_CLASSES:
                return True, 0
            if w in CUT_CLASSES and tag != "article":
                sign = max(sign, WEAK if w in WEAK_CLASSES else STRONG)
    return False, sign


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements, parents first, and blocks of text in page order."""
    unfinished = UNFINISHED.search(page, page.rfind(">") + 1)
    if unfinished:
        page = page[: unfinished.start()]
    root = Node("#root", None, 0)
    nodes, blocks, stack = [root], [], [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack
    holders = [0]  # places of the open block elements
    pieces: list[str] = []
    link_chars = 0

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        nonlocal pieces, link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(stack[holders[-1]], text, min(link_chars, len(text))))
        pieces, link_chars = [], 0

    def close(at: int) -> None:
        if holders[-1] >= at:
            flush()
        while len(stack) > at:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                holders.pop()

    def add(text: str) -> None:
        nonlocal link_chars
        if text and not stack[-1].cut:
            text = html.unescape(text)
            pieces.append(text)
            if places.get("a"):
                link_chars += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            place = innermost((tag,))
            if place and (tag in BLOCKS or place > holders[-1]):
                close(place)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
            place = innermost(("p",))
            if place > innermost(P_SCOPE):
                close(place)
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            place = innermost(ends)
            if place > innermost(scope):
                close(place)
        if tag == "body" and places.get("head"):
            close(places["head"][0])
        if tag in VOID:
            continue
        node = Node(tag, stack[-1], len(nodes))
        cut, node.sign = _cut_by_attributes(tag, m["rest"]) if "=" in m["rest"] or "hidden" in m["rest"].lower() else (False, 0)
        if tag == "form":
            node.sign = STRONG
        node.cut = stack[-1].cut or cut or tag in CUT_TAGS
        nodes.append(node)
        if m["rest"].endswith("/") and tag in ("svg", "path", "use"):
            continue
        places[tag].append(len(stack))
        if tag in BLOCKS:
            holders.append(len(stack))
        stack.append(node)
        node.links = int(tag == "a")
    if at < len(page):
        add(page[at:])
    flush()
    return nodes, blocks


def _drop(nodes: list[Node], blocks: list[Block]) -> None:
    """Marks elements that their class, or being a form, says are no text, unless what they hold says they are."""
    for b in blocks:
        b.node.plain += len(b.text) - b.link_chars
        if b.points and not b.linked:
            b.node.points += b.points
            b.node.paragraphs += 1
            b.node.full += len(b.text) >= FULL
    for n in reversed(nodes[1:]):
        up = n.parent
        up.links += n.links
        up.plain += n.plain
        up.points += n.points
        up.paragraphs += n.paragraphs
        up.full += n.full
    articles = [n for n in nodes if n.tag in ARTICLES and not n.cut and n.plain]
    largest = {tag: max((n.plain for n in articles if n.tag == tag), default=0) for tag in ARTICLES}
    for n in articles:
        n.holds = 2 * n.plain >= largest[n.tag]
    for n in reversed(nodes[1:]):
        n.parent.holds |= n.holds
    for n in nodes[1:]:
        up = n.parent
        n.dropped = up.dropped
        n.scope = n if n.tag in ARTICLES and not n.cut else up.scope
        if n.sign and not n.holds:
            around = up.scope or (None if articles else nodes[0])
            most = around is not None and n.paragraphs >= MOST_PARAGRAPHS and 3 * n.points >= 2 * around.points
            many = up.scope is not None and n.sign == WEAK and n.full >= MANY_PARAGRAPHS
            n.dropped |= not (most or many)


def _score(nodes: list[Node], kept: list[Block]) -> None:
    for b in kept:
        n = b.node
        n.chars += len(b.text)
        n.link_chars += b.link_chars
        # a block's element may itself hold the text of several paragraphs, as a div does
        (n.parent if n.tag in ITEMS else n).score += b.points
    for n in reversed(nodes[1:]):
        up = n.parent
        up.chars += n.chars
        up.link_chars += n.link_chars
        up.score += n.score / 2
    for n in nodes:
        if n.chars:
            n.score = (n.score + ARTICLE_BONUS * (n.tag in ARTICLES and n.score > 0)) * (1 - n.density)


def _around(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def extract_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    _drop(nodes, blocks)
    kept = [b for b in blocks if not b.node.dropped] or blocks
    if not kept:
        return ""
    _score(nodes, kept)
    best = max(nodes, key=lambda n: (n.score, -n.order))
    if best.score <= 0:
        articles = [n for n in nodes if n.tag in ARTICLES and n.chars]
        best = max(articles, key=lambda n: (n.chars, -n.order)) if articles else nodes[0]
    outer = [n for n in _around(best) if n.tag in ARTICLES]
    best = outer[-1] if outer else best
    beside: set[int] = set()
    if best.tag in ARTICLES:
        chosen = [n for n in nodes if n.tag == best.tag == "article" and n.parent is best.parent and n.score > 0 and n.density < LINKED]
    else:
        # what stands beside the container, and beside what is around it, belongs to the text whatever it scores
        path = {id(n) for n in _around(best)}
        beside = {id(n.parent) for n in _around(best) if n.parent is not None and n.tag != "body"}
        chosen = [n for n in nodes if id(n.parent) in beside and n.chars and id(n) not in path]
        chosen = [n for n in chosen if n.density < LINKED or re.fullmatch("h[1-6]", n.tag)]
    for n in [best, *chosen]:
        n.inside = True
    for n in nodes[1:]:
        n.inside |= n.parent.inside
    inside = [b for b in kept if b.node.inside or (id(b.node) in beside and not b.linked)]
    if best.tag in ARTICLES:
        return "\n\n".join(b.text for b in inside)
    picked = {id(n) for n in [best, *chosen]}
    for n in nodes:
        n.menu = n.tag in LISTS and n.links >= MENU_LINKS and n.density > MENU_DENSITY and id(n) not in picked
    for b in inside:
        b.node.bare = b.node.menu and b.node.tag in ("div", "section") and b.link_chars > MENU_DENSITY * len(b.text)
    for n in nodes[1:]:
        n.menu |= n.parent.menu
        n.bare |= n.parent.bare
    out, begun = [], False
    for b in inside:
        begun |= b.points > 0 and not b.linked
        if not (b.node.bare if begun else b.node.menu):
            out.append(b.text)
    return "\n\n".join(out)


def with_main_text(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``main_text``, the main text of the whole page."""
    return made_columns(pages, [html_column], "main_text string", lambda rows: [[extract_text(x) for x in rows]], keep)


def page_texts(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    made = with_main_text(pages, html_column, ["page_id", "url"])
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
