"""Main text of web pages by tree scoring.

A page is cut into marks and texts by one expression (linear in the page, whatever is left open or unquoted) and read into
a tree with the usual rules for marks that may be left out. What can't be the article goes: scripts and forms by their
name, menus, notices, adverts, comments and the like by name, role, class or id, and lists that are nearly all links. Of
what is left, every block of text gets points for its length and its commas, discounted by the share of its characters
that are links; its element gets them whole and every further ancestor half of what its child has. The element with the
most points is the container; its siblings are kept if they are headings, have a fifth of its points or read as
prose. A container inside an article element stands for that article.

Edge cases: null and empty pages, and pages without text, have an empty text. Very long or deep pages need no recursion and
no bound; a page is one row, so it is read in one task, with others in batches of some megabytes. Rows are independent, so
ties and repeated rows need no rule (of equal elements the first wins). Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: A comment, an end mark, a start mark with its attributes, or another declaration; all end with the page at the latest.
MARK = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|$)""", re.I)
words = lambda text: frozenset(text.split())

VOID = words("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
#: Elements whose content isn't marks.
RAW = words("script style textarea title iframe noembed noframes xmp plaintext noscript")
#: Elements that are never part of the text.
GONE = words(
    "script style textarea title iframe noembed noframes noscript template head svg math object canvas audio video map"
    " form select option button input datalist nav footer aside dialog menu menuitem"
)
INLINE = words(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img ruby rb rp rt"
    " script style noscript template iframe textarea button select input svg math object canvas audio video map"
)
HEADINGS = words("h1 h2 h3 h4 h5 h6")
#: Which open elements a start mark ends, and at which elements the search for them stops.
CLOSES = {
    "li": (words("li"), words("ul ol menu dir")), "dt": (words("dt dd"), words("dl")), "dd": (words("dt dd"), words("dl")),
    "tr": (words("tr td th"), words("table")), "td": (words("td th"), words("table tr")), "th": (words("td th"), words("table tr")),
    "tbody": (words("thead tbody tfoot tr td th"), words("table")), "tfoot": (words("thead tbody tfoot tr td th"), words("table")),
    "option": (words("option"), words("select datalist")), "body": (words("head"), words("html")),
}
#: Words of a class, id or role that name what isn't the article.
NOISE = words(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners promo promos promotion sponsor sponsored sponsors"
    " cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup"
    " sidebar aside complementary menu menus nav navbar navigation breadcrumb breadcrumbs toolbar pager pagination paginator skip toc"
    " header masthead footer contentinfo colophon copyright comment comments commentlist respond reply replies disqus"
    " share sharing social related recommended recommendations trending widget widgets search login hidden"
)
ARTICLE = words("article articlebody main content entry post story")
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z]+")
#: A list or block with at least LINKS links that hold this share of its characters is a menu.
LINKS, LINK_SHARE = 3, 0.8


class Node:
    __slots__ = ("tag", "parent", "gone", "kind", "items", "own", "points", "chars", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, gone: bool, kind: bool) -> None:
        self.tag, self.parent, self.gone, self.kind = tag, parent, gone, kind
        #: Blocks (texts) and elements in page order.
        self.items: list[str | Node] = []
        self.own = self.points = 0.0
        self.chars = self.linked = self.links = 0


def about(tag: str, attrs: str, parent: Node) -> tuple[bool, bool]:
    """If an element can't be the article, and if it says that it is."""
    gone, kind = tag in GONE, tag in ("article", "main")
    if tag == "header":  # that of the article holds its title
        node: Node | None = parent
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
        gone = node is None
    if attrs and not gone:
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                said = set(SPLIT.split(value))
                if tag not in ("html", "body", "article", "main") or name == "role" or said & {"comment", "comments", "reply"}:
                    gone = gone or bool(said & NOISE)
                kind = kind or bool(said & ARTICLE)
            elif name == "itemprop":
                kind = kind or value == "articlebody"
            elif name == "style":
                gone = gone or "display:none" in value.replace(" ", "")
            elif name == "hidden" or value == "true":
                gone = True
    return gone, kind


def tree(page: str) -> tuple[Node, list[Node]]:
    """The page's root and all its elements in page order, with their blocks."""
    root = at = Node("", None, False, False)
    nodes, names = [root], {}
    held: list[str] = []
    held_linked, in_link = 0, 0

    def flush() -> None:
        """End the block that is being read; it belongs to the block element that is open."""
        nonlocal held_linked
        if held and not at.gone:  # what is gone ends no block around it
            text = SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                owner = at
                while owner.tag in INLINE and owner.parent is not None:
                    owner = owner.parent
                linked = min(held_linked, len(text))
                owner.items.append(text)
                owner.chars += len(text)
                owner.linked += linked
                owner.own += (1 + text.count(",") + len(text) / 100) * (1 - linked / len(text))
            held_linked = 0

    def close() -> None:
        nonlocal at, in_link
        names[at.tag] -= 1
        in_link -= at.tag == "a"
        at = at.parent

    def end(ends: frozenset[str], stops: frozenset[str]) -> None:
        """Close up to the innermost open element of ``ends`` that is inside the innermost of ``stops``."""
        if not any(names.get(t) for t in ends):
            return
        node, inner = at, None
        while node is not root and node.tag not in stops:
            if node.tag in ends:
                inner = node
                if ends != CLOSES["tr"][0] and ends != CLOSES["tbody"][0]:
                    break
            node = node.parent
        if inner is not None:
            while at is not inner:
                close()
            close()

    def text(raw: str) -> None:
        nonlocal held_linked
        if raw and not at.gone:
            raw = html.unescape(raw) if "&" in raw else raw
            held.append(raw)
            if in_link:
                held_linked += len(SPACE.sub(" ", raw).strip())

    done = 0
    while (m := MARK.search(page, done)) is not None:
        text(page[done : m.start()])
        done = m.end()
        if (tag := m["start"]) is not None:
            tag = tag.lower()
            if tag == "br":
                held.append(" ")
                continue
            if tag not in INLINE:
                flush()
                if names.get("p"):
                    end(PARAGRAPH, BUTTON)
                if tag in CLOSES:
                    end(*CLOSES[tag])
            attrs = m["attrs"]
            if tag in ("html", "body") and names.get(tag):
                continue
            gone, kind = (True, False) if at.gone else about(tag, attrs, at)
            if tag in RAW:
                # Skipped to its end mark.
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(page, done)
                done = len(page) if stop is None or tag == "plaintext" else stop.start()
                if stop is not None:
                    shut = page.find(">", stop.end())
                    done = len(page) if shut < 0 else shut + 1
                continue
            if tag in VOID or attrs.endswith("/") and at.tag in ("svg", "math"):
                continue
            if tag == "a":
                if in_link:  # links are not inside links
                    end(LINK, BUTTON)
                if not gone:
                    at_block = at
                    while at_block.tag in INLINE and at_block.parent is not None:
                        at_block = at_block.parent
                    at_block.links += 1
            node = Node(tag, at, gone, kind)
            if tag not in INLINE:  # an inline element has no blocks of its own
                nodes.append(node)
                owner = at
                while owner.tag in INLINE and owner.parent is not None:
                    owner = owner.parent
                owner.items.append(node)
            names[tag] = names.get(tag, 0) + 1
            in_link += tag == "a"
            at = node
        elif (tag := m["end"]) is not None:
            tag = tag.lower()
            if tag not in INLINE:
                flush()
            if not names.get(tag):
                continue
            if tag in INLINE:
                # It ends no block that was opened inside it.
                node = at
                while node is not root and node.tag != tag and node.tag in INLINE:
                    node = node.parent
                if node.tag != tag:
                    continue
            if tag in ("html", "body"):
                continue
            while at.tag != tag:
                close()
            close()
    text(page[done:])
    flush()
    return root, nodes


PARAGRAPH, BUTTON, LINK = frozenset({"p"}), words("table td th button object body html article section div"), frozenset({"a"})


def score(nodes: list[Node]) -> None:
    """Points of all elements, children before their parents; lists of links are dropped."""
    total = {id(n): [n.chars, n.linked, n.links] for n in nodes}
    for node in reversed(nodes):
        node.points += node.own
        size, linked, links = total[id(node)]
        if node.parent is None:
            continue
        if not node.gone and not node.kind and links >= LINKS and linked >= LINK_SHARE * size and node.tag not in ("body", "html"):
            node.gone = True
        if node.gone:
            continue
        up = node.parent
        while up.tag in INLINE and up.parent is not None:
            up = up.parent
        # A paragraph's points are whole in the element that holds it.
        up.points += node.points if node.tag in LEAVES else node.points / 2
        sums = total[id(up)]
        for k, n in enumerate((size, linked, links)):
            sums[k] += n


LEAVES = words("p pre blockquote li dd dt td th tr ul ol dl table tbody figure figcaption") | HEADINGS


def blocks(node: Node) -> Iterator[str]:
    """Texts of an element in page order."""
    stack: list[str | Node] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif not item.gone:
            stack.extend(reversed(item.items))


def keeps(node: Node, best: float) -> bool:
    """If a sibling of the container belongs to the article."""
    if node.gone:
        return False
    if node.tag in HEADINGS or node.points >= 0.2 * best:
        return True
    text = " ".join(blocks(node))
    return node.tag == "p" and node.links == 0 and (len(text) >= 80 or text[-1:] in ".!?…。")


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    root, nodes = tree(page.replace("\0", "�"))
    score(nodes)
    live: list[Node] = []
    for n in nodes:  # parents come first
        if n.parent is not None and n.parent.gone:
            n.gone = True
        if not n.gone:
            live.append(n)
    said = [n for n in live if n.kind and n.points > 0]
    pool = [n for n in live if n.tag not in LEAVES] or [root]
    best = max(pool, key=lambda n: n.points * (2 if n.kind else 1))
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is None and best.kind is False and said:
        up = max(said, key=lambda n: n.points) if max(n.points for n in said) >= best.points / 2 else None
    if up is not None:
        return "\n".join(blocks(up))
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(blocks(best))
    parent = best.parent
    kept = [x for x in parent.items if isinstance(x, Node) and (x is best or keeps(x, best.points))]
    return "\n".join(t for x in kept for t in blocks(x))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every page's ``html``."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    small_batches(pages)
    src = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("html").cast("string").alias("html"))
    names = [*src.columns[:-1], "text", "n_chars"]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in src.schema if f.name != "html")
    out = src.mapInArrow(run, kinds + "text string, n_chars long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
