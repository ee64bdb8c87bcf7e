"""Main-text extraction: containers are scored per page, hosts vote on paths in Spark, pages are read again along the winning path."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

# HTML element classes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "xmp"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINER = {"article", "body", "div", "main", "section", "td"}
ASIDE_TAGS = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "object", "select", "svg", "canvas", "title"} | RAW
ASIDE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
#: Parts of a name that say what the page has around, or a state, not what the element is.
QUALIFIERS = {"has", "no", "not", "with", "without", "hide", "show", "is", "enabled", "disabled", "open", "closed", "active", "visible", "hidden", "fixed", "sticky"}
#: Last parts of a name that say where or what kind of box an element is.
BOXES = {"left", "right", "top", "bottom", "main", "primary", "secondary", "inner", "outer", "wrapper", "wrap", "container", "area", "box", "list", "section", "block", "bar", "item", "items", "module", "panel", "row", "links", "form", "slot", "unit"}
#: Tags that a start tag closes if they are open above the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A table of the winning paths of at most so many hosts is broadcast, so that no page is shuffled by its host; a larger one is joined by shuffle.
BROADCAST_HOSTS = 500_000

#: A `>` inside a quoted value after `=` does not end a tag. Possessive groups never go back, so a page is read in time linear in its length.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
#: Leading zeros of a numeric reference, and one beyond all code points, which is the replacement character.
ZEROS, BEYOND = re.compile(r"&#(?:([xX])0++(?=[0-9a-fA-F])|0++(?=[0-9]))"), re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")


@dataclass
class Node:
    """An open element: its parent, and what it inherits, so that no path or list of ancestors is copied."""

    tag: str
    above: Node | None
    place: int
    #: Its own step of the path ('' for inline elements and paragraphs) and the steps from the root to it.
    step: str = ""
    steps: int = 0
    #: Whether it or an ancestor is boilerplate by its tag or role, whether its own name makes it so, and what holds in the end.
    hard: bool = False
    named: bool = False
    aside: bool = False
    in_article: bool = False
    score: float = 0.0

    @property
    def path(self) -> str:
        found, node = [], self
        while node is not None:
            if node.step:
                found.append(node.step)
            node = node.above
        return "".join(">" + step for step in reversed(found))

    def stands_at(self, path: str, steps: int) -> bool:
        """Whether this element's generalised path is `path`, which has so many steps; whole paths are compared for few elements alone."""
        return bool(self.step) and self.steps == steps and path.endswith(self.step) and self.path == path


@dataclass
class Block:
    """Text of one block, how much of it is linked, and the element it stands in."""

    text: str
    linked: int
    node: Node

    @property
    def aside(self) -> bool:
        return self.node.aside


def _elements(found: list[Block]) -> list[Node]:
    """All elements that blocks stand in, parents first."""
    seen: dict[int, Node] = {}
    for block in found:
        node: Node | None = block.node
        while node is not None and node.place not in seen:
            seen[node.place] = node
            node = node.above
    return [seen[k] for k in sorted(seen)]


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Generalised path step: the tag with its classes, digits made N."""
    names = sorted({re.sub(r"\d+", "N", c.replace(">", "")) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *names])


def _named_aside(names: str) -> bool:
    """Whether a class or id without a qualifier is a boilerplate word or ends in one, places and kinds of box at its end left out: `site-footer` and `sidebar-left`, not `share-price`."""
    for name in names.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split("[_-]+", name)]
        if not QUALIFIERS & set(parts):
            while len(parts) > 1 and (parts[-1] in BOXES or not parts[-1]):
                parts.pop()
            if parts[-1] in ASIDE_WORDS:
                return True
    return False


def _settle(found: list[Block]) -> None:
    """Decides what is boilerplate: what a tag or role marks, and what a name marks, unless that element has most of the page's unlinked text and no article or main lies outside it."""
    nodes = _elements(found)
    text, articles = dict.fromkeys((x.place for x in nodes), 0), dict.fromkeys((x.place for x in nodes), 0)
    for b in found:
        if not b.node.hard:
            text[b.node.place] += len(b.text) - b.linked
            articles[b.node.place] += b.node.in_article
    for x in reversed(nodes):
        if x.above is not None:
            text[x.above.place] += text[x.place]
            articles[x.above.place] += articles[x.place]
    whole, of_articles = (nodes and (text[nodes[0].place], articles[nodes[0].place])) or (0, 0)
    for x in nodes:
        lifted = x.named and 2 * text[x.place] > whole and articles[x.place] == of_articles
        x.aside = x.hard or (x.named and not lifted) or (x.above is not None and x.above.aside)


def unescape(piece: str) -> str:
    """Character references decoded; numbers of any length are fine."""
    if "&" not in piece:
        return piece
    return html.unescape(BEYOND.sub("\ufffd", ZEROS.sub(lambda m: "&#" + (m[1] or ""), piece)))


def blocks(page: str) -> list[Block]:
    """All text blocks of a page in order; unclosed, stray and cut-off tags are taken as browsers do, near enough."""
    root = Node("", None, 0)
    stack, out, parts, linked, n = [root], [], [], 0, 0
    links = 0
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, stack[-1]))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = unescape(piece)
        parts.append(piece)
        linked += len(piece) if links else 0

    def close(at: int) -> None:
        nonlocal links
        if any(x.tag not in INLINE for x in stack[at:]):
            flush()
        links -= sum(x.tag == "a" for x in stack[at:])
        opened.subtract(x.tag for x in stack[at:])
        del stack[at:]

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in CLOSES.get(tag, ()):
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(found[3])}
        above = stack[-1]
        # an article's own header holds its headline
        own = tag == "header" and above.in_article
        hard = tag in ASIDE_TAGS and not own or attributes.get("role", "").lower() in ASIDE_ROLES
        named = not hard and tag not in ("html", "body", "article", "main") and _named_aside(f"{attributes.get('class', '')} {attributes.get('id', '')}")
        n += 1
        step = "" if tag in INLINE or tag == "p" else _step(tag, attributes)
        stack.append(Node(tag, above, n, step, above.steps + bool(step), above.hard or hard, named, in_article=above.in_article or tag in ("article", "main")))
        opened[tag] += 1
        links += tag == "a"
    flush()
    _settle(out)
    return out


def best_container(found: list[Block]) -> Node | None:
    """The container of highest score: plain text counts for the nearest container, half as much for the next, and so on; links count against it."""
    nodes: dict[int, Node] = {}
    for block in found:
        if not block.aside:
            share, node = len(block.text) - 2.0 * block.linked, block.node
            # halved forty times a share decides nothing any more
            least = abs(share) / (1 << 40)
            while node is not None and abs(share) > least:
                if node.tag in CONTAINER:
                    node.score += share
                    nodes[node.place] = node
                    share /= 2
                node = node.above
    return max(nodes.values(), key=lambda x: (x.score, -x.place), default=None)


def _whole(node: Node) -> Node:
    """The nearest article or main that a container stands in, itself included; without one the container."""
    up: Node | None = node if node.in_article else None
    while up is not None and up.tag not in ("article", "main"):
        up = up.above
    return up or node


def main_text(page: str | None, path: str | None) -> str:
    """Blocks of the article around the elements of generalised path `path`, else around the page's own best container; '' if there are none."""
    found = blocks(page or "")
    usable = [b for b in found if not b.aside]
    nodes, steps = _elements(usable), (path or "").count(">")
    tops = {_whole(x).place for x in nodes if path and x.tag in CONTAINER and x.stands_at(path, steps)}
    if not tops:
        own = best_container(found)
        if own is None:
            return "\n".join(b.text for b in usable)
        tops = {_whole(own).place}
    inside: set[int] = set()
    for x in nodes:
        if x.place in tops or (x.above is not None and x.above.place in inside):
            inside.add(x.place)
    return "\n".join(b.text for b in usable if b.node.place in inside)


def host(url: str | None) -> str:
    """Lower-case host of a URL, without port and user; '' if there is none."""
    found = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): per host the path with the most text behind it, each page voting for its best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = []
            for url, page in zip(batch.column(0), batch.column(1)):
                best = best_container(blocks(page.as_py() or ""))
                if best is not None and best.score > 0:
                    votes.append({"host": host(url.as_py()), "path": best.path, "score": best.score})
            yield pa.RecordBatch.from_pylist(votes, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())]))

    votes = pages.mapInArrow(run, "host string, path string, score double").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): one row per row of `pages`, whole pages.

    Blocks are joined by one newline, white space inside one is a single space, character references are decoded.
    A null page counts as empty and gives '' and 0; a null or odd URL votes with the host ''. A page without the
    winning path of its host falls back to its own best container. Ids may be null or repeat; other
    columns are not read; an empty table gives an empty one.
    """
    small_batches(pages.sparkSession)
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    paths = Scratch(pages.sparkSession, "hosts").keep(host_paths(plain.select("url", "html")))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    own = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = plain.withColumn("host", F.coalesce(own, F.lit(""))).join(paths, "host", "left").select("id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), path.as_py()) for page, path in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
