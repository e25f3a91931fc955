"""HTML extraction by consensus host paths.

A page's containers are scored by the text that lies in them, less what lies in
links; the best one gives way to the article around it. Each page votes for that
container's path of tags and classes, with numbers generalised. Votes are summed by host; the path that wins a host says
where the main text lies on all of its pages, and a page without that path uses
its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch
from .urls import parts

COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: A tag whose values in quotes may hold a ``>``, and one that ends with the first.
TAG = re.compile(rf"""{COMMENT}|{NAME}((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
PLAIN = re.compile(rf"{COMMENT}|{NAME}([^>]*+)>", re.S)
#: Tags of a page with a quote that nothing closes, each of which was looked for to the end; with more, quotes mean nothing.
TORN = 16
UNQUOTED = re.compile(r"""=\s*[^\s"'>]*/$""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I | re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select button annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mspace mpadded mphantom menclose semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li pre blockquote dt dd td th figcaption caption".split())
DROPPED = frozenset("nav aside footer form head menu dialog fieldset".split())
#: An opening tag ends an open one of the given kinds, up to the given border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements that a class, id or role can mark as not of the article: boxes. Headings, paragraphs, quotations, tables and figures are what
#: an article says, whatever they are called.
BOXES = frozenset("div section ul ol dl span center details summary".split())
#: Words of a class, id or role that mark what isn't the article, those in STEMS also with an ending, if the rest of the name says nothing else.
MARKS = frozenset("nav menu navbar navigation sidebar aside ad ads adv advert banner promo sponsor sponsored notice notices cookie cookies consent gdpr alert comment comments disqus share sharing social related recommended breadcrumb breadcrumbs popup modal overlay subscribe newsletter signup login form search widget toolbar pagination pager skip complementary contentinfo footer toc".split())
STEMS = ("advert", "comment", "sidebar", "cookie", "newsletter", "subscri", "breadcrumb", "navig", "sponsor", "promo")
PLAIN_WORDS = frozenset("the a of my js is has no id box block wrap wrapper container content list area section group inner outer item items entry bar panel row col column cell unit slot top bottom left right center header head title body main page site post posts article articles story stories blog news user reader latest more global primary secondary desktop mobile small large big inline sticky fixed new hidden visible link links button buttons icon icons text message info card cards".split())
OUTER_MARKS = frozenset("header masthead topbar banner".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


#: Elements that hold no text of their own kind: what lies in them counts for the container around.
PARTS = TEXTUAL | {"ul", "ol", "dl", "table", "tbody", "thead", "tr"}
#: A container is left for the one around it if that adds so much of the text, or a headline.
GAIN = 0.1


class Node:
    __slots__ = ("tag", "parent", "label", "dropped", "score", "inside", "holder", "number", "last", "total", "match", "chosen")

    def __init__(self, tag: str, parent: Node | None, label: str, dropped: bool, number: int, winner: list[str]):
        self.tag, self.parent, self.label, self.dropped = tag, parent, label, dropped
        self.number = self.last = number
        self.score = self.total = 0
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.holder = parent.holder if parent and tag in PARTS else self
        # how many labels of the winning path lead here, -1 off that path; ``chosen`` at its end and below
        at = parent.match if parent else -1
        self.match = 0 if parent is None else at + 1 if 0 <= at < len(winner) and winner[at] == label else -1
        self.chosen = bool(parent and parent.chosen) or bool(winner) and self.match == len(winner)

    def path(self) -> str:
        """The labels from the root to here; built for the one container that a page votes for."""
        labels, up = [], self
        while up.parent:
            labels.append(up.label)
            up = up.parent
        return ">".join(reversed(labels))


@lru_cache(1 << 14)
def _marks(name: str, inside: bool) -> bool:
    """A name that says no more than that its box is a menu, notice, advert, form or the like: ``ad-box``, not ``ad-history``."""
    words = [w.lower() for w in WORDS.findall(name)]
    known = [w in MARKS or w.startswith(STEMS) and len(w) < 14 or not inside and w in OUTER_MARKS for w in words]
    return any(known) and all(k or w in PLAIN_WORDS or w.isdigit() or len(w) == 1 for k, w in zip(known, words, strict=True))


def _open(tag: str, attributes: str, parent: Node, number: int, winner: list[str]) -> Node:
    label, marked = tag, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = html.unescape(a or b or c)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            marked = True
            continue
        if name == "class":
            label += "".join("." + re.sub(r"\d+", "#", x) for x in value.split())
        if tag in BOXES:
            marked |= any(_marks(x, parent.inside) for x in value.split())
    if tag in ("article", "main", "body", "html"):
        marked = False
    dropped = parent.dropped or marked or tag in DROPPED or tag == "header" and not parent.inside
    return Node(tag, parent, label, dropped, number, winner)


class Page:
    """A page's elements in the order in which they open and, in page order, the blocks outside dropped elements: (element, text, characters of it in links).

    Everything is done in loops over elements and blocks, so deep nesting costs no more than its number of tags.
    """

    def __init__(self, page: str, path: str | None = None):
        self.nodes = [Node("", None, "", False, 0, winner := path.split(">") if path else [])]
        self.blocks: list[tuple[Node, str, int]] = []
        self._read(page, winner)
        for node, whole, in_links in self.blocks:
            worth = max(0, len(whole) - 2 * in_links)
            holder = (node.parent if node.tag in TEXTUAL and node.parent else node).holder
            holder.score += 2 * worth
            node.total += worth
            if holder.parent:
                holder.parent.score += worth
        for node in reversed(self.nodes[1:]):
            node.parent.total += node.total
            node.parent.last = max(node.parent.last, node.last)

    def best(self) -> Node | None:
        """The container of the main text, None without text.

        From the one with the highest score, of equals the first, to the article or main element around it; in a
        page without these as far out as the next container adds ``GAIN`` of the text or a headline.
        """
        top = max(self.nodes, key=lambda n: n.score)
        if not top.score:
            return None
        up, found = top, {}
        while up.parent:
            found.setdefault(up.tag, up)
            up = up.parent
        if around := found.get("article") or found.get("main"):
            return around
        headed = {node.parent.number for node, _, _ in self.blocks if node.tag in ("h1", "h2") and node.parent}
        up = top
        while up.parent and up.parent.parent:
            up = up.parent
            if up.total >= (1 + GAIN) * top.total or up.number in headed and up.tag != "body":
                top = up
        return top

    def text(self) -> str:
        """The blocks below the winning path, or in the page's own best container if the page has no text there."""
        chosen = [t for node, t, _ in self.blocks if node.chosen]
        if not chosen and (top := self.best()):
            chosen = [t for node, t, _ in self.blocks if top.number <= node.number <= top.last]
        return "\n\n".join(chosen)

    def _read(self, page: str, winner: list[str]) -> None:
        at = root = self.nodes[0]
        out, text, links, linked = self.blocks, [], 0, 0
        open_: dict[str, int] = {}  # elements of each tag that are open

        def leave(to: Node) -> None:
            nonlocal at
            while at is not to:
                open_[at.tag] -= 1
                at = at.parent

        def flush() -> None:
            nonlocal links
            if text:
                if not at.dropped and (whole := " ".join(html.unescape("".join(text)).split())):
                    out.append((_block(at), whole, links))
                text.clear()
            links = 0

        def add(s: str) -> None:
            nonlocal links
            if s and not at.dropped:
                text.append(s)
                if linked:
                    links += len(s)

        done, n, last, torn = 0, len(page), page.rfind(">"), 0
        while done < n:
            at_ = page.find("<", done)
            if at_ < 0 or at_ > last and not page.startswith("<!--", at_):
                # no tag ends from here on
                comment = page.find("<!--", done) if at_ >= 0 else -1
                add(page[done:] if comment < 0 else page[done:comment])
                break
            m = TAG.match(page, at_) if torn < TORN else None
            if not m and (m := PLAIN.match(page, at_)) and m[2]:
                torn += 1
            if not m:
                add(page[done : at_ + 1])
                done = at_ + 1
                continue
            add(page[done:at_])
            done = m.end()
            close, tag, rest = m[1], m[2], m[3]
            if not tag:
                continue
            tag = tag.lower()
            if tag in VOID:
                if tag in INLINE:
                    add(" " if tag in ("br", "wbr") else "")
                else:
                    flush()
                continue
            inline = tag in INLINE
            if not close:
                if tag in RAW:
                    alone = rest.endswith("/") and not UNQUOTED.search(rest)
                    if not alone or tag in ("script", "style"):
                        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, done)
                        if end or not alone:
                            done = (page.find(">", end.end()) + 1 or n) if end else n
                    continue
                if not inline:
                    flush()
                    leave(_implied(at, tag, open_))
                elif tag == "a":
                    linked += 1
                at = _open(tag, rest, at, len(self.nodes), winner)
                self.nodes.append(at)
                open_[tag] = open_.get(tag, 0) + 1
                continue
            if not inline:
                flush()
            elif tag == "a":
                linked = max(0, linked - 1)
            if not open_.get(tag):
                continue
            up = at
            while up is not root and up.tag != tag and not (inline and up.tag not in INLINE):
                up = up.parent
            if up is not root and up.tag == tag:
                leave(up.parent)
        flush()


def _block(at: Node) -> Node:
    while at.parent and at.tag in INLINE:
        at = at.parent
    return at


def _implied(at: Node, tag: str, open_: dict[str, int]) -> Node:
    """The element in which ``tag`` opens: an open paragraph, and a list item or cell of the same list or row, ends."""
    kinds, border = ENDS.get(tag, (set(), set()))
    up = at
    while up.parent and any(open_.get(x) for x in ("p", *kinds)):
        if up.tag == "p":
            at = up = up.parent
            continue
        if up.tag in kinds:
            return up.parent
        if up.tag in border or up.tag not in INLINE and up.tag not in TEXTUAL and not kinds:
            break
        up = up.parent
    # inline elements that were left open end with their block
    while at.parent and at.tag in INLINE:
        at = at.parent
    return at


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], int] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if top := Page(page.as_py() or "").best():
                key = host, top.path()
                votes[key] = votes.get(key, 0) + top.total
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(page.as_py() or "", path).text() for page, path in zip(batch.column("html"), batch.column("winner").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the article's blocks, joined by two line feeds.

    Menus, page headers, footers, side bars, notices, adverts, forms, scripts, styles and comments are left
    out; character references are decoded, white space in a block becomes one space. Null, empty and
    text-free pages have an empty text. Pages with a null URL share one empty host. Rows repeat as in
    the input; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    host, _ = parts(F.col("url").cast("string"))
    hosted = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    votes = hosted.select("host", "html").mapInArrow(_vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("top")).select("host", F.col("top.path").alias("winner"))
    # read back from its files, the table has a known size: Spark broadcasts it if it is small and splits hot hosts otherwise
    winners = scratch.save(winners, "winners")
    return hosted.join(winners, "host", "left").select("page_id", "url", "html", "winner").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
